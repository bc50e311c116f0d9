"""Print the formatted physical plan of registered queries.

Usage: python -m litfeed.plans.explain [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys


def main(argv: list[str]) -> None:
    sys.path.insert(0, os.getcwd())
    from litfeed.plans.catalogue import REGISTRY
    from litfeed.session import get_spark
    args = list(argv)
    sf_dir = args.pop(0) if args and os.path.isdir(args[0].split("?")[0]) else "/root/testdata/sf0.01"
    spark = get_spark()
    for name in args or list(REGISTRY):
        print(f"==== {name} ({REGISTRY[name].ops})")
        REGISTRY[name].build(spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
