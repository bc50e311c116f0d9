"""Snapshots: immutable directories plus a pointer (A-14, A-15, A-16, G-P, Q-10, Q-11).

Replacement of state (G-P). A small table is written whole. A large one is a list of layers in the snapshot's manifest: the
oldest is the base, each newer one holds the rows that a run wrote and the keys whose older rows they replace. A run writes its
changes only, wherever their keys lie (hash buckets of a table would all be touched by one percent of random keys); readers
take a row if no newer layer replaces its key, and a manifest never changes, so they see one version. A new layer takes up older
ones that are not ``GROWTH`` times as large: sizes grow geometrically, their number and the rewriting of a row with
the logarithm of the table.

A run writes ``<root>/snapshot=<run_id>/<table>`` (Parquet), the quality gate
reads the *written* data back, and only then the ``CURRENT`` pointer is
replaced (a file renamed over it). Readers resolve the pointer, so a failed
run leaves the previous snapshot published. ``WORKING`` names the latest
snapshot written: a batch that the gate refuses is not lost, the next one
builds on it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litfeed.constants import ACCEPTED_PREVIOUS_VERSIONS, SCHEMA_VERSION
from litfeed.operators import gate as G
from litfeed.schemas import SNAPSHOT

POINTER, WORKING = "CURRENT", "WORKING"
#: Rows of a file of articles, and the months (the largest ones) that are cut into several files.
FILE_ROWS, MOST_MONTHS = 1 << 14, 2000
#: A layer stays as it is if it has more than so many times the rows of all newer ones.
GROWTH = 2


@dataclass(frozen=True)
class Change:
    """What a run changes in a layered table: ``rows`` that it writes, and ``gone`` (one column, values of ``key``): keys whose
    earlier rows are no longer valid. Without ``gone`` rows are only added."""
    rows: DataFrame
    key: str | None = None
    gone: DataFrame | None = None


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p, jvm = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine()
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p, _ = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def snapshot_path(root: str, run_id: int) -> str:
    return f"{root.rstrip('/')}/snapshot={run_id}"


def _write(df: DataFrame, name: str, path: str) -> None:
    """Articles are clustered by uid within ``published_month`` partitions, so date filters prune files; a month is cut into
    files by a hash of the uid, one for each ``FILE_ROWS`` of its rows: many small months make no more files than there are months."""
    if name == "articles":
        df = df.withColumn("published_month", F.date_format("published_at", "yyyy-MM"))
        months = df.groupBy("published_month").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("_files")).where("_files > 1")
        cut = {r["published_month"]: r["_files"] for r in months.orderBy(F.desc("_files")).limit(MOST_MONTHS).collect()}
        files = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m in cut.items() for x in (m[0] or "", int(m[1]))]),
                                        F.coalesce("published_month", F.lit(""))), F.lit(1)) if cut else F.lit(1)
        df = df.repartition("published_month", F.pmod(F.xxhash64("uid"), files)).sortWithinPartitions("published_month", "uid")
        df.write.mode("overwrite").option("compression", "zstd").partitionBy("published_month").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def _layer_rows(spark: SparkSession, layers: list[dict], schema: str) -> DataFrame:
    """The valid rows of consecutive layers (oldest first)."""
    out, gone = None, None
    for layer in reversed(layers):
        rows = spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(layer["path"])
        if gone is not None:
            rows = rows.join(gone, gone.columns, "left_anti").select(*rows.columns)
        out = rows if out is None else out.unionByName(rows)
        if layer["gone"] is not None:
            more = spark.read.parquet(layer["gone"])
            gone = more if gone is None else gone.unionByName(more).distinct()
    return out


def _write_layer(change: Change, name: str, base: str, table: dict | None) -> dict:
    """The table's manifest entry with the run's changes as its newest layer."""
    spark = change.rows.sparkSession
    layers, rows = list(table["layers"]) if table else [], change.rows
    gone = change.gone.select(F.col(change.gone.columns[0]).alias(change.key)) if change.gone is not None else None
    size = rows.count() + (gone.count() if gone is not None else 0)
    if layers and size == 0:
        return table
    taken: list[dict] = []
    while layers and layers[-1]["rows"] <= GROWTH * size:
        taken.insert(0, layers.pop())
        size += taken[0]["rows"]
    if taken:
        older = _layer_rows(spark, taken, table["schema"]).drop("published_month")
        rows = (older if gone is None else older.join(gone, gone.columns, "left_anti").select(*older.columns)).unionByName(rows)
        for layer in taken:
            if layer["gone"] is not None:
                replaced = spark.read.parquet(layer["gone"])
                gone = replaced if gone is None else gone.unionByName(replaced).distinct()
    path, gone_path = f"{base}/{name}", None
    _write(rows, name, path)
    if layers and gone is not None:  # nothing is older than the base
        gone_path = f"{base}/_gone/{name}"
        gone.write.mode("overwrite").parquet(gone_path)
    schema = StructType(list(rows.schema.fields))
    if name == "articles":
        schema = schema.add("published_month", "string")
    return {"layers": [*layers, {"path": path, "gone": gone_path, "rows": size}], "schema": schema.json()}


def write_snapshot(tables: dict[str, DataFrame | Change], root: str, run_id: int, parent: str | None = None) -> str:
    """Write the tables of one run: DataFrames whole, a ``Change`` as the newest layer over the ``parent``'s table. Tables not given are
    inherited from ``parent``: the manifest ``_TABLES`` records where each table of the snapshot lies."""
    base = snapshot_path(root, run_id)
    first = next(iter(tables.values()))
    spark = (first.rows if isinstance(first, Change) else first).sparkSession
    places = table_places(spark, parent) if parent is not None else {}
    for name, df in tables.items():
        change = df if isinstance(df, Change) else Change(df)
        places[name] = _write_layer(change, name, base, places.get(name) if isinstance(df, Change) else None)
    _write_text(spark, f"{base}/_VERSION", str(SCHEMA_VERSION))
    _write_text(spark, f"{base}/_TABLES", json.dumps(places))
    return base


def table_places(spark: SparkSession, base: str) -> dict[str, dict]:
    """Manifest of a snapshot: for each table its layers, oldest first (in its own folder, or that of an earlier one), and its schema."""
    return json.loads(_read_text(spark, f"{base}/_TABLES") or "{}")


def note_catalogue(spark: SparkSession, base: str, value: str) -> None:
    _write_text(spark, f"{base}/_CATALOGUE", value)


def catalogue(spark: SparkSession, base: str) -> str | None:
    """Fingerprint of the rules, topics, gates and feeds that a snapshot was made with."""
    return _read_text(spark, f"{base}/_CATALOGUE")


def fingerprint(*tables: DataFrame) -> str:
    """A value that changes with the rows of small tables, in whatever order."""
    sums = [tuple(t.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64(F.to_json(F.struct(*sorted(t.columns)))), F.lit(1 << 40)))).first())
            for t in tables]
    return json.dumps(sums)


def read_table(spark: SparkSession, base: str, name: str, keep_partition: bool = False) -> DataFrame:
    table = table_places(spark, base).get(name)
    if table is None:
        raise FileNotFoundError(f"snapshot {base} has no table {name}")
    df = _layer_rows(spark, table["layers"], table["schema"])
    return df.drop("published_month") if "published_month" in df.columns and not keep_partition else df


def current(spark: SparkSession, root: str) -> str | None:
    """The published snapshot."""
    return _read_text(spark, f"{root.rstrip('/')}/{POINTER}")


def working(spark: SparkSession, root: str) -> str | None:
    """The snapshot that the next batch starts from: the latest one written, published or not."""
    return _read_text(spark, f"{root.rstrip('/')}/{WORKING}")


def missing_columns(spark: SparkSession, base: str) -> list[str]:
    """Q-2: required tables and columns of a written snapshot (``table.column``)."""
    out = []
    for name, schema in SNAPSHOT.items():
        try:
            have = set(read_table(spark, base, name).columns)
        except Exception:  # table directory absent or unreadable
            out.append(name)
            continue
        out += [f"{name}.{f.name}" for f in schema.fields if f.name not in have]
    return out


def open_snapshot(spark: SparkSession, root: str, table: str = "articles") -> DataFrame:
    """A-15: the published table read with its expected schema; fails when nothing is
    published, a required column is missing, or the article table is empty."""
    base = current(spark, root)
    if base is None:
        raise FileNotFoundError(f"no published snapshot under {root}")
    df = read_table(spark, base, table, keep_partition=True)
    if table in SNAPSHOT:
        expected = SNAPSHOT[table]
        lacking = [f.name for f in expected.fields if f.name not in df.columns]
        if lacking:
            raise ValueError(f"snapshot table {table} lacks columns {lacking}")
        # the month partition column is kept so date filters prune whole directories
        extra = [df["published_month"]] if "published_month" in df.columns else []
        df = df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in expected.fields], *extra)
    if table == "articles" and df.limit(1).count() == 0:
        raise ValueError("published snapshot is empty")
    return df


def gate(spark: SparkSession, base: str, previous: str | None) -> dict:
    """Q-3..Q-6, Q-10, Q-11 on the written data; one small row collected."""
    arts = read_table(spark, base, "articles")
    journals = read_table(spark, base, "journals")
    report = G.quality_report(arts, journals, read_table(spark, base, "runs")).first().asDict()
    stored = [read_table(spark, base, t) for t in ("url_aliases", "article_tags", "tags")]
    report["violations"] = {r.rule: r.violations for r in G.stored_violations(arts, *stored).where("violations > 0").collect()}
    report["missing"] = missing_columns(spark, base)
    version = _read_text(spark, f"{base}/_VERSION")
    report["version_ok"] = version is not None and int(version) == SCHEMA_VERSION
    report["count_ok"] = True
    if previous is not None:
        prev_version = _read_text(spark, f"{previous}/_VERSION")
        report["version_ok"] &= prev_version is not None and int(prev_version) in ACCEPTED_PREVIOUS_VERSIONS
        cd = G.count_drop(read_table(spark, previous, "articles"), arts).first()
        report["count_ok"] = bool(cd.passed)
    report["publishable"] = bool(report["passed"] and report["version_ok"] and report["count_ok"] and not report["missing"]
                                 and not report["violations"])
    return report


def _point(spark: SparkSession, root: str, pointer: str, base: str) -> None:
    """Replace a pointer in one step: a new file is renamed over the old one, so readers see either."""
    jvm = spark.sparkContext._jvm
    top = root.rstrip("/")
    _write_text(spark, f"{top}/_{pointer}.tmp", base)
    _, new, _ = _fs(spark, f"{top}/_{pointer}.tmp")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.getFileSystem(conf).makeQualified(new).toUri(), conf)
    options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(context.makeQualified(new), context.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{top}/{pointer}")), options)


def publish(spark: SparkSession, root: str, base: str) -> None:
    """A-16: the snapshot becomes the published one."""
    _point(spark, root, POINTER, base)


def keep_working(spark: SparkSession, root: str, base: str) -> None:
    """The snapshot becomes the one that the next batch starts from."""
    _point(spark, root, WORKING, base)
