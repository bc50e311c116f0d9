"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about ``FRAME`` bytes, each compressed on its own; frames follow one another in a bundle of
about ``BUNDLE`` bytes, and a skippable frame at its end holds the seek table (compressed and plain size of each frame, with a
footer), so any Zstandard reader can read a bundle whole and a seeking one can read a single frame. The index maps each record
to its bundle, frame and place within the frame.

Of records with equal payloads (SHA-1 and length), the one with the largest page_id (nulls last; the first row of equal ids) is
a response, the others are revisits that name it; payloads are written once. Bundles are written and read by tasks in the shared
folder; a bundle's name has a random part, so a repeated task leaves the bundle of a lost attempt unused, and the index names only
bundles of tasks that ended.

Edge cases: null html is an empty payload, and empty payloads are equal like any other; null urls and ids are kept as null;
repeated rows are records of their own; other columns do not matter; an empty table gives no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from litfeed.llm.common import scratch, written

FRAME = 1 << 18
BUNDLE = 1 << 26
LEVEL = 3
#: The date of all records: archives of equal tables are equal.
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable format: skippable frame, footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest(payload):
    """Upper-case base32 of a payload's SHA-1: 20 bits (five hex digits) are four base32 digits."""
    hexed = F.sha1(payload)
    parts = []
    for i in range(8):
        n = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(n, 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in (3, 2, 1, 0)]
    return F.concat(*parts)


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:record:{'' if page_id is None else page_id}:{row}>"


def page_of(identifier: str) -> int | None:
    page = identifier[1:-1].split(":")[2]
    return int(page) if page else None


def record(page_id, row, url, payload: bytes, sha1: str, size: int, refers: tuple | None) -> bytes:
    """One WARC/1.1 record; ``refers``: (page_id, row) of the response that a revisit repeats."""
    fields = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c for c in url if c not in "\r\n")))
    fields += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", str(size))]
    if refers:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(*refers))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers else http + payload
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> Iterator[tuple[int, dict, bytes]]:
    """(place, header fields, block) of the records of a frame, from ``at`` on."""
    while at < len(data):
        if not data.startswith(b"WARC/1.1\r\n", at):
            raise ValueError(f"no WARC record at {at}")
        end = data.index(b"\r\n\r\n", at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        start, size = end + 4, int(fields["Content-Length"])
        if data[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC record at {at} is cut off")
        yield at, fields, data[start:start + size]
        at = start + size + 4


class Bundle:
    """A bundle in the making: frames as they fill, the seek table last."""

    def __init__(self, file):
        import zstandard
        self.file, self.packer = file, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.plain, self.held, self.frames, self.size = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, place in it) of a record; a frame ends when it has reached its size."""
        if self.held >= FRAME:
            self.flush()
        at = (len(self.frames), self.held)
        self.plain.append(data)
        self.held += len(data)
        return at

    def flush(self) -> None:
        if self.plain:
            packed = self.packer.compress(b"".join(self.plain))
            self.file.write(packed)
            self.frames.append((len(packed), self.held))
            self.size += len(packed)
            self.plain, self.held = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.file.write(struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer)
        self.file.close()


def seek_table(file) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of each frame of an open bundle, from its footer."""
    end = file.size()
    file.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    file.seek(end - 9 - 8 * count)
    sizes = struct.iter_unpack("<II", file.read(8 * count))
    found, at = [], 0
    for packed, plain in sizes:
        found.append((at, packed, plain))
        at += packed
    return found


def frame(file, table: list[tuple[int, int, int]], number: int) -> bytes:
    import zstandard
    at, packed, plain = table[number]
    file.seek(at)
    return zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=max(1, plain))


def _store(folder: str):
    """File system and path of a folder that Spark names (file:, hdfs:, s3a: ... or a plain path)."""
    from pyarrow import fs
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def decided(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` as a written table with row, size, sha1, and the response each row refers to."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    d = written(pages.select("page_id", "url", payload.alias("payload"), F.monotonically_increasing_id().alias("row"),
                             F.octet_length(payload).cast("long").alias("size"), digest(payload).alias("sha1")), "pages")
    # one row per payload that occurs more than once: largest page_id, first row of equal ids
    largest = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", (-F.col("row")).alias("back")))
    copies = d.groupBy("sha1", "size").agg(F.count("*").alias("n"), largest.alias("top")).filter("n > 1").select(
        "sha1", "size", F.col("top.page_id").alias("top_page"), (-F.col("top.back")).alias("top_row"))
    return d.join(copies, ["sha1", "size"], "left")


def archive(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes ``pages`` into bundles in ``folder`` (default: below the shared checkpoint folder).

    The index, a written table: row, page_id, bundle, frame, place (in the frame), length.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = decided(pages).select("row", "page_id", "url", "payload", "sha1", "size", "top_page", "top_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        names, index = ["row", "page_id", "bundle", "frame", "place", "length"], []
        bundle = name = None
        for b in batches:
            for r in b.to_pylist():
                if bundle is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(store.open_output_stream(f"{path}/{name}", compression=None))
                refers = (r["top_page"], r["top_row"]) if r["top_row"] is not None and r["top_row"] != r["row"] else None
                data = record(r["page_id"], r["row"], r["url"], r["payload"], r["sha1"], r["size"], refers)
                index.append((r["row"], r["page_id"], name, *bundle.add(data), len(data)))
                if bundle.size >= BUNDLE:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in index], _INDEX)
            index = []
        if bundle is not None:
            bundle.close()

    out = written(rows.mapInArrow(run, "row long, page_id long, bundle string, frame int, place int, length int"), "index")
    return out.withColumn("bundle", F.concat(F.lit(folder.rstrip("/") + "/"), "bundle"))


_INDEX = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("place", pa.int32()),
                    ("length", pa.int32())])
_READ = pa.schema([("record", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                   ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _row(fields: dict, block: bytes, with_payload: bool) -> dict:
    """A record as a row; a response's payload is held against its digest."""
    sha1, refers = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields.get("WARC-Refers-To")
    payload = None if refers else block[block.index(b"\r\n\r\n") + 4:]
    if payload is not None and (base64.b32encode(hashlib.sha1(payload).digest()).decode() != sha1
                                or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    return {"record": fields["WARC-Record-ID"], "page_id": page_of(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"),
            "payload_bytes": int(fields["X-Payload-Length"]), "payload_digest": sha1, "record_type": fields["WARC-Type"],
            "refers_to": page_of(refers) if refers else None, "payload": payload if with_payload else None}


def _schema(with_payload: bool) -> str:
    return ("record string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
            "payload binary")


def read(bundles: DataFrame, with_payload: bool = False) -> DataFrame:
    """All records of ``bundles(bundle)``, frame by frame; revisits have no payload of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                store, path = _store(name)
                with store.open_input_file(path) as file:
                    table = seek_table(file)
                    for k in range(len(table)):
                        rows = [_row(f, x, with_payload) for _, f, x in parse(frame(file, table, k))]
                        yield pa.RecordBatch.from_pylist(rows, _READ)

    out = bundles.select("bundle").mapInArrow(run, _schema(with_payload))
    return out if with_payload else out.drop("payload")


def lookup(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that a part of the index names, read by seeking: one frame for each frame that holds any of them."""
    places = index.groupBy("bundle", "frame").agg(F.sort_array(F.collect_set("place")).alias("places"))  # at most a frame's records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, number, at in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                store, path = _store(name)
                with store.open_input_file(path) as file:
                    data = frame(file, seek_table(file), number)
                rows += [_row(f, x, with_payload) for p in at for _, f, x in [next(parse(data, p))]]
            yield pa.RecordBatch.from_pylist(rows, _READ)

    return places.select("bundle", "frame", "places").mapInArrow(run, _schema(with_payload))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and reads them back: one row per record."""
    bundles = archive(pages).select("bundle").distinct()
    spark: SparkSession = pages.sparkSession
    return read(bundles.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "bundle"))
