"""Web archives as seekable Zstandard bundles with an index from record to place.

A bundle is a file of independent Zstandard frames, each of whole WARC records,
and a last, skippable frame with the seek table: compressed and full size of each
frame. Any Zstandard tool reads a bundle from its start; with the seek table and
the index one record costs one frame. Tasks write bundles to the folder that all
executors share; a bundle's name is new in each attempt of a task, and only the
index rows of attempts that ended name it, so a lost executor leaves at most a
file that nothing refers to.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path
from .shared import join_groups, table, written

FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 256 << 20
#: Payloads of fewer bytes are always stored.
LEAST_REVISIT = 100
#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "record_id string, page_id long, bundle string, frame long, frame_at long, frame_bytes long, offset long, length long"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def revisits(pages: DataFrame) -> DataFrame:
    """``pages`` with ``payload``, ``payload_digest``, ``payload_bytes`` and ``refers_to``.

    Of rows with equal payloads of at least LEAST_REVISIT bytes those of the
    smallest page_id are stored, and the others refer to it. Rows that share that
    page_id are all stored; so are groups without any page_id. A row without a
    page_id refers to the group's smallest one. A null html counts as empty.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]", " ").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")})
    keys = rows.where(F.col("payload_bytes") >= LEAST_REVISIT).select("payload_digest", "page_id")
    groups = keys.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("owner")).where("n > 1 and owner is not null")
    groups = written(groups, "payloads")
    total = groups.agg(F.sum("n")).first()[0]
    if not total:
        return rows.withColumn("refers_to", F.lit(None).cast("long"))
    met = join_groups(rows, groups, ["payload_digest"], "owner", deal="page_id", total=total, outer=True)
    return met.withColumn("refers_to", F.when(F.col("owner").isNull() | F.col("page_id").eqNullSafe(F.col("owner")), F.lit(None)).otherwise(F.col("owner"))).drop("owner")


def record_bytes(record_id: str, page_id, url: str, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    """One WARC record; a revisit has no body."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id}>", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"Page-ID: {'' if page_id is None else page_id}", f"Payload-Length: {size}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"Refers-To-Page: {refers_to}"]
        payload = b""
    head = "\r\n".join([*lines, "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""])
    return head.encode() + payload + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The header fields and body of the record at ``at``, and where the next one starts."""
    body = data.index(b"\r\n\r\n", at) + 4
    first, *lines = data[at : body - 4].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    fields = {k.lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    end = body + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} has no end")
    return fields, data[body:end], end + 4


def opened(path: str):
    """File system and path of a URI, for files that tasks write and read themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable last frame: compressed and full size of each frame, then the footer."""
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE)


def read_seek_table(path: str) -> list[tuple[int, int, int]]:
    """Start, compressed size and full size of each frame of a bundle."""
    system, name = opened(path)
    with system.open_input_file(name) as file:
        size = file.size()
        file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        file.seek(size - 9 - 8 * count)
        sizes = list(struct.iter_unpack("<II", file.read(8 * count)))
    out, at = [], 0
    for packed, full in sizes:
        out.append((at, packed, full))
        at += packed
    return out


class _Bundle:
    """A file that is being written: full frames go out, the seek table follows at the end."""

    def __init__(self, folder: str):
        import zstandard

        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        system, name = opened(self.path)
        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
        self.file, self.pack = system.open_output_stream(name, compression=None), zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.sizes, self.at, self.held, self.held_bytes, self.places = [], 0, [], 0, []

    def add(self, record_id: str, page_id, data: bytes) -> list[tuple]:
        self.places.append((record_id, page_id, self.held_bytes, len(data)))
        self.held.append(data)
        self.held_bytes += len(data)
        return self.flush() if self.held_bytes >= FRAME_BYTES else []

    def flush(self) -> list[tuple]:
        """Writes the records held as one frame; returns their index rows."""
        if not self.held:
            return []
        packed = self.pack.compress(b"".join(self.held))
        self.file.write(packed)
        rows = [(i, p, self.path, len(self.sizes), self.at, len(packed), o, n) for i, p, o, n in self.places]
        self.sizes.append((len(packed), self.held_bytes))
        self.at += len(packed)
        self.held, self.held_bytes, self.places = [], 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        self.file.write(seek_table(self.sizes))
        self.file.close()
        return rows


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("bundle", pa.string()), *[(n, pa.int64()) for n in ("frame", "frame_at", "frame_bytes", "offset", "length")]])
_RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def write_bundles(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a WARC record for each row of ``pages`` (page_id, url, html) to bundles in ``folder`` and returns the index.

    Any further columns are left aside. Nulls: see ``revisits``; a null url is
    an empty one. A payload longer than FRAME_BYTES makes a frame of its own with
    what was held before. A task holds one frame. An empty table gives an empty
    index and no bundle. The index is a table in the shared folder.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "bundles")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                if bundle is None:
                    bundle = _Bundle(folder)
                page_id, url, payload, digest, size, refers_to = (c[k].as_py() for c in batch.columns)
                record_id = uuid.uuid4().urn
                rows += bundle.add(record_id, page_id, record_bytes(record_id, page_id, url, digest, size, refers_to, payload))
                if bundle.at >= BUNDLE_BYTES:
                    rows += bundle.close()
                    bundle = None
            if rows:
                yield _batch(rows, _INDEX)
        if bundle is not None and (rows := bundle.close()):
            yield _batch(rows, _INDEX)

    rows = revisits(pages).select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to")
    return written(rows.mapInArrow(write, INDEX), "warc-index")


def _record(fields: dict[str, str], body: bytes) -> tuple:
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(fields["payload-length"])):
        raise ValueError(f"{fields['warc-record-id']}: the body doesn't match its digest")
    whole = lambda name: int(fields[name]) if fields.get(name) else None
    return fields["warc-record-id"].strip("<>"), whole("page-id"), fields["warc-target-uri"], kind, whole("refers-to-page"), digest, whole("payload-length"), body if kind == "response" else None


def _frames(path: str, places: list[tuple[int, int]]) -> Iterator[bytes]:
    import zstandard

    system, name = opened(path)
    with system.open_input_file(name) as file:
        for at, size in places:
            file.seek(at)
            yield zstandard.ZstdDecompressor().decompress(file.read(size))


def read_bundles(spark: SparkSession, index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the index's bundles, frame by frame as the seek tables tell; each stored body is held against its digest."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last in zip(*(batch.column(c).to_pylist() for c in ("bundle", "first", "last")), strict=True):
                for data in _frames(path, [(at, size) for at, size, _ in read_seek_table(path)[first : last + 1]]):
                    at, rows = 0, []
                    while at < len(data):
                        fields, body, at = parse_record(data, at)
                        record = _record(fields, body)
                        rows.append(record if payloads else (*record[:-1], None))
                    yield _batch(rows, _RECORD)

    runs = index.groupBy("bundle", F.expr("frame div 16").alias("run")).agg(F.min("frame").alias("first"), F.max("frame").alias("last")).drop("run")
    return runs.repartition(F.col("bundle"), F.col("first")).mapInArrow(read, RECORD)


def fetch(index: DataFrame, wanted: DataFrame, key: str = "page_id") -> DataFrame:
    """The records of the index whose ``key`` (page_id or record_id) is in ``wanted``: one frame is read for all that it holds, and bodies are cut at their offsets."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at, size, places in zip(*(batch.column(c).to_pylist() for c in ("bundle", "frame_at", "frame_bytes", "places")), strict=True):
                data = next(_frames(path, [(at, size)]))
                yield _batch([_record(*parse_record(data, p["offset"])[:2]) for p in places], _RECORD)

    found = index.join(wanted.select(key).distinct(), key, "left_semi")
    frames = found.groupBy("bundle", "frame_at", "frame_bytes").agg(F.collect_list(F.struct("offset")).alias("places"))
    return frames.mapInArrow(read, RECORD)


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to bundles and read back."""
    index = write_bundles(table(spark, sf_dir, "pages"))
    return read_bundles(spark, index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
