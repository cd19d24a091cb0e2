"""Media columns: content-addressed payloads in tar shards.

Writing: each task turns its rows' payloads into lossless 8-bit grey PNG
images and appends them to its own tar shards, one member a digest, named by
the SHA-256 of the payload.  A row then carries digest, shard, offset and
length; no payload is shuffled.  A shard appears under its final name only
when it is complete, and the name and the bytes depend on the partition
alone, so a task that runs again replaces equal with equal.

Index: one location for each digest (the first of its locations).  Metadata
columns are filled from reads of the image header alone; payload features
from range reads of the member.

Payload of a text: its UTF-8 bytes (null: none) and zero bytes up to a
positive multiple of 64, as rows of 64 samples.  Equal texts give equal
values.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm._shared import bounded_batches, materialize, with_totals, workspace
from varloom.llm.bpe import small_batches

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"  # fixed value: the format's first bytes
HEADER_BYTES = 33  # signature and the header chunk


def payload(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def to_png(samples: bytes) -> bytes:
    """An 8-bit grey image whose samples are these bytes, 64 in a row."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line begins with filter 0
    lines[:, 1:] = rows
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not an image of this format")
    return struct.unpack(">IIBB", head[16:26])


def from_png(image: bytes) -> bytes:
    width, height, depth, colour = png_header(image)
    if (depth, colour) != (8, 0):
        raise ValueError("not 8-bit grey")
    at, data = 8, []
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("only filter 0 is written here")
    return lines[:, 1:].tobytes()


def feature(samples: bytes) -> str:
    """Exact statistics of the samples: count, sum, sum of squares, distinct values, commonest value."""
    n = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    v = np.arange(256)
    return f"n={int(n.sum())};sum={int((n * v).sum())};sq={int((n * v * v).sum())};distinct={int((n > 0).sum())};mode={int(n.argmax())}"


class _Files:
    """Files of one folder, wherever it lies; open handles are reused."""

    def __init__(self, folder: str):
        from pyarrow import fs

        self.fs, self.base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        self.opened: dict[str, object] = {}

    def read(self, name: str, at: int, n: int) -> bytes:
        if name not in self.opened:
            if len(self.opened) >= 8:
                self.opened.pop(next(iter(self.opened))).close()
            self.opened[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.opened[name].read_at(n, at)


class _Shard:
    """A tar file under a name of this attempt; `close` gives it its final name."""

    def __init__(self, files: _Files, name: str, attempt: int):
        self.files, self.name, self.at = files, name, 0
        self.part = f"{files.base}/.{name}.{attempt}"
        self.out = files.fs.open_output_stream(self.part)

    def add(self, member: str, data: bytes) -> int:
        info = tarfile.TarInfo(member)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT if len(data) < 8 << 30 else tarfile.GNU_FORMAT)
        self.out.write(head + data + bytes(-len(data) % 512))
        offset = self.at + len(head)
        self.at = offset + len(data) + -len(data) % 512
        return offset

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()
        final = f"{self.files.base}/{self.name}"
        if self.files.fs.get_file_info(final).is_file:  # an earlier attempt has written the same bytes
            self.files.fs.delete_file(self.part)
        else:
            self.files.fs.move(self.part, final)


ROW = [("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("digest", T.StringType()), ("shard", T.StringType()), ("offset", T.LongType()), ("length", T.LongType())]


def store(df: DataFrame, folder: str, text: str = "text", *, shard_bytes: int = 256 << 20) -> DataFrame:
    """Write the payloads below `folder`; rows keep their other columns and gain n_bytes, payload_bytes, digest, shard, offset, length.

    The result is written once in the shared folder, so the shards are written once.
    """
    bounded_batches(df.sparkSession)
    added = {n for n, _ in ROW}
    keep = [f for f in df.schema.fields if f.name != text and f.name.lower() not in added]
    schema = T.StructType([*keep, *(T.StructField(n, t) for n, t in ROW)])
    names = [f.name for f in keep]
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        files, shard, count = _Files(folder), None, 0
        where: dict[str, tuple[str, int, int]] = {}  # digests in the open shard
        for b in small_batches(batches, 128):
            rows = []
            for t in b.column(text).to_pylist():
                n, data = payload(t)
                digest = hashlib.sha256(data).hexdigest()
                if digest not in where:
                    if shard is None or shard.at >= shard_bytes:
                        if shard:
                            shard.close()
                        shard = _Shard(files, f"shard-{task.partitionId():06d}-{count:05d}.tar", task.taskAttemptId())
                        count += 1
                        where = {}
                    image = to_png(data)
                    where[digest] = (shard.name, shard.add(f"{digest}.png", image), len(image))
                rows.append((n, len(data), digest, *where[digest]))
            cols = zip(*rows, strict=True) if rows else [[]] * len(ROW)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=schema.names)
        if shard:
            shard.close()

    return materialize(df.mapInArrow(run, schema), "media-rows")


def index(rows: DataFrame) -> DataFrame:
    """One row a digest: the first place where it is stored, in the order of the shards, and how many rows hold it (n)."""
    return rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("_at"), F.count(F.lit(1)).alias("n")).select("digest", "_at.*", "n").repartitionByRange("shard", "offset")


def compact(rows: DataFrame, folder: str, target: str, *, shard_bytes: int = 256 << 20) -> DataFrame:
    """Copy one member a digest into new shards below `target`: digest, shard, offset, length.

    `store` writes a payload once a shard, so copies that lie in different
    input partitions are stored in several shards; this leaves one of each.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    schema = T.StructType([T.StructField("digest", T.StringType()), *(T.StructField(n, t) for n, t in ROW[3:])])

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        old, new, shard, count = _Files(folder), _Files(target), None, 0
        for b in batches:
            done = []
            for digest, name, at, n in zip(*(b.column(c).to_pylist() for c in schema.names), strict=True):
                if shard is None or shard.at >= shard_bytes:
                    if shard:
                        shard.close()
                    shard = _Shard(new, f"shard-{task.partitionId():06d}-{count:05d}.tar", task.taskAttemptId())
                    count += 1
                done.append((digest, shard.name, shard.add(f"{digest}.png", old.read(name, at, n)), n))
            cols = zip(*done, strict=True) if done else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=schema.names)
        if shard:
            shard.close()

    places = materialize(index(rows), "media-index").sortWithinPartitions("shard", "offset")
    return materialize(places.mapInArrow(run, schema), "media-places")


def fill_metadata(places: DataFrame, folder: str) -> DataFrame:
    """Add width, height, bit_depth and colour_type; only the members' headers are read."""
    more = [("width", T.LongType()), ("height", T.LongType()), ("bit_depth", T.IntegerType()), ("colour_type", T.IntegerType())]
    schema = T.StructType([*places.schema.fields, *(T.StructField(n, t) for n, t in more)])

    def run(batches):
        files = _Files(folder)
        for b in batches:
            got = [png_header(files.read(s, o, HEADER_BYTES)) for s, o in zip(b.column("shard").to_pylist(), b.column("offset").to_pylist(), strict=True)]
            cols = zip(*got, strict=True) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True))], names=schema.names)

    return places.mapInArrow(run, schema)


def read_features(places: DataFrame, folder: str) -> DataFrame:
    """Add what a read of the whole member gives: media_sha256, payload_sha256, tail_crc32, feature."""
    more = [("media_sha256", T.StringType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("feature", T.StringType())]
    schema = T.StructType([*places.schema.fields, *(T.StructField(n, t) for n, t in more)])

    def run(batches):
        files = _Files(folder)
        for b in batches:
            got = []
            for s, o, n, digest in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "digest")), strict=True):
                image = files.read(s, o, n)
                data = from_png(image)
                sha = hashlib.sha256(data).hexdigest()
                if sha != digest:
                    raise ValueError(f"{s} at {o} does not hold {digest}")
                got.append((hashlib.sha256(image).hexdigest(), sha, zlib.crc32(data[-64:]), feature(data)))
            cols = zip(*got, strict=True) if got else [[]] * 4
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True))], names=schema.names)

    return places.mapInArrow(run, schema)


def media_columns(df: DataFrame, text: str = "text", folder: str | None = None) -> DataFrame:
    """Store the payloads of `text`, read them back once a digest, join the values to the rows.

    Columns of `df` with the names of the results are replaced.
    """
    folder = folder or workspace(df.sparkSession, "media")
    rows = store(df, folder, text)
    seen = read_features(fill_metadata(index(rows), folder), folder)
    added = {c.lower() for c in seen.columns} - {"digest", "n"}
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c.lower() not in added])
    if "n" in {c.lower() for c in rows.columns}:  # a column of the caller's
        held = rows.select("digest", F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "digest"]).alias("_row"))
        out = with_totals(held, seen, "digest", rows.count())
        return out.select("digest", *[F.col(f"_row.`{c}`") for c in rows.columns if c != "digest"], *[F.col(c) for c in seen.columns if c not in ("digest", "n")])
    return with_totals(rows, seen, "digest", rows.count()).drop("n")
