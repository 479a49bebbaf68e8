"""SHA-256 of files of any size: small ones whole, large ones a stretch per task, the state of the hash carried on."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import Spool, ensure_checkpoint_dir

#: Files up to this size are one value; of larger ones a task hashes about so many bytes.
STRETCH = 128 << 20
#: Bytes of a file in one row on the way.
ROW_BYTES = 1 << 17
#: The line reader unpacks these by their names, so they stay one value.
PACKED = r"\.(gz|bz2|deflate|snappy|lz4|zst)$"
BOM = b"\xef\xbb\xbf"  # the line reader drops it at the start of a file


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file under a path: path, length, sha256.

    A hash is serial, so stretches of a large file follow each other in rounds, all large files at once.
    Their bytes are read as lines and written once to the checkpoint folder.
    """
    files = spark.read.format("binaryFile").load(path)
    long, packed = F.col("length") > STRETCH, F.col("path").rlike(PACKED)
    digest = lambda df: df.select("path", "length", F.sha2("content", 256).alias("sha256"))
    whole = digest(files.where(~long))  # a condition on the length alone keeps the others unread
    kinds = {r[0] for r in files.where(long).select(packed).distinct().collect()}
    if True in kinds:
        names = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,bz2,deflate,snappy,lz4,zst}")
        whole = whole.unionByName(digest(names.load(path).where(long)))
    if False not in kinds:
        return whole
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("bytes"),
    ).where(long & ~packed)
    home = f"{ensure_checkpoint_dir(spark)}/stretches-{uuid.uuid4().hex}"
    rows = lines.mapInArrow(_pack, "path string, length bigint, start bigint, nth int, n bigint, bytes binary").withColumn(
        "round", F.expr(f"start div {STRETCH}").cast("int"))
    # small row groups: rows are long, and readers take a group's rows together
    rows.write.partitionBy("round").option("parquet.block.size", 16 << 20).option("compression", "uncompressed").parquet(home)
    rows = spark.read.schema(rows.schema).parquet(home)
    sizes = rows.groupBy("path", "length").agg((F.col("length") - F.sum("n")).alias("lacks"))
    state = sizes.select("path", "length", F.lit(-1).cast("bigint").alias("start"), F.lit(0).alias("nth"),
                         F.when(F.col("lacks") >= 2, F.lit(BOM)).otherwise(F.lit(b"")).alias("bytes"))
    rounds = rows.agg(F.max("round")).first()[0] + 1
    done = Spool(spark)
    for k in range(rounds):
        here = rows.where(F.col("round") == k).drop("round", "n").unionByName(state)
        step = _first if k == 0 else _next
        state = done.append(here.repartition("path").sortWithinPartitions("path", "start", "nth").mapInArrow(step, state.schema))
    named = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # the metadata column escapes names
    return whole.unionByName(state.mapInArrow(_last, "path string, length bigint, sha256 string").withColumn("path", named))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of one stretch of a file, in the order read, joined to rows; the last line gets an end of its own too."""
    key, held, n, nth = None, [], 0, 0

    def row():
        return pa.RecordBatch.from_pydict({
            "path": [key[0]], "length": [key[1]], "start": [key[2]], "nth": pa.array([nth], pa.int32()),
            "n": [n], "bytes": [b"".join(held)]})

    for batch in batches:
        for *at, line in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if at != key or n >= ROW_BYTES:
                if held:
                    yield row()
                held, n, nth = [], 0, nth + 1 if at == key else 0
                key = at
            held += (line, b"\n")
            n += len(line) + 1
    if held:
        yield row()


class _Sha256:
    """OpenSSL's SHA-256, whose state is plain memory: 8 bytes of count, then its context."""

    SIZE = 112

    def __init__(self, state: bytes | None = None):
        import _hashlib

        self.lib = ctypes.CDLL(_hashlib.__file__)  # finds the library that hashlib itself is linked with
        self.context = ctypes.create_string_buffer(state[8:] if state else self.SIZE, self.SIZE)
        self.count = int.from_bytes(state[:8], "little") if state else 0
        if not state:
            self.lib.SHA256_Init(self.context)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.context, data, ctypes.c_size_t(len(data)))
        self.count += len(data)

    def state(self) -> bytes:
        return self.count.to_bytes(8, "little") + self.context.raw

    def hexdigest(self) -> str:
        out = ctypes.create_string_buffer(32)
        self.lib.SHA256_Final(out, self.context)
        return out.raw.hex()


def _states(batches: Iterator[pa.RecordBatch], fresh: bool) -> Iterator[pa.RecordBatch]:
    """The state of each file after its rows; the row before all others holds the state so far, at first the bytes lost."""
    path = length = sha = None

    def out():
        return pa.RecordBatch.from_pydict({"path": [path], "length": [length], "start": pa.array([-1], pa.int64()),
                                           "nth": pa.array([0], pa.int32()), "bytes": [sha.state()]})

    for batch in batches:
        for p, size, start, _, data in zip(*(c.to_pylist() for c in batch.columns)):
            if p != path:
                if sha:
                    yield out()
                if start != -1:
                    raise ValueError(f"no state for {p}")
                path, length, sha = p, size, _Sha256(None if fresh else data)
                if fresh:
                    sha.update(data)
            else:
                sha.update(data[:length - sha.count])  # the end of a last line that the file does not have
    if sha:
        yield out()


def _first(batches):
    return _states(batches, True)


def _next(batches):
    return _states(batches, False)


def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = []
        for path, length, state in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "bytes"))):
            sha = _Sha256(state)
            if sha.count != length:
                raise ValueError(f"{path}: {sha.count} of {length} bytes were read")
            sums.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(sums, pa.string())], ["path", "length", "sha256"])
