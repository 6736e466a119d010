"""What the corpus operators share: the cluster's shared folder, word hashing on Arrow buffers, packed blobs.

Text functions work on the UTF-8 bytes of a whole Arrow batch at once, so a text is never turned into a Python
string only to be split. Word hashes are polynomials modulo 2**64, mixed afterwards.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: Odd multipliers for mixing.
M1, M2, M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Texts and bytes of text that one flush of a mapper holds at most (a longer text is a flush of its own); owners are uint16.
FLUSH_TEXTS, FLUSH_BYTES, HASH_BYTES = 60_000, 4_000_000, 500_000
#: Bytes of an Arrow batch that Spark hands to a Python worker where an operator writes or checkpoints.
ARROW_BYTES = 8_000_000
BASE = 0x2545F4914F6CDD1D | 1

BYTES = np.arange(256, dtype=np.uint8)
SAME = BYTES.copy()
LOWER = BYTES.copy()
LOWER[65:91] += 32
SPACES = np.isin(BYTES, [0x20, 9, 10, 11, 12, 13])
#: What separates the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of a text with A-Z in lower case.
NOT_ALNUM = (BYTES < 0x80) & ~(((BYTES >= 0x30) & (BYTES <= 0x39)) | ((BYTES >= 0x61) & (BYTES <= 0x7A)))


# --- the cluster ---------------------------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset, a local master has a
    default (tests); on a cluster there is none, as each machine would have a folder of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = current.get() if current.isDefined() else None
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "/tmp/docframe-checkpoints"
    return at.rstrip("/")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of ARROW_BYTES at most while a job runs: rows of text or blobs would fill the default's 64 MB, which
    the JVM and the worker hold at once. What the session had set comes back afterwards; only cost depends on it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name)
    spark.conf.set(name, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once, its lineage cut at files in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    with small_batches(df.sparkSession):
        return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docframe/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of any store that Spark can write to."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


# --- words ---------------------------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * M2
    x = (x ^ (x >> U64(27))) * M3
    return x ^ (x >> U64(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers["up"]) < n:
        for k, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            a = np.full(n, b, U64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["up"], _powers["down"]


class Words:
    """The words of some texts: hash, start, end (bytes in data), text, and first (word index of each text, and the end).

    data is the texts' bytes as `case` maps them, `sep` says which bytes separate words. Hashing works through
    HASH_BYTES of text, or one text, at a time. stems: hashes of each word's first bytes, by their number.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, case: np.ndarray, sep: np.ndarray, stems: tuple[int, ...] = ()):
        base = int(offsets[0])
        self.data = case[data[base : int(offsets[-1])]]
        self.offsets = off = offsets.astype(np.int64) - base
        self.n_texts = len(off) - 1
        starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U64)]
        cut: dict[int, list[np.ndarray]] = {k: [np.zeros(0, U64)] for k in stems}
        at = 0
        while at < self.n_texts:
            to = max(int(np.searchsorted(off, off[at] + HASH_BYTES, "right")) - 1, at + 1)
            lo, hi = int(off[at]), int(off[to])
            if hi > lo:
                start, end = _bounds(~sep[self.data[lo:hi]], off[at : to + 1] - lo)
                up, down = powers(hi - lo + 1)
                sums = np.empty(hi - lo + 1, U64)
                sums[0] = 0
                np.cumsum((self.data[lo:hi].astype(U64) + U64(1)) * up[: hi - lo], out=sums[1:])
                hashes.append(mix((sums[end] - sums[start]) * down[start] + M1))
                for k, held in cut.items():
                    held.append(mix((sums[np.minimum(start + k, end)] - sums[start]) * down[start] + U64(k)))
                starts.append(start + lo)
                ends.append(end + lo)
            at = to
        self.start, self.end, self.hash = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
        self.stems = {k: np.concatenate(v) for k, v in cut.items()}
        self.first = np.searchsorted(self.start, off)
        self.text = np.repeat(np.arange(self.n_texts), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


def _bounds(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes; texts end at off."""
    n = len(inside)
    before = np.empty(n, bool)
    before[1:], before[0] = inside[:-1], False
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[:-1], after[-1] = inside[1:], False
    after[off[1:][off[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def folded(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k neighbours of h, in order; len(h) - k + 1 of them."""
    n = max(0, len(h) - k + 1)
    x = h[:n].copy()
    for i in range(1, k):
        x = (x ^ (x >> U64(29))) * M1 + h[i : n + i]
    return mix(x + U64(k))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes before each text, and in all."""
    n = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def trim() -> None:
    """Gives freed memory back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def flushes(batches, text: str, size: int = FLUSH_BYTES):
    """Cuts record batches into slices that hold size bytes of text or one text, so that memory is bounded."""
    for batch in batches:
        off = lengths(batch.column(batch.schema.get_field_index(text)))
        at, n = 0, batch.num_rows
        while at < n:
            to = int(np.searchsorted(off, off[at] + size, "right")) - 1
            to = min(max(to, at + 1), n, at + FLUSH_TEXTS)
            yield batch.slice(at, to - at)
            at = to
        trim()


# --- blobs ---------------------------------------------------------------------------------------------------------


def pack(x: np.ndarray, sorted_: bool = False) -> bytes:
    """x as one compressed value; sorted_: unsigned numbers that never fall are stored as differences."""
    if sorted_:
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T
    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, kind, sorted_: bool = False) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    x = np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).reshape(-1).view(kind)
    return np.cumsum(x, dtype=kind) if sorted_ else x


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    if not len(x):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))


def rows_of(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def buckets(batches):
    """The rows of each bucket, a list at a time, of batches that are sorted by `bucket`; only one bucket is held."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["bucket"] != row["bucket"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def sized(rows: list[dict], schema: pa.Schema, size: int = 8_000_000):
    """Record batches of about size bytes of blobs each."""
    part: list[dict] = []
    held = 0
    for r in rows:
        part.append(r)
        held += 64 + sum(len(v) for v in r.values() if isinstance(v, bytes))
        if held >= size:
            yield rows_of(schema, part)
            part, held = [], 0
    if part:
        yield rows_of(schema, part)
