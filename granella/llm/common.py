"""Arrow-buffer helpers shared by the operators of this subpackage.

Text columns arrive in Python as Arrow buffers. The helpers work on the raw
UTF-8 bytes with numpy, so no Python string is built per word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Settings that hold while a table is written: shuffle files go afterwards, and Arrow batches are small, since text rows are large.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
_powers: dict[str, np.ndarray] = {}

#: Bytes of text that one numpy step handles at once; longer texts go alone.
CHUNK_BYTES = 2 << 20


def crc_bucket(doc_id: Column | str = "doc_id") -> Column:
    """crc32 of the id as text, mod 4."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """True where the remainder is 2; false for a null id."""
    return F.coalesce(crc_bucket(doc_id) == 2, F.lit(False))


def stage_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of the session (spark.checkpoint.dir), or /tmp in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_dir(spark)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"/tmp/checkpoints/{os.getpid()}"


def written(df: DataFrame, name: str, tasks_per_slot: int = 0) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives the loss of executors.

    The shuffle files behind it are removed once it is written. With
    tasks_per_slot, it is written by so many tasks for each slot of the cluster
    at most, each taking whole partitions one after the other, so that tables of
    links don't fall apart into a file for each shuffle partition.
    """
    if tasks_per_slot:
        df = df.coalesce(tasks_per_slot * df.sparkSession.sparkContext.defaultParallelism)
    spark, path = df.sparkSession, stage_dir(df.sparkSession, name)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more; what is left goes when the driver ends."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            folder, files = _folder(t.sparkSession, path)
            files.delete(folder, True)


@contextlib.contextmanager
def without_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Joins of what is written here are dealt by key. Small sides would be fetched and hashed by the driver, which keeps a thread and buffers for each."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k in names:
            spark.conf.set(k, "-1")
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage, and so let go of plans, broadcasts and shuffles of the steps before; else its heap grows to its limit first."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_name(columns: list[str], name: str) -> str:
    """name, with so many underscores that no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB for this session, unless another size was set: rows of text are large, and both sides hold whole batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(name, "8m")


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len+1 offsets of a text column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, one row at least."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        size = max(n, 1 << 16)
        for key, base in (("p", _BASE), ("q", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["p"][:n], _powers["q"][:n]


#: Byte table that lower-cases A-Z and blanks every other ASCII character but digits and a-z.
PLAIN = _LOWER.copy()
PLAIN[[c for c in range(128) if not (48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123)]] = 0x20


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = _LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of every row, bytes turned by the table (A-Z lower-cased), words ended by ASCII white space.

    Returns hashes, byte starts, byte ends and, for each row, where its words begin (rows + 1 numbers).
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, U64), z, z, np.zeros(len(offsets), np.int64)
    low = table[data]
    gap = _SPACE[low]
    before = np.empty(n, bool)
    before[1:] = gap[:-1]
    before[0] = True
    after = np.empty(n, bool)
    after[:-1] = gap[1:]
    after[-1] = True
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = True
    after[inner - 1] = True
    ws = np.flatnonzero(before & ~gap)
    we = np.flatnonzero(after & ~gap) + 1
    p, q = _power(n)
    acc = np.empty(n + 1, U64)
    acc[0] = 0
    np.cumsum((low.astype(U64) + U64(1)) * p, out=acc[1:])
    h = (acc[we] - acc[ws]) * q[ws]
    h = mix(h ^ ((we - ws).astype(U64) * U64(0xD6E8FEB86659FD93)))
    return h, ws, we, np.searchsorted(ws, offsets)


_STEP = [U64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def _coefficient(j: int) -> np.uint64:
    return U64((int(_STEP[j % 5]) * (2 * (j // 5) + 1)) & (2**64 - 1))


def ngram_hashes(words: np.ndarray, bounds: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs of each row, and len+1 bounds. With short, a row of 1 to n-1 words gives one run of all."""
    counts = np.diff(bounds)
    out = np.maximum(counts - n + 1, 0)
    m = len(words) - n + 1
    full = np.zeros(max(m, 0), U64)
    for j in range(n):
        if m > 0:
            full += words[j : j + m] * _coefficient(j)
    full = mix(full)
    keep = np.zeros(max(m, 0), bool)
    if m > 0:
        row = np.repeat(np.arange(len(counts)), counts)
        keep = row[:m] == row[n - 1 :]
    if not short or not ((counts > 0) & (counts < n)).any():
        b = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(out, out=b[1:])
        return full[keep], b
    small = (counts > 0) & (counts < n)
    b = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(out + small, out=b[1:])
    got = np.empty(b[-1], U64)
    mask = np.ones(b[-1], bool)
    mask[b[:-1][small]] = False
    got[mask] = full[keep]
    for r in np.flatnonzero(small):
        w = words[bounds[r] : bounds[r + 1]]
        s = sum(int(x) * int(_coefficient(j)) for j, x in enumerate(w)) + len(w) * 0x2545F4914F6CDD1D
        got[b[r]] = mix(np.array([s & (2**64 - 1)], U64))[0]
    return got, b


def pack(x: np.ndarray) -> bytes:
    """Ascending numbers as compressed planes of the bytes of their differences."""
    d = np.diff(x, prepend=U64(0))
    return pa.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def unpack(b: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(b, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view(U64).ravel(), dtype=U64)


def trim() -> None:
    """Gives freed memory of this worker back to the system, where the C library can; workers live on between tasks."""
    _powers.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function for mapInArrow that gives freed memory back when its task ends."""

    def tidied(batches):
        yield from run(batches)
        trim()

    return tidied


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 with the same bits."""
    return x.view(np.int64)
