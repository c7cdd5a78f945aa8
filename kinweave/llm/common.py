"""Helpers shared by the corpus operators: tables, checkpoints and byte-level text arithmetic."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space, and \t \n \v \f \r.
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that all nodes share. Where none is set, a temporary one in local mode (tests);
    an error on a cluster, whose nodes would not see it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kinweave-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that later steps do not compute it again
    and an executor that is lost takes nothing with it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a compressed table in the shared folder, and the table's path, for ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return spark.read.parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that ``stored`` has written and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a narrow table of keys that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def few(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, marked for broadcast if a count shows that they are few. Counted tables are written first."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= most else keys


def fresh(df: DataFrame, *wanted: str):
    """Column names that ``df`` does not have, whatever the case: one for each wanted one."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        name = f"_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else out


#: Arrow batches of texts are kept small: a worker holds a few copies of one.
BATCH_ROWS, BATCH_BYTES = "1000", "4m"


def trimmed() -> None:
    """Gives memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def _frugal(run):
    """A worker that gives memory back: large arrays are mapped one by one, the rest is trimmed at
    the end. Workers are reused, so what one keeps adds to what the next step needs."""

    def wrapped(batches):
        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow`` with small batches and frugal workers."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(_frugal(run), schema)


def word_count(text) -> F.col:
    """Number of words in a text column; null counts 0. Stays inside generated JVM code."""
    t = F.coalesce(text, F.lit(""))
    # one separator before each word start: count the starts by what remains of "x" marks
    return F.length(F.regexp_replace(F.regexp_replace(t, WORD, "x"), r"[\x20\x09-\x0D]", "")).cast("long")


# ---------------------------------------------------------------- bytes of an Arrow string column


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(data uint8, offsets int64) of an Arrow string column, nulls as empty strings."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if arr.null_count:
        arr = arr.fill_null("")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int):
    """Row ranges (a, b) of about ``size`` bytes each; one long text makes a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


# ---------------------------------------------------------------- word and shingle hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=2)
def _byte_values(lower: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    if lower:
        v[65:91] = v[97:123]
    return v


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def word_spans(data: np.ndarray, offsets: np.ndarray, is_sep: np.ndarray = _IS_SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-text word offsets of the words in consecutive texts."""
    n = len(data)
    sep = np.ones(n + 1, bool)
    sep[:n] = is_sep[data]
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    inside = ~sep[:n]
    starts = inside.copy()
    starts[1:] &= sep[: n - 1] | begins[1:n]
    ends = inside
    ends &= sep[1:] | begins[1:]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True, is_sep: np.ndarray = _IS_SEP) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and per-text word offsets. A-Z count as a-z with ``lower``."""
    s, e, per = word_spans(data, offsets, is_sep)
    up, down = _power_tables(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_byte_values(lower)[data] * up[: len(data)], out=c[1:])
    return mix((c[e] - c[s]) * down[s] + (e - s).astype(np.uint64)), per


def shingle_hashes(words: np.ndarray, per: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles of each text, repeats included, and per-text offsets.
    A text of 1 to k-1 words has its whole sequence as its one shingle."""
    count = np.diff(per)
    shingles = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    out_off = np.concatenate([[0], np.cumsum(shingles)])
    factors = [np.uint64(x) for x in mix(np.arange(11, 11 + k, dtype=np.uint64))]
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64), out_off
    padded = np.concatenate([words, np.zeros(k - 1, np.uint64)])
    total = padded[:n] * factors[0]
    for i in range(1, k):
        total += padded[i : i + n] * factors[i]
    first = np.repeat(per[:-1], shingles) + (np.arange(out_off[-1]) - np.repeat(out_off[:-1], shingles))
    out = total[first]
    for d in np.flatnonzero((count > 0) & (count < k)):
        w = words[per[d] : per[d + 1]]
        with np.errstate(over="ignore"):
            out[out_off[d]] = sum((x * f for x, f in zip(w, factors)), np.uint64(0)) + np.uint64(0xA5A5 + len(w))
    return mix(out), out_off
