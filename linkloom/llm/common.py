"""What the operators of this package share: shared storage and byte-level word kernels."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the contracts: space and \t \n \v \f \r.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Rows of a few columns that may be broadcast, and parts a hot key is dealt into beyond them.
FEW_ROWS, SALTS = 100_000, 32
#: Rows of a few columns that the driver may hold.
HELD_ROWS = 10_000


#: Paths of the tables that this process has written and not swept.
_WRITTEN: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir. Where it is unset, one of our own on a single machine (tests), else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        where = tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/linkloom"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables materialize() has written so far."""
    return len(_WRITTEN)


def sweep(spark: SparkSession, since: int, keep: int) -> None:
    """Deletes the tables written after the first `since`, but for the last `keep`: for callers that have written all they read."""
    for path in _WRITTEN[since : len(_WRITTEN) - keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN[since : len(_WRITTEN) - keep]


def discard(df: DataFrame) -> None:
    """Deletes what materialize() wrote for df, or for the one written table that df reads; only once nothing reads it any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        if path.getParent().getName() == "linkloom":
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spare(columns: Sequence[str], name: str) -> str:
    """name, with underscores appended until no column is called so (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def settled(df: DataFrame, name: str) -> DataFrame:
    """df computed once: held by the driver if it has at most HELD_ROWS rows, else written; both cut lineage."""
    rows = df.limit(HELD_ROWS + 1).toArrow()
    return df.sparkSession.createDataFrame(rows, df.schema) if rows.num_rows <= HELD_ROWS else materialize(df, name)


def join_hot(left: DataFrame, right: DataFrame, on: Callable[[str, str], Column], how: str = "inner") -> DataFrame:
    """Joins left (alias l), any of whose keys may be hot, with right (alias r, settled or written), one row a key.

    Right is broadcast if it has at most FEW_ROWS rows, counted; else every right row is repeated SALTS
    times and left is dealt over the copies by row number.
    """
    if right.count() <= FEW_ROWS:
        return left.alias("l").join(F.broadcast(right).alias("r"), on("l", "r"), how)
    salt = spare([*left.columns, *right.columns], "salt")
    left = left.withColumn(salt, F.monotonically_increasing_id() % SALTS)
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).cast("long"))
    return left.alias("l").join(right.alias("r"), on("l", "r") & (F.col(f"l.`{salt}`") == F.col(f"r.`{salt}`")), how)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps now: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(run: Callable) -> Callable:
    """A task function that gives its memory back to the system at its end: the Python worker lives on and may idle."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def word_array(text: Column) -> Column:
    """Words of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


# --- byte kernels -----------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_BYTES = np.arange(256, dtype=np.uint8)
LOWER_BYTES[65:91] += 32
_BYTE_LOWER = BYTE_CODES[LOWER_BYTES]
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 64), _MUL)]), dtype=np.uint64)
    return _POWERS


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(seed) * _MUL
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def text_blocks(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts an Arrow string column into runs of whole rows of about limit bytes.

    Yields (first row, row after the last, bytes, offsets); a null counts as an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool, is_word: np.ndarray = _IS_WORD) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a block, and where each text's words begin (one more entry than texts)."""
    inside = is_word[data]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    first = np.empty(len(data) + 1, bool)
    first[1:-1] = inside[1:] & ~inside[:-1]
    first[0] = inside[0]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = inside[cuts]
    first[-1] = False
    begins = np.flatnonzero(first)
    head = np.flatnonzero(first[at])
    lengths = np.diff(np.append(head, len(at)))
    place = np.arange(len(at)) - np.repeat(head, lengths)
    with np.errstate(over="ignore"):
        codes = (_BYTE_LOWER if lower else BYTE_CODES)[data[at]] * powers(int(lengths.max()))[place]
        hashes = mix(np.add.reduceat(codes, head))
    return hashes, np.searchsorted(begins, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its k-word shingles (lower-cased A-Z).

    A text of fewer words gives one hash of the whole sequence, a text without words none.
    """
    words, starts = word_hashes(data, offsets, lower=True)
    n = len(words)
    out = []
    with np.errstate(over="ignore"):
        whole = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k):
            whole += words[j : n - k + 1 + j] * _STEP[j]
        whole = mix(whole, 1)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(whole[a : b - k + 1]))
            elif b > a:
                short = (words[a:b] * _STEP[: b - a]).sum(dtype=np.uint64)
                out.append(mix(np.array([short + np.uint64(b - a)], np.uint64), 2))
            else:
                out.append(whole[:0])
    return out
