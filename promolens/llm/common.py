"""Helpers shared by the corpus operators.

``shared_table`` cuts lineage with a table written under the cluster's
``spark.checkpoint.dir`` (a lost executor then costs a re-read).
``small_side`` is the only way the operators broadcast a frame: its rows are
counted first, and beyond the bound the frame goes back unhinted, so Spark
joins by shuffle.

The numpy part works on whole Arrow batches without making Python strings:
``Words`` finds the words ``[^\\x20\\x09-\\x0D]+`` of a block of texts and gives each a
64-bit hash.  Blocks are cut by bytes, so a task's memory is bounded by
``BLOCK_BYTES`` or by its longest single text, whichever is larger.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.session import scratch_path

BLOCK_BYTES = 1 << 21
U = np.uint64
# fixed odd multipliers of the polynomial hashes and the 64-bit finaliser
P1, P2 = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
M1, M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)

def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a ``shared_table`` that nothing will read again (all
    that was computed from it is written).  Does nothing where the session gives
    no access to the store."""
    path, jvm = getattr(df, "_shared_path", None), getattr(df.sparkSession, "_jvm", None)
    if path and jvm is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_side(df: DataFrame, max_rows: int = 500_000, lists: str | None = None) -> DataFrame:
    """``df`` hinted for broadcast when it has at most ``max_rows`` narrow rows,
    else ``df`` itself.  Where each row holds a list, ``lists`` names it and its
    entries are counted instead.  Give it a written table: it is counted."""
    if lists:
        few = (df.agg(F.sum(F.size(lists))).first()[0] or 0) <= max_rows
    else:
        few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def workers_import(spark: SparkSession) -> None:
    """This library's folder on the workers' path, for sessions that were started
    elsewhere without installing it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = getattr(getattr(spark, "_sc", None), "environment", None)
    if env is not None and root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` on workers that can import this library."""
    workers_import(df.sparkSession)
    return df.mapInArrow(run, schema)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text column as an array (null text: none).

    Splitting at one plain character is much faster than at a pattern, so the
    rarer white space is turned into spaces first, where there is any."""
    text = F.coalesce(text, F.lit(""))
    rare = text.contains("\t") | text.contains("\x0b") | text.contains("\x0c") | text.contains("\r")
    text = F.when(rare, F.regexp_replace(text, r"[\x09\x0B-\x0D]", " ")).otherwise(text)
    return F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " "), "")


def paired(hashes: Column, step: int) -> Column:
    """Hash of each element with the one ``step`` places on; ``step`` fewer elements.
    ``hashes`` should be a plain column: it is evaluated three times."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, 1, n), F.slice(hashes, 1 + step, n), lambda x, y: F.xxhash64(x, y))


# --- numpy over Arrow ------------------------------------------------------------

def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (a bijection)."""
    h = h ^ (h >> U(30))
    h *= M1
    h ^= h >> U(27)
    h *= M2
    h ^= h >> U(31)
    return h


def powers(n: int, p: np.uint64 = P1) -> np.ndarray:
    """p**0 .. p**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), p, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into blocks of about ``limit`` bytes: (first row,
    end row, bytes, offsets); a null is an empty text."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    col = col.cast(pa.large_binary()) if len(col) else pa.array([], pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if len(col) and bufs[2] is not None else np.zeros(0, np.uint8)
    a, n = 0, len(col)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a]:offs[b]], offs[a:b + 1] - offs[a]
        a = b


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """Words of a block of texts: ``start`` (byte), ``hash`` (64 bits) and
    ``first`` (index of each text's first word, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        n = len(data)
        if lower and n:
            data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
        word = ~_SPACE[data]
        begins = word.copy()
        if n:
            begins[1:] &= ~word[:-1]
            at = offsets[:-1]
            at = at[at < n]
            begins[at] = word[at]
        self.start = np.flatnonzero(begins)
        self.first = np.searchsorted(self.start, offsets)
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        gaps = np.diff(np.append(self.start, n))
        place = np.arange(self.start[0], n) - np.repeat(self.start, gaps)
        power = powers(int(gaps.max()) + 1)
        part = (data[self.start[0]:].astype(np.uint64) + U(1)) * power[place]
        part[~word[self.start[0]:]] = 0
        self.hash = mix(np.add.reduceat(part, self.start - self.start[0]))


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k``-word shingles of one text's word hashes, repeats
    included; with fewer words the whole sequence is one shingle."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    m = min(k, n)
    h = np.full(n - m + 1, U(m), dtype=np.uint64)
    for j in range(m):
        h = mix(h * P2 + words[j:n - m + 1 + j])
    return h


SLICES = 64


def summed_vectors(df: DataFrame, size: int, vector: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray:
    """Sum over all tasks of ``vector(batches)``, ``size`` doubles each (or None).

    Every task sends ``SLICES`` rows; each slice is added up in a stream by one
    task, so the driver receives ``size`` numbers whatever the input."""
    width = -(-size // SLICES)
    schema = "slice int, part binary"

    def rows(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.tobytes() for x in parts.values()], pa.binary())], names=["slice", "part"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = vector(batches)
        if total is not None:
            total = np.concatenate([total.astype(np.float64), np.zeros(width * SLICES - size)])
            yield rows({i: total[i * width:(i + 1) * width] for i in range(SLICES)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(x.as_buffer(), np.float64)
                sums[i] = sums[i] + part if i in sums else part.copy()
        yield rows(sums)

    out = np.zeros(width * SLICES)
    for i, x in arrow_map(arrow_map(df, count, schema).repartition(SLICES, "slice"), add, schema).collect():   # SLICES rows
        out[i * width:(i + 1) * width] = np.frombuffer(bytes(x), np.float64)
    return out[:size]


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1024) -> float | None:
    """The ``k``-th largest value of a double column (the least one when there are
    fewer; None without rows), by counting in ever finer bins: each pass brings
    at most ``bins`` rows to the driver."""
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k < 1:
        return None
    k = min(k, n)
    while low < high:
        step = (high - low) / bins
        if step <= 0 or low + step == low:
            step = high - low
        place = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.lit(low)) / F.lit(step)))
        inside = df.where(F.col(column).between(low, high)).groupBy(place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(inside.collect(), key=lambda r: -r["bin"]):
            if r["n"] >= k:
                break
            k -= r["n"]
        if (r["low"], r["high"]) == (low, high):            # two neighbouring doubles: no bin lies between
            return high if df.where(F.col(column) == high).count() >= k else low
        low, high = r["low"], r["high"]
    return low
