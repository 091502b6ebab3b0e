"""Operator 11: best-two-fit packing of tokenised documents into sequences.

1. Pieces.  Every text becomes token ids and one end id; only what is longer than a
   sequence is cut.  Tokens never cross white space nor the border of a word and its
   mark, so a task encodes each different word once and lays the ids of a block of
   texts out with numpy.
2. Plan.  What a packing looks like depends on the piece lengths alone, and there
   are at most ``capacity`` different ones: their counts (one row a length) are all
   that reaches the driver.  ``best_two_fit`` fills one sequence after the other:
   longest piece first, then always the longest that still fits; then the smallest
   piece is exchanged for two others that fill its room better, until no pair does.
   While the counts allow it the next sequences come out alike, so they are made in
   one step: the plan has one run for each kind of sequence, a number that depends
   on the capacity and not on the corpus.
3. Places.  Pieces of one length are numbered: blocks of rows of the written table
   are counted, running sums of the blocks and a row number inside the block
   (at most ``BLOCK`` rows) give the number, so a length that a third of all
   pieces have is never in one task.  The number finds its run by binary search.

Defined results: a null or empty text is the end id alone.  Rows with one id, or
without an id, are documents of their own.  An empty table has no pieces.  Other
columns are ignored, whatever their names.  Which of two pieces of equal length
comes first is not defined.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.common import arrow_map, documents, shared_table, text_blocks

CAPACITY, END = 2048, 0
BLOCK = 1 << 16
CACHED_WORDS = 1 << 19


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# --- pieces ------------------------------------------------------------------------

# fixed values: marks that end a word for this tokenizer's split; none of them is part of
# a contraction or of a special token
_MARKS = b'!"(),.:;?'
KIND = np.full(256, 3, np.uint8)                          # 3: anything else
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[list(_MARKS)] = 2


def words_of_block(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(words, first word of each text and the end) of a block of texts: what stands
    between white space, cut between ASCII letters or digits and marks as well."""
    kind = KIND[data]
    begins = kind != 0
    if len(data) > 1:
        begins[1:] &= (kind[:-1] == 0) | (kind[:-1] + kind[1:] == 3) & (kind[:-1] % 3 != 0) & (kind[1:] % 3 != 0)
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] = kind[at] != 0
    full = kind != 0
    start = np.flatnonzero(begins)
    kept = data[full]
    place = np.append((np.cumsum(full, dtype=np.int32) - full)[start], len(kept)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(place), pa.py_buffer(kept)]), np.searchsorted(start, offsets)


class WordIds:
    """Ids of whole texts, by their words; ``end`` follows each text.  At most
    ``CACHED_WORDS`` words and those of one block are remembered."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.end = end
        self.mark = self._ids([b"!"])[0][0]
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.count = np.ones(1, np.int64)                  # word 0 is the end id
        self.flat = np.array([self.end], dtype=np.uint32)

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.number) > CACHED_WORDS:
            self.forget()
        get = self.number.get
        out = np.array([get(w, -1) for w in words], dtype=np.int64)
        unknown = np.flatnonzero(out < 0)
        if len(unknown):
            new = [words[i] for i in unknown.tolist()]
            new.sort(key=lambda w: b"!" in w)              # those without the separator first
            count, flat = self._coded(new)
            self.number.update(zip(new, range(len(self.count), len(self.count) + len(new)), strict=True))
            out[unknown] = [self.number[words[i]] for i in unknown.tolist()]
            self.count, self.flat = np.concatenate([self.count, count]), np.concatenate([self.flat, flat])
        return out

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast([t.decode("utf-8", "surrogatepass") for t in texts], add_special_tokens=False)]

    def _coded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, ids) of each word; words without ``!`` come first.  They are
        encoded many at a time, apart by a lone ``!``, whose id no other word gives."""
        plain = sum(b"!" not in w for w in words)
        joined = [b" ! ".join(words[i:min(i + 128, plain)]) + b" !" for i in range(0, plain, 128)]
        ids = np.fromiter(itertools.chain.from_iterable(self._ids(joined)), np.uint32)
        mark = ids == self.mark
        ends = np.flatnonzero(mark)
        if len(ends) != plain:
            raise ValueError("a word gave the separator's id")
        rest = self._ids(words[plain:])
        count = np.concatenate([np.diff(np.append(-1, ends)) - 1, np.fromiter(map(len, rest), np.int64, len(rest))])
        return count, np.concatenate([ids[~mark], np.fromiter(itertools.chain.from_iterable(rest), np.uint32)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a block of texts."""
        words, firsts = words_of_block(data, offsets)
        coded = words.dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        numbers = np.insert(numbers, firsts[1:], 0)
        length = self.count[numbers]
        stop = np.cumsum(length)
        first = np.cumsum(self.count) - self.count
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat((first[numbers] - (stop - length)).astype(np.int32), length) + np.arange(total, dtype=np.int32)]
        ends = firsts[1:] + np.arange(len(offsets) - 1)     # place of each text's end id among the words
        return ids, np.concatenate([[0], stop[ends]])


def pieces(docs: DataFrame, capacity: int = CAPACITY, text_col: str = "text", id_col: str = "doc_id",
           tokenizer: str | None = None, end: int = END, with_ids: bool = False) -> DataFrame:
    """``id_col``, piece, start, length, ids_crc32 (and ids) of every piece of every text."""
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
              T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def cut(ids: np.ndarray, offsets: np.ndarray, keys: pa.Array) -> pa.RecordBatch:
        count = -(-np.diff(offsets) // capacity)
        row = np.repeat(np.arange(len(count)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        begin = offsets[:-1][row] + start
        stop = np.minimum(begin + capacity, offsets[1:][row])
        view = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
        columns = [keys.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(stop - begin, pa.int64()), pa.array(crc, pa.int64())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, offsets[-1]), pa.int32()), pa.array(ids.view(np.int32))))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordIds(tokenizer or tokenizer_path("word_bpe_49k.json"), end)
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(text_col), 1 << 22):
                yield cut(*coder.encode(data, offsets), batch.column(id_col).slice(a, b - a))

    return arrow_map(docs.select(id_col, text_col), run, T.StructType(fields))


# --- plan --------------------------------------------------------------------------

def _largest(left: np.ndarray, limit: int) -> int:
    at = np.flatnonzero(left[:limit + 1])
    return int(at[-1]) if len(at) else 0


def _better_pair(left: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """Two lengths of ``left`` whose sum is the largest above ``least`` and not above
    ``room``; of equal sums the one with the larger smaller half."""
    have = np.flatnonzero(left[:room])
    if not len(have):
        return None
    at = np.searchsorted(have, np.minimum(room - have, have), side="right") - 1
    alone = (at >= 0) & (have[at] == have) & (left[have] < 2)
    at = np.where(alone, at - 1, at)
    total = np.where(at >= 0, have + have[at], 0)
    best = int(total.max())
    if best <= least:
        return None
    a = have[np.flatnonzero(total == best)[0]]
    return int(a), best - int(a)


def one_sequence(left: np.ndarray, capacity: int) -> tuple[Counter, Counter]:
    """Lengths of the next sequence, and the most pieces of each length that were
    looked at on the way."""
    left, gap, chosen, peak = left.copy(), capacity, Counter(), Counter()

    def take(n: int) -> None:
        chosen[n] += 1
        left[n] -= 1
        peak[n] = max(peak[n], chosen[n])

    while size := _largest(left, gap):
        take(size)
        gap -= size
    while gap and (pair := _better_pair(left, gap + min(chosen), min(chosen))):
        small = min(chosen)
        chosen[small] -= 1
        left[small] += 1
        chosen += Counter()                       # drops zeros
        for n in pair:
            take(n)
        gap += small - sum(pair)
    return chosen, peak


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Runs (number of sequences, pieces of each length in one of them) that pack
    ``counts`` pieces of each length from 1 to ``capacity``."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for n, c in counts.items():
        if not 1 <= n <= capacity:
            raise ValueError("a piece is longer than a sequence")
        left[n] = c
    runs = []
    while left.any():
        chosen, peak = one_sequence(left, capacity)
        times = min((int(left[n]) - peak[n]) // k + 1 for n, k in chosen.items())
        for n, k in chosen.items():
            left[n] -= times * k
        runs.append((times, dict(chosen)))
    return runs


def _slots(runs: list[tuple[int, dict[int, int]]], capacity: int) -> dict[str, np.ndarray]:
    """For each run and length, ordered by (length, first number): the numbers it
    takes, its pieces a sequence, the first sequence and the offset inside it."""
    taken, sequence, rows = Counter(), 0, []
    for times, lengths in runs:
        offset = 0
        for n in sorted(lengths, reverse=True):
            rows.append((n, taken[n], lengths[n], sequence, offset))
            taken[n] += times * lengths[n]
            offset += n * lengths[n]
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "sequence", "offset"), table.T, strict=True))


# --- places ------------------------------------------------------------------------

def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; it needs a column ``length``."""
    keep = [f for f in cut.schema.fields if f.name not in ("sequence_id", "offset")]
    cut = shared_table(cut.select(*[f.name for f in keep]), "pieces")
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}       # <= capacity rows
    slots = _slots(best_two_fit(counts, capacity), capacity)

    block = ["length", "_file", "_block"]
    rows = cut.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    rows = rows.withColumn("_block", F.expr(f"_row DIV {BLOCK}"))
    before = Window.partitionBy("length").orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*block).count().withColumn("_base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    numbered = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*block).orderBy("_row"))).join(base, block)
    numbered = numbered.select(*[f.name for f in keep], (F.col("_base") + F.col("_place") - 1).alias("_number"))
    schema = T.StructType([*keep, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one sorted key for (length, number): the number's digits below the length's
        top = int(slots["first"].max(initial=0)) + 1
        keys = slots["length"] * top + slots["first"]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("_number").to_numpy(zero_copy_only=False)
            at = np.searchsorted(keys, length * top + np.minimum(number, top - 1), side="right") - 1
            place = number - slots["first"][at]
            sequence = slots["sequence"][at] + place // slots["each"][at]
            offset = slots["offset"][at] + place % slots["each"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in keep), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             names=[f.name for f in schema])

    return arrow_map(numbered, run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences, from pieces cut with their ids."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))   # <= capacity ids
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))


def op11_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(pieces(documents(spark, sf_dir, "doc_id", "text")))
