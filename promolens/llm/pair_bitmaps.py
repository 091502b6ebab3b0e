"""Operator 12: cross-tokenizer alignment, with corpus counts from inverted pair bitmaps.

Two tokenizers cut the same bytes; where tokens of both end, the text falls into
groups, and every token of A is linked with every token of B in its group.

1. Units.  Neither tokenizer makes a token that holds a space behind another
   character, or a mark beside an ASCII letter or digit (B's pieces are looked
   through for that), so a text may be cut there: both tokenizers, the groups and
   the links of the whole text are those of its units, one after the other.  A
   task encodes each different unit once.  A unit that does not give its bytes back
   sends its text through both tokenizers as a whole.
2. Inverted pair bitmaps.  Documents are numbered in super blocks of 2**16 inside a
   task.  For each id pair a task writes compressed bitmaps of the documents that
   hold it: a sorted list of 16-bit places, or 2**16 bits where that is shorter.
   Multiplicity planes hold the binary digits of (links - 1) in the same form.
3. OR-merge.  The bitmaps of one (pair, super block, plane) are merged; the popcounts
   of presence bitmaps give each pair's documents, those of the planes its links.
   Hot pairs are as many rows as there are super blocks, never one task's.
4. Postings return scores.  Each bitmap is joined with its pair's count and whether
   that is the highest of its A id, dealt by super block and added up into two
   arrays of 2**16 sums, one entry a document.

Defined results: null and empty texts, and texts whose tokens of A or B do not join
to a space and the text, have no tokens: zeros, and '' for the digest.  Repeated rows
are documents of their own.  Other columns are ignored, whatever their names.
Memory is bounded by ``ENTRIES``, ``CACHED_UNITS`` and the longest single text.
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.llm.common import arrow_map, discard, documents, shared_table, text_blocks
from promolens.llm.packing import KIND, tokenizer_path

PLACES = 1 << 16                  # documents of a super block
BITSET = PLACES // 8              # bytes of a container with one bit a document
ENTRIES = 1_000_000               # (pair, document) entries a task holds before it writes containers
CACHED_UNITS = 3 << 17
UNIT_BYTES = 1 << 21


# --- both tokenizers ---------------------------------------------------------------

def _spread(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices first[i] .. first[i] + length[i] - 1 of all i, one after the other."""
    stop = np.cumsum(length)
    return np.repeat(first - (stop - length), length) + np.arange(stop[-1] if len(stop) else 0)


class _Vocabulary:
    """Bytes of a tokenizer's entries."""

    def __init__(self, entries: list[bytes]):
        self.length = np.array([len(x) for x in entries], dtype=np.int64)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[_spread(self.first[ids], self.length[ids])]


def _byte_level() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class Aligner:
    """Both tokenizers and what is known of the units met so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        code = _byte_level()
        special = {i for i, t in self.a.get_added_tokens_decoder().items() if t.special}
        self.bytes_a = _Vocabulary([b"" if i in special else bytes(code[c] for c in self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())])
        self.bytes_b = _Vocabulary([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                                    for i, p in enumerate(self.b.id_to_piece(list(range(len(self.b)))))])
        self.blank = self.b.piece_to_id("▁")
        pieces = self.b.id_to_piece(list(range(len(self.b))))
        # where no piece crosses, texts may be cut: before spaces, and between words and marks
        self.separable = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        touched = {m for p in pieces for x, y in itertools.pairwise(p) for m, c in ((x, y), (y, x)) if c.isascii() and c.isalnum()}
        self.kind = np.where([k == 2 and chr(c) in touched for c, k in enumerate(KIND)], 3, KIND).astype(np.uint8)
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.text: list[bytes] = []                        # the groups of each unit
        self.tables = {c: np.zeros(0, np.int32) for c in ("good", "n_a", "n_b", "n_groups", "n_links", "first")}
        self.pairs = np.zeros(0, np.uint32)

    def numbers(self, units: list[bytes]) -> np.ndarray:
        new = [u for u in units if u not in self.number]
        if new:
            base = len(self.text)
            self._learn(new)
            self.number.update((u, base + i) for i, u in enumerate(new))
        return np.array([self.number[u] for u in units], dtype=np.int64)

    def _learn(self, units: list[bytes]) -> None:
        strings = [u.decode("utf-8", "surrogatepass") for u in units]
        coded_a = [x.ids for x in self.a.encode_batch_fast(strings, add_special_tokens=False)]
        # B adds the first space itself; before other units stands a line end, which joins nothing
        coded_b = self.b.encode([s[1:] if s[0] == " " else "\n" + s for s in strings], num_threads=1)
        coded_b = [x[2:] if s[0] != " " else x if len(s) > 1 else [self.blank] for x, s in zip(coded_b, strings, strict=True)]
        size = np.array([len(u) for u in units], dtype=np.int64)
        start = np.cumsum(size) - size
        whole = np.frombuffer(b"".join(units), dtype=np.uint8)
        flat, count, ends, good = {}, {}, {}, np.ones(len(units), bool)
        for side, coded, entries in (("a", coded_a, self.bytes_a), ("b", coded_b, self.bytes_b)):
            ids = np.fromiter(itertools.chain.from_iterable(coded), dtype=np.int64)
            n = np.fromiter(map(len, coded), np.int64, len(coded))
            owner = np.repeat(np.arange(len(units)), n)
            length = entries.length[ids]
            total = np.bincount(owner, length, len(units)).astype(np.int64)
            good &= total == size
            # bytes of the units whose total fits, against the units themselves
            fits = (total == size)[owner]
            got, want = entries.joined(ids[fits]), whole[_spread(start, np.where(total == size, size, 0))]
            wrong = np.flatnonzero(got != want)
            if len(wrong):
                at = np.flatnonzero(total == size)
                good[at[np.searchsorted(np.cumsum(size[at]), wrong, side="right")]] = False
            flat[side], count[side], ends[side] = ids, n, (owner, length)
        for side in "ab":                                  # the rest is about good units
            owner, length = ends[side]
            keep = good[owner]
            flat[side], owner, length = flat[side][keep], owner[keep], length[keep]
            count[side] = np.where(good, count[side], 0)
            inside = np.cumsum(length)
            before = np.concatenate([[0], inside])[np.cumsum(count[side]) - count[side]]
            ends[side] = (owner, start[owner] + inside - before[owner])
        cuts = np.intersect1d(ends["a"][1], ends["b"][1])
        of = {s: np.searchsorted(cuts, ends[s][1]) for s in "ab"}                 # group of each token
        n = {s: np.bincount(of[s], minlength=len(cuts)) for s in "ab"}
        first_b = np.cumsum(n["b"]) - n["b"]
        wide = n["b"][of["a"]]
        pairs = (np.repeat(flat["a"], wide) << 16 | flat["b"][_spread(first_b[of["a"]], wide)]).astype(np.uint32)
        unit = np.searchsorted(start + size, cuts)                               # unit of each group
        n_links = np.bincount(unit, n["a"] * n["b"], len(units)).astype(np.int64)
        groups = np.bincount(unit, minlength=len(units))
        a, b = (list(map(str, flat[s].tolist())) for s in "ab")
        i = j = 0
        words = []
        for x, y in zip(n["a"].tolist(), n["b"].tolist(), strict=True):
            words.append(a[i] + "|" + b[j] if x == y == 1 else ",".join(a[i:i + x]) + "|" + ",".join(b[j:j + y]))
            i, j = i + x, j + y
        i = 0
        for k in groups.tolist():
            self.text.append(";".join(words[i:i + k]).encode())
            i += k
        more = {"good": good, "n_a": count["a"], "n_b": count["b"], "n_groups": groups, "n_links": n_links,
                "first": len(self.pairs) + np.cumsum(n_links) - n_links}
        self.tables = {c: np.concatenate([self.tables[c], v.astype(np.int32)]) for c, v in more.items()}
        self.pairs = np.concatenate([self.pairs, pairs])

    def units_of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(unit numbers, offsets) of a block of texts; without tokens: no units."""
        if len(self.text) > CACHED_UNITS:
            self.forget()
        spaced = pc.binary_join_element_wise("", texts, " ")                      # a space and the text
        spaced = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", spaced).cast(pa.binary())
        bounds = np.frombuffer(spaced.buffers()[1], dtype=np.int32)[spaced.offset:spaced.offset + len(spaced) + 1].astype(np.int64)
        data = np.frombuffer(spaced.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        starts = np.zeros(len(data), bool)
        if self.separable and len(data) > 2:
            last, prior = data[1:-1], data[:-2]
            white = (last == 0x20) | ((last >= 0x09) & (last <= 0x0D))
            # may be the end of white space beyond ASCII: not cut there
            white |= (last >= 0x80) & ((prior == 0xC2) | (prior == 0x80) | (prior == 0x81) | (prior == 0x9A))
            starts[2:] = (data[2:] == 0x20) & ~white
            kind = self.kind[data]
            starts[1:] |= (kind[:-1] + kind[1:] == 3) & (kind[:-1] % 3 != 0) & (kind[1:] % 3 != 0)
        starts[bounds[:-1][bounds[:-1] < len(data)]] = True
        cuts = np.append(np.flatnonzero(starts), len(data))
        offsets = np.searchsorted(cuts[:-1], bounds)
        units = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        numbers = self.numbers(units.dictionary.to_pylist())[units.indices.to_numpy()] if len(units) else np.zeros(0, np.int64)
        bad = np.flatnonzero(self.tables["good"][numbers] == 0) if len(numbers) else []
        if len(bad):
            # these texts go through both tokenizers as a whole
            rows = np.unique(np.searchsorted(offsets, bad, side="right") - 1)
            parts = np.split(numbers, offsets[1:-1])
            for r in rows.tolist():
                one = self.numbers([data[bounds[r]:bounds[r + 1]].tobytes()])
                parts[r] = one if self.tables["good"][one[0]] else one[:0]
            numbers = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return numbers, offsets


# --- compressed bitmaps --------------------------------------------------------------

def containers(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(groups, popcounts, bitmaps) of entries sorted by (group, place), all different."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(group)))
    listed = place.astype("<u2")
    dense = np.flatnonzero(2 * n >= BITSET)
    if not len(dense):
        offsets = (2 * np.append(first, len(group))).astype(np.int32)
        return group[first], n, pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(listed.tobytes())])
    parts = [listed[a:a + k].tobytes() for a, k in zip(first.tolist(), n.tolist(), strict=True)]
    for i in dense.tolist():
        bits = np.zeros(PLACES, np.uint8)
        bits[listed[first[i]:first[i] + n[i]]] = 1
        parts[i] = np.packbits(bits, bitorder="little").tobytes()
    return group[first], n, pa.array(parts, pa.binary())


def places(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every set bit, sorted by row."""
    if not len(bitmaps):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = pc.binary_length(bitmaps).to_numpy(zero_copy_only=False)
    listed = np.flatnonzero(size < BITSET)
    data = b"".join(bitmaps.filter(pa.array(size < BITSET)).to_pylist())
    row, place = [np.repeat(listed, size[listed] // 2)], [np.frombuffer(data, dtype="<u2").astype(np.int64)]
    for i in np.flatnonzero(size >= BITSET).tolist():
        at = np.flatnonzero(np.unpackbits(np.frombuffer(bitmaps[i].as_buffer(), np.uint8), bitorder="little"))
        row.append(np.full(len(at), i))
        place.append(at)
    if len(row) == 1:
        return row[0], place[0]
    row, place = np.concatenate(row), np.concatenate(place)
    order = np.argsort(row, kind="stable")
    return row[order], place[order]


POSTINGS = [T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("plane", T.IntegerType()),
            T.StructField("n", T.LongType()), T.StructField("bits", T.BinaryType())]
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


def alignment(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path_a: str | None = None,
              path_b: str | None = None, with_groups: bool = False) -> DataFrame:
    """Two kinds of rows.  Documents: block, place, ``id_col``, n_a, n_b, n_groups,
    n_links, groups_sha256 (and groups).  Postings (``a`` is not null): block, a, b,
    plane (-1: presence, k: digit k of links - 1), n (popcount), bits."""
    own = [T.StructField("block", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField(id_col, docs.schema[id_col].dataType),
           *[T.StructField(c, T.LongType()) for c in FIGURES], T.StructField("groups_sha256", T.StringType())]
    if with_groups:
        own.append(T.StructField("groups", T.StringType()))
    schema = T.StructType([*own, *POSTINGS])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def row_batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in arrow], schema=arrow)

    def postings(block: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key)
        key, more = key[order], count[order] - 1
        for plane in range(-1, int(more.max(initial=0)).bit_length()):
            some = key if plane < 0 else key[(more >> plane) & 1 == 1]
            pair, n, bits = containers(some >> np.uint64(16), some & np.uint64(0xFFFF))
            for i in range(0, len(pair), 20_000):
                p = pair[i:i + 20_000].astype(np.int64)
                yield row_batch({"block": pa.array(np.full(len(p), block)), "a": pa.array(p >> 16), "b": pa.array(p & 0xFFFF),
                                 "plane": pa.array(np.full(len(p), plane)), "n": pa.array(n[i:i + 20_000]), "bits": bits.slice(i, len(p))}, len(p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = Aligner(path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model"))
        block, used, keys, counts = TaskContext.get().partitionId() << 32, 0, [], []
        for batch in batches:
            texts = pc.fill_null(batch.column(text_col), "")
            for a, b, _, _ in text_blocks(texts, UNIT_BYTES):
                while a < b:
                    if used == PLACES or sum(map(len, keys)) > ENTRIES:
                        yield from postings(block, keys, counts)
                        keys, counts = [], []
                    if used == PLACES:
                        block, used = block + 1, 0
                    k = min(b - a, PLACES - used)
                    units, offsets = both.units_of(texts.slice(a, k))
                    t = both.tables
                    sums = {c: np.diff(np.concatenate([[0], np.cumsum(t[c][units])])[offsets]) for c in FIGURES}
                    groups = [b";".join([both.text[i] for i in units[x:y].tolist()]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    columns = {"block": pa.array(np.full(k, block)), "place": pa.array(np.arange(used, used + k)), id_col: batch.column(id_col).slice(a, k),
                               **{c: pa.array(v) for c, v in sums.items()}, "groups_sha256": pa.array([sha256(g).hexdigest() if g else "" for g in groups])}
                    if with_groups:
                        columns["groups"] = pa.array([g.decode() for g in groups])
                    yield row_batch(columns, k)
                    pair = both.pairs[_spread(t["first"][units], t["n_links"][units])].astype(np.uint64)
                    place = np.repeat(np.arange(used, used + k, dtype=np.uint64), sums["n_links"])
                    if len(pair):
                        key, count = np.unique(pair << np.uint64(16) | place, return_counts=True)
                        keys.append(key)
                        counts.append(count.astype(np.int32))
                    a, used = a + k, used + k
        if keys:
            yield from postings(block, keys, counts)

    return arrow_map(docs.select(id_col, text_col), run, schema)


def merged(postings: DataFrame) -> DataFrame:
    """``postings`` (block, a, b, plane, n, bits) with one bitmap a (pair, block, plane)."""
    keys = ["a", "b", "block", "plane"]
    schema = postings.select(*keys, "n", "bits").schema

    def merge(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(k).to_numpy() for k in keys]
        new = np.ones(rows.num_rows, bool)
        if rows.num_rows:
            new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        n, bits = rows.column("n").to_numpy(), rows.column("bits").combine_chunks()
        if len(first) < rows.num_rows:
            row, place = places(bits)
            _, n, bits = containers(*np.divmod(np.unique(group[row] * PLACES + place), PLACES))
        return pa.RecordBatch.from_arrays([*(pa.array(c[first], rows.schema.field(k).type) for c, k in zip(columns, keys, strict=True)),
                                           pa.array(n, pa.int64()), bits.cast(pa.binary())], names=[*keys, "n", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows]).combine_chunks()
            # the last group may go on in the next batch
            same = np.all([rows.column(k).to_numpy() == rows.column(k)[-1].as_py() for k in keys], axis=0) if rows.num_rows else []
            stop = rows.num_rows - (int(np.argmin(same[::-1])) if not np.all(same) else rows.num_rows)
            left = rows.slice(stop)
            if stop:
                yield merge(rows.slice(0, stop))
        if left is not None and left.num_rows:
            yield merge(left)

    dealt = postings.select(*keys, "n", "bits").repartition("a", "b", "block").sortWithinPartitions(*keys)
    return arrow_map(dealt, run, schema)


def pair_counts(bitmaps: DataFrame) -> DataFrame:
    """a, b, docs, links, best (no pair of ``a`` has more documents) of every id pair."""
    weight = F.when(F.col("plane") < 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, greatest(plane, 0))"))
    counts = shared_table(bitmaps.groupBy("a", "b").agg(
        F.sum(F.when(F.col("plane") < 0, F.col("n"))).alias("docs"), F.sum(F.col("n") * weight).alias("links")), "pairs")
    most = counts.groupBy("a").agg(F.max("docs").alias("most"))
    return counts.join(most, "a").select("a", "b", "docs", "links", (F.col("docs") == F.col("most")).alias("best"))


def scores(bitmaps: DataFrame, counts: DataFrame) -> DataFrame:
    """block, place, n_best, count_sum: what the postings say of each document."""
    schema = "block long, place int, n_best long, count_sum long"

    def rows(block: int, sums: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(sums[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at, pa.int32()), *(pa.array(s[at]) for s in sums)],
                                          names=["block", "place", "n_best", "count_sum"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros((2, PLACES), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column("block").to_numpy()
            weight = 1 << np.maximum(batch.column("plane").to_numpy().astype(np.int64), 0)
            value = np.stack([weight * batch.column("best").to_numpy(zero_copy_only=False), weight * batch.column("docs").to_numpy()])
            cuts = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])).tolist()
            for x, y in zip(cuts, [*cuts[1:], batch.num_rows], strict=True):
                if blocks[x] != now:
                    if now is not None:
                        yield rows(now, sums)
                    now, sums = int(blocks[x]), np.zeros((2, PLACES), np.int64)
                row, place = places(batch.column("bits").slice(x, y - x))
                for s, v in zip(sums, value, strict=True):
                    np.add.at(s, place, v[x:y][row])
        if now is not None:
            yield rows(now, sums)

    scored = bitmaps.join(counts.select("a", "b", "docs", "best"), ["a", "b"]).select("block", "plane", "docs", "best", "bits")
    return arrow_map(scored.repartition("block").sortWithinPartitions("block"), run, schema)


def align(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", path_a: str | None = None, path_b: str | None = None,
          with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents with their figures and scores, id pairs with their counts)."""
    both = shared_table(alignment(docs, text_col, id_col, path_a, path_b, with_groups), "alignment")
    bitmaps = shared_table(merged(both.where("a IS NOT NULL")), "pair-bitmaps")
    own = shared_table(both.where("a IS NULL").drop(*[f.name for f in POSTINGS]), "aligned")
    discard(both)
    counts = shared_table(pair_counts(bitmaps), "pair-counts")
    out = own.join(scores(bitmaps, counts), ["block", "place"], "left").drop("block", "place")
    return out.fillna(0, ["n_best", "count_sum"]), counts


def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    out, _ = align(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256")
