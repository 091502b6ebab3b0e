"""Operator 3: removing repeated passages by prefix-free parsing.

Every byte covered by a ``length``-byte string that also starts anywhere else in
the corpus (same document included) is removed.  The corpus order that a suffix
array would give is needed only up to ``length`` bytes, and only to see which
starts are neighbours with equal strings; it is combined from the order of
phrases and the order of what follows them.

* Parse.  A rolling hash over ``TRIGGER`` bytes is taken at every byte; the byte
  with the least hash among the next ``window`` is the trigger of a start.  So a
  trigger depends on the text alone, equal strings have equal triggers, and no
  stretch of text is without one (a fixed residue would leave gaps).  Starts with
  one trigger form a phrase; there are about ``2 / window`` phrases a byte, and
  only these are shuffled, never single bytes.
* Parse order.  Phrases are grouped by the text behind their trigger (all
  ``length - window + 1`` bytes that any of their strings has).  A phrase whose
  group is itself has no repeated string and is dropped: this is what a suffix
  array of the parse tells.
* Dictionary order.  Within a group phrases are told apart by their whole span.
  A span that occurs twice has all its strings repeated.
* Combination.  What is left are the edges of repeated passages: spans that occur
  once in a group with others.  Their starts are grouped by (text behind the
  trigger, distance to it, whole string), first sixteen starts at a time by the
  bytes common to all sixteen (unique: none is repeated) and by their union
  (repeated: all are), then one by one.

The order is by hashed text, not by letters: neighbours are the same.  A name
is two independent 64-bit polynomial hashes.  Groups are reduced by partial
aggregates and joined back, so a passage that a third of all documents share
meets in no single task.

Defined results: a null text is empty; texts shorter than ``length`` stay as
they are; rows are told apart by (doc_id, text): repeated rows remove each other;
null ids are no special case; extra columns pass through.  Bytes are removed
without regard to characters, so the kept text is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import P1, P2, U, arrow_map, discard, documents, mix, powers, shared_table, small_side, text_blocks

LENGTH = 400
TRIGGER, STEP = 12, 16
BLOCK = 1 << 18                 # bytes worked on at once; about twenty 8-byte arrays of this length are alive


def _inverse(p: np.uint64) -> np.uint64:
    return U(pow(int(p), -1, 1 << 64))


class Spans:
    """Hashes of any spans of a block of bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        body = data.astype(np.uint64) + U(1)
        self.sums, self.back = [], []
        for p in (P1, P2):
            h = np.zeros(n + 1, np.uint64)
            np.cumsum(body * powers(n, p), out=h[1:])
            self.sums.append(h)
            self.back.append(powers(n + 1, _inverse(p)))

    def hash(self, which: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[which]
        return mix((h[end] - h[start]) * self.back[which][start] + (end - start).astype(np.uint64))


def _phrases(data: np.ndarray, offsets: np.ndarray, length: int, window: int):
    """text number, trigger, first and last start (in the block), group and span hash."""
    n = len(data)
    texts = np.flatnonzero(np.diff(offsets) >= length)
    if not len(texts):
        return None
    spans = Spans(data)
    at = np.arange(n - TRIGGER + 1)
    bits = U(max(1, int(n).bit_length()))
    value = ((spans.hash(0, at, at + TRIGGER) >> bits) << bits) | at.astype(np.uint64)
    span = 1
    while span * 2 <= window:
        value[:len(value) - span] = np.minimum(value[:len(value) - span], value[span:])
        span *= 2
    least = np.minimum(value[:len(value) - (window - span)], value[window - span:])
    trigger = (least & ((U(1) << bits) - U(1))).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    valid[offsets[texts]] += 1
    valid[offsets[texts + 1] - length + 1] -= 1
    valid = np.cumsum(valid)[:len(trigger)].astype(bool)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (trigger[1:] != trigger[:-1])
    last = valid.copy()
    last[:-1] &= ~valid[1:] | (trigger[1:] != trigger[:-1])
    low, high = np.flatnonzero(new), np.flatnonzero(last)
    t = trigger[low]
    group = spans.hash(0, t, t + (length - window + 1))
    whole = mix(spans.hash(1, low, high + length) ^ mix((t - low).astype(np.uint64) * P1 + (high - low).astype(np.uint64)))
    return np.searchsorted(offsets, low, side="right") - 1, t, low, high, group, whole


_signed = lambda x: pa.array(x.view(np.int64))


def phrases(rows: DataFrame, length: int, window: int) -> DataFrame:
    """rid, at (trigger), low, high (starts), g, s of every phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            for a, _, data, offsets in text_blocks(batch.column("text"), BLOCK):
                found = _phrases(data, offsets, length, window)
                if found:
                    text, t, low, high, g, s = found
                    o = offsets[text]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rid[a + text]), pa.array((t - o).astype(np.int32)), pa.array((low - o).astype(np.int32)),
                        pa.array((high - o).astype(np.int32)), _signed(g), _signed(s)], names=["rid", "at", "low", "high", "g", "s"])

    return arrow_map(rows, run, "rid long, at int, low int, high int, g long, s long")


def _with_texts(rows: DataFrame, wanted: DataFrame, fields: list[str]) -> DataFrame:
    """Texts with the list ``x`` of their ``wanted`` rows; a repeated row is read once."""
    lists = shared_table(wanted.groupBy("rid").agg(F.collect_list(F.struct(*fields)).alias("x")), "wanted")
    return rows.join(small_side(lists, 500_000, "x"), "rid").dropDuplicates(["rid"])


def _probe(rows: DataFrame, wanted: DataFrame, length: int, fine: bool) -> DataFrame:
    """Names of the starts of ``wanted`` phrases: rid, at, a0, a1 (least and
    largest distance of the trigger from the start), g, and hashes ``one`` of the
    bytes common to these starts' strings and ``all`` of their union.

    ``fine``: ``wanted`` has a0 and a1 itself, and each start is named alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rid = batch.column("x"), batch.column("rid").to_numpy()
            for a, b, data, offsets in text_blocks(batch.column("text"), BLOCK):
                spans = Spans(data)
                lists = column.slice(a, b - a)
                x = lists.flatten()
                field = lambda name: x.field(name).to_numpy().astype(np.int64)  # noqa: E731, B023
                text = np.repeat(np.arange(b - a), np.diff(lists.offsets.to_numpy()))
                at, g, o = field("at"), field("g"), offsets[text]
                near, far = (field("a0"), field("a1")) if fine else (at - field("high"), at - field("low"))
                first = near if fine else near // STEP
                count = (far if fine else far // STEP) - first + 1
                of = np.repeat(np.arange(len(at)), count)
                q = first[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
                width = 1 if fine else STEP
                t = (at + o)[of]
                a0, a1 = np.maximum(q * width, near[of]), np.minimum(q * width + width - 1, far[of])
                # common bytes: of all starts of the step, also those that this phrase does not have
                one = spans.hash(1, t - q * width, t - q * width - width + 1 + length)
                union = mix(spans.hash(1, t - a1, t - a0 + length) ^ mix(a0.astype(np.uint64) * P1 + a1.astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(rid[a + text[of]]), pa.array(at[of].astype(np.int32)), pa.array(a0.astype(np.int32)), pa.array(a1.astype(np.int32)),
                    pa.array(g[of]), _signed(mix(one ^ mix(q.astype(np.uint64)))), _signed(union)], names=["rid", "at", "a0", "a1", "g", "one", "all"])

    return arrow_map(_with_texts(rows, wanted, [c for c in wanted.columns if c != "rid"]).select("rid", "text", "x"),
                     run, "rid long, at int, a0 int, a1 int, g long, one long, all long")


def repeated_ranges(rows: DataFrame, length: int = LENGTH, window: int | None = None) -> DataFrame:
    """rid, low, high: bytes [low, high) of the text are repeated.  Ranges may
    overlap.  ``rows``: rid, text."""
    window = window or length // 2
    every = shared_table(phrases(rows, length, window), "parse")
    groups = every.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("g")
    parse = shared_table(every.join(groups, "g", "left_semi"), "shared")
    discard(every)
    spans = parse.groupBy("g", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at")).alias("first"))
    spans = shared_table(spans, "spans")
    kinds = spans.groupBy("g").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least"))
    marks = shared_table(parse.join(spans, ["g", "s"]).join(kinds.where("m > 1 AND least = 1"), "g", "left")
                         .select("rid", "at", "low", "high", "g", "n", "m", (F.struct("rid", "at") == F.col("first")).alias("head")), "marks")
    discard(parse)
    discard(spans)
    whole = marks.where("n > 1").select("rid", "low", (F.col("high") + length).alias("high"))
    # spans that occur once, and one example of every other span of their groups
    edge = shared_table(marks.where("m IS NOT NULL AND head").select("rid", "at", "low", "high", "g", (F.col("n") == 1).alias("open")), "edges")
    probes = shared_table(_probe(rows, edge.drop("open"), length, False).join(edge.select("rid", "at", "g", "open"), ["rid", "at", "g"]), "probes")
    alive = probes.groupBy("g", "one").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    twice = probes.groupBy("g", "all").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("g", "all", F.lit(True).alias("twice"))
    steps = shared_table(probes.join(alive, ["g", "one"], "left_semi").join(twice, ["g", "all"], "left"), "steps")
    done = steps.where("twice AND open").select("rid", (F.col("at") - F.col("a1")).alias("low"), (F.col("at") - F.col("a0") + length).alias("high"))
    # steps with a start still to be decided, and whatever shares their common bytes
    left = steps.where("twice IS NULL AND open").select("g", "one").distinct()
    last = shared_table(steps.join(left, ["g", "one"], "left_semi").select("rid", "at", "a0", "a1", "g", (F.col("open") & F.col("twice").isNull()).alias("open")), "last")
    starts = shared_table(_probe(rows, last.drop("open"), length, True).join(
        last.select("rid", "at", "g", F.col("a0").alias("b0"), F.col("a1").alias("b1"), "open"), ["rid", "at", "g"]).where("a0 BETWEEN b0 AND b1"), "starts")
    same = starts.groupBy("g", "a0", "one").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    single = starts.where("open").join(same, ["g", "a0", "one"], "left_semi").select(
        "rid", (F.col("at") - F.col("a0")).alias("low"), (F.col("at") - F.col("a0") + length).alias("high"))
    return whole.union(done).union(single)


def remove_ranges(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """``rows`` (rid, text, ...) with n_bytes, n_removed, n_spans and kept (binary)."""
    # overlapping ranges are folded in each text; at first those of equal start
    longest = ranges.groupBy("rid", "low").agg(F.max("high").alias("high"))
    lists = longest.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("x"))
    lists = shared_table(lists, "removed")
    joined = rows.join(small_side(lists, 500_000, "x"), "rid", "left")
    own = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                size, gone, runs, kept = [], [], [], []
                for text, cuts in zip(part.column("text"), part.column("x"), strict=True):
                    data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                    out, end, start, n, k = [], 0, None, 0, 0
                    for r in cuts.values if cuts.is_valid else ():
                        low, high = r["low"].as_py(), r["high"].as_py()
                        if start is None or low > end:
                            out.append(data[end:low])
                            k += 1
                            n += high - low
                            start, end = low, high
                        elif high > end:
                            n += high - end
                            end = high
                    out.append(data[end:])
                    size.append(len(data))
                    gone.append(n)
                    runs.append(k)
                    kept.append(b"".join(out))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in own), pa.array(size, pa.int64()), pa.array(gone, pa.int64()),
                                                  pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                                                 names=[*(f.name for f in own), "n_bytes", "n_removed", "n_spans", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return arrow_map(joined, run, f"{fields}, n_bytes long, n_removed long, n_spans long, kept binary")


def with_rid(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.select(F.xxhash64(id_col, text_col).alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def op3_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    rows = with_rid(documents(spark, sf_dir))
    out = remove_ranges(rows, repeated_ranges(rows.select("rid", "text")))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
