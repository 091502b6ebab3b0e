"""Operator 5: n-gram Jaccard join with adaptive multi-match prefixes.

Documents are sets of ``k``-word shingles (64-bit hashes).  Two link when
``100 * |x & y| >= percent * |x | y|``.  All sets are sorted by one global
order, rare shingles first.  If x and y link, they share at least ``l`` of the
first ``|x| - need(x) + l`` shingles, for every ``l``; so a document may pick a
longer prefix (larger ``l``) and in return ask for ``l`` shared shingles before
a pair is verified.  Each document picks the ``l`` of least estimated cost.

Steps:

1. The order.  A sketch of ``2**20`` counters (bounded) sums the document
   frequency of all shingles of all documents; shingles are ordered by the
   magnitude of their counter, then by hash.  It decides the cost only: any
   order of the shingles gives the same links.
2. Equal sets are folded into classes by a 128-bit digest, by a grouped
   minimum; only one document of a class goes on.
3. Prefix shingles that only one class has cannot match and are dropped.  The
   cost of a level is what it scans (the frequencies of the prefix shingles)
   plus what it verifies: at most ``scanned / l`` pairs, each as long as the set.
4. Star rounds: each document is verified against the one document that leads
   most of its prefix shingles' blocks.  A dense group of near copies becomes
   one component by a linear number of pairs.
5. The exact rest: pairs of *different* components that share at least
   ``min(l_x, l_y)`` shingles of their prefixes, fit in length and whose 512-bit
   parity maps do not rule a link out (the maps differ in no more cells than the
   sets do in shingles) are verified, all of them.  A pair that was never listed lies in one component already,
   so no link is lost.

No group is gathered in one task: blocks are reduced by partial aggregates and
joined (AQE splits a hot key).  Hot copies are one class, a hot passage is
last in the order.

Defined results: a null or wordless text has an empty set, links with nothing
and is its own component; rows with one doc_id are one node; a null doc_id
links with nothing (component null); extra columns are not read.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import P1, U, Words, arrow_map, discard, documents, mix, shared_table, shingles, small_side, summed_vectors, text_blocks
from promolens.llm.components import components

SHINGLE, PERCENT = 4, 85
MAX_LEVEL = 4
SKETCH_BITS = 20
VERIFY_WEIGHT = 0.05            # cost of one verified shingle against one scanned posting


def _sets(batch: pa.RecordBatch, column: str, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text of a batch."""
    for a, b, data, offsets in text_blocks(batch.column(column)):
        words = Words(data, offsets, lower=True)
        for i in range(a, b):
            yield i, np.unique(shingles(words.hash[words.first[i - a]:words.first[i - a + 1]], k))


def sketch(docs: DataFrame, k: int = SHINGLE, text_col: str = "text") -> np.ndarray:
    """Order tiers of the ``2**SKETCH_BITS`` shingle counters: 0 for counters
    near the mean, one more for every doubling above four times the mean."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0)):
                words = Words(data, offsets, lower=True)
                sets = [np.unique(shingles(words.hash[x:y], k)) for x, y in zip(words.first[:-1], words.first[1:], strict=True)]
                total += np.bincount((np.concatenate(sets) >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=size)
        return total

    total = summed_vectors(docs.select(text_col), size, count)
    return np.clip(np.floor(np.log2(np.maximum(total / max(4 * total.mean(), 32.0), 0.5))) + 1, 0, 60).astype(np.uint8)


def _need(n, percent: int):
    """Least overlap of a set of ``n`` with any set that it links with."""
    return -(-percent * n // 100)


def signatures(docs: DataFrame, tiers: np.ndarray, k: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """doc_id, 128-bit set digest, set size, longest prefix and 512-bit parity map of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                size, one, two, prefix, bits, ends = [], [], [], [], [], [0]
                for _, s in _sets(part, "text", k):
                    n = len(s)
                    size.append(n)
                    # order-free digests of the set: two sums of independent mixes
                    one.append(int(mix(s + P1).sum(dtype=np.uint64)))
                    two.append(int(mix(s ^ P1).sum(dtype=np.uint64)))
                    # parity of the set's shingles in each of 512 cells
                    bits.append(np.packbits(np.bincount((s & U(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1).view(np.int64))
                    order = np.argsort(tiers[(s >> U(64 - SKETCH_BITS)).astype(np.int64)], kind="stable")
                    prefix.append(s[order[:max(0, n - _need(n, percent) + MAX_LEVEL)]])
                    ends.append(ends[-1] + len(prefix[-1]))
                signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").cast(pa.int64()), signed(one), signed(two), pa.array(size, pa.int32()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), signed(np.concatenate(prefix))),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * 8, pa.int32()), pa.array(np.concatenate(bits)))],
                    names=["doc_id", "k1", "k2", "n", "prefix", "bits"])

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run,
        "doc_id long, k1 long, k2 long, n int, prefix array<long>, bits array<long>")


def _texts(docs: DataFrame, ids: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, text) of the documents in ``ids`` (one column)."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(
        small_side(ids, 2_000_000), "doc_id", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int, text_col: str, id_col: str) -> DataFrame:
    """The pairs (x, y) whose texts link."""
    ids = shared_table(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct(), "ids")
    texts = shared_table(_texts(docs, ids, text_col, id_col), "texts")
    both = (pairs.join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("text_y")), "y")
            .join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("text_x")), "x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keep = []
                for (_, x), (_, y) in zip(_sets(part, "text_x", k), _sets(part, "text_y", k), strict=True):
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
                yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    links = shared_table(arrow_map(both.select("x", "y", "text_x", "text_y"), run, "x long, y long"), "links")
    discard(texts)
    return links


def _current(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``nodes`` (with cid) and the component ``comp`` of each."""
    return nodes.join(parts.select(F.col("node").alias("cid"), "component"), "cid", "left").withColumn(
        "comp", F.coalesce("component", "cid")).drop("component")


def _plausible(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) that the set sizes and parity maps do not rule out."""
    x, y = maps.alias("mx"), maps.alias("my")
    both = F.col("mx.n") + F.col("my.n")
    apart = sum((F.bit_count(F.col("mx.bits")[i].bitwiseXOR(F.col("my.bits")[i])) for i in range(8)), F.lit(0))
    most = both - 2 * F.floor((percent * both + 99 + percent) / (100 + percent))
    known = F.col("mx.bits").isNotNull() & F.col("my.bits").isNotNull()
    fits = (apart <= most) & (100 * F.least("mx.n", "my.n") >= percent * F.greatest("mx.n", "my.n"))
    return (pairs.join(x, F.col("x") == F.col("mx.cid")).join(y, F.col("y") == F.col("my.cid"))
            .where(~known | fits).select("x", "y"))


def _unjudged(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """``pairs`` without those that were verified before, in whichever order."""
    names = F.least("x", "y").alias("_a"), F.greatest("x", "y").alias("_b")
    return pairs.select("*", *names).join(judged.select(*names), ["_a", "_b"], "left_anti").select("x", "y")


def link_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, text_col: str = "text",
                    id_col: str = "doc_id", star_rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    rows = shared_table(signatures(docs, sketch(docs, k, text_col), k, percent, text_col, id_col), "signatures")
    linked = rows.where("n > 0 AND doc_id IS NOT NULL")
    member = shared_table(linked.select("doc_id", "k1", "k2").join(
        linked.groupBy("k1", "k2").agg(F.min("doc_id").alias("cid")), ["k1", "k2"]), "members")
    copies = shared_table(member.where("doc_id <> cid").select("doc_id", "k1", "k2").distinct(), "copies")
    heads = linked.join(small_side(copies, 1_000_000), ["doc_id", "k1", "k2"], "left_anti").select(
        F.col("doc_id").alias("cid"), "n", F.posexplode("prefix").alias("place", "shingle"))

    # postings of the shingles that two classes have, with the level from which they count
    shared = heads.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("cid").alias("lead"), F.max("cid").alias("top")).where("lead < top")
    need = F.expr(f"CAST(({percent} * n + 99) DIV 100 AS INT)")
    posts = heads.join(shared.drop("top"), "shingle").select(
        "cid", "n", "shingle", "df", "lead", F.greatest(F.lit(1), F.col("place") + 1 - (F.col("n") - need)).cast("int").alias("level"),
        need.alias("need"))
    posts = shared_table(posts, "postings")
    posts = shared_table(posts.join(_levels(posts), "cid").where("level <= l").drop("need"), "prefixes")

    # documents that stand in two classes (a repeated id with different texts) tie these together
    edges = member.join(member.groupBy("doc_id").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).where("a < z"), "doc_id").select("a", F.col("cid").alias("b"))
    edges = shared_table(edges, "edges")
    nodes = posts
    maps = linked.join(posts.select(F.col("cid").alias("doc_id")).distinct(), "doc_id", "left_semi").groupBy(
        F.col("doc_id").alias("cid")).agg(F.collect_set("bits").alias("maps"), F.first("n").alias("n"))
    # an id with several texts gets no map: it is verified whatever the maps say
    maps = shared_table(maps.select("cid", F.when(F.size("maps") == 1, F.col("maps")[0]).alias("bits"), "n"), "maps")
    judged = None
    for _ in range(star_rounds):
        parts = components(edges)
        nodes = _current(posts, parts)
        block = nodes.groupBy("shingle").agg(F.min(F.struct("comp", "cid")).alias("m"))
        pairs = (nodes.join(block, "shingle").where("comp <> m.comp")
                 .groupBy(F.col("cid").alias("y"), F.col("m.cid").alias("x"))
                 .agg(F.count(F.lit(1)).alias("hits"), F.first("n").alias("n")))
        best = _plausible(pairs.groupBy("y").agg(F.max_by("x", F.struct("hits", -F.col("x"))).alias("x")), maps, percent)
        best = shared_table(best if judged is None else _unjudged(best, judged), "pairs")
        judged = best if judged is None else judged.unionByName(best)
        found = verify(best, docs, k, percent, text_col, id_col)
        edges = shared_table(edges.union(found.select("x", "y")), "edges")

    # all that is left between components
    parts = components(edges)
    nodes = shared_table(_current(posts, parts), "nodes")
    sides = nodes.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = sides.groupBy("shingle").agg(F.count(F.lit(1)).alias("parts"), F.max_by("comp", F.struct("c", "comp")).alias("main")).where("parts > 1").drop("parts")
    live = shared_table(nodes.join(mixed, "shingle").select("shingle", "cid", "comp", "n", "l", "level", "main"), "live")
    live = live.join(maps.drop("n"), "cid")
    live = shared_table(live.select("*", *[F.col("bits")[i].alias(f"b{i}") for i in range(8)]).drop("bits"), "live")
    x, y = live.where("comp <> main").alias("x"), live.alias("y")
    # two sets differ in at least as many shingles as their parity maps differ in cells
    apart = sum((F.bit_count(F.col(f"x.b{i}").bitwiseXOR(F.col(f"y.b{i}"))) for i in range(8)), F.lit(0))
    both = F.col("x.n") + F.col("y.n")
    most = both - 2 * F.floor((percent * both + 99 + percent) / (100 + percent))
    fits = ((F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid")))
            & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
            & (F.greatest("x.level", "y.level") <= F.least("x.l", "y.l")) & (F.coalesce(apart, F.lit(0)) <= most))
    # the side is counted from each end, so a pair is always (smaller id, larger id)
    hits = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & fits).groupBy(
        F.least("x.cid", "y.cid").alias("x"), F.greatest("x.cid", "y.cid").alias("y")).agg(
        F.count(F.lit(1)).alias("hits"), F.first(F.least("x.l", "y.l")).alias("l"))
    rest = hits.where("hits >= l").select("x", "y")
    rest = shared_table(rest if judged is None else _unjudged(rest, judged), "pairs")
    edges = shared_table(edges.union(verify(rest, docs, k, percent, text_col, id_col).select("x", "y")), "edges")

    parts = components(edges)
    where = member.select("doc_id", "k1", "k2", "cid").distinct()
    out = rows.select("doc_id", "k1", "k2", "n").join(where, ["doc_id", "k1", "k2"], "left")
    out = out.join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                      F.coalesce("component", "cid", "doc_id").alias("component_id"))


def _levels(posts: DataFrame) -> DataFrame:
    """cid, l: the level of least estimated cost for each document."""
    sums = posts.groupBy("cid").agg(F.first("n").alias("n"), F.first("need").alias("need"), *[
        F.sum(F.when(F.col("level") <= l, F.col("df")).otherwise(0)).alias(f"s{l}") for l in range(1, MAX_LEVEL + 1)])
    costs = F.array(*[F.when(F.col("need") >= l, F.struct(
        (F.col(f"s{l}") * (1 + VERIFY_WEIGHT * F.col("n") / l)).alias("cost"), F.lit(l).alias("l")))
        for l in range(1, MAX_LEVEL + 1)])
    return sums.select("cid", F.array_min(F.filter(costs, lambda c: c.isNotNull()))["l"].alias("l"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return link_components(documents(spark, sf_dir, "doc_id", "text"))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, the one that names it."""
    parts = link_components(docs, 5, 80)
    gone = shared_table(parts.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(small_side(gone, 2_000_000), "doc_id", "left_anti").select(*docs.columns)
