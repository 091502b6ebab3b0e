"""Operator 4: quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over ``buckets`` hashed word unigrams and bigrams: one of
trusted target texts, one of the whole raw corpus.  A document's score is
``sum(log(P_target / P_raw)) / n-grams``, so its length does not matter, and
every document is judged by the same threshold: no sampling, no ties to break, no
dependence on partitioning.  The threshold is fixed but for the model's own
uncertainty: a text that the target was not fitted on scores lower by about half the
variance of an estimated log share, ``buckets / (2 * target n-grams)``, and that much
is allowed for (0.03 at 200 target texts, nothing to speak of at 2,000).

* The target is fitted on at most ``max_target`` labelled documents (quality 1
  and not toxic; beyond the bound those with the smallest id hash).  Their ids
  are the only broadcast, bounded by that parameter.
* Each distinct text weighs once in both models (grouped by its digest; it is
  trusted when one of its copies is): a text cannot lower its own score by being
  copied.  Only digests and ids are grouped.  The groups of several rows are
  broadcast while few (counted), else joined by a shuffle of the texts; the row
  with the least id stands for its group.
* The raw counts cover every n-gram of every distinct text, pre-aggregated in
  each task: the shuffle carries ``buckets`` rows a task at most.
* The model is ``buckets`` numbers; it is put into the plan as a literal, so
  scoring is a projection of the scan, without a shuffle.
* Toxic documents of good quality pass that mean, which dilutes a few words.  So
  words that labelled toxic texts hold at least ``TOXIC_RATIO`` times as often as
  texts labelled not toxic (document frequencies over distinct texts, at least
  ``TOXIC_LEAST`` toxic ones) carry the log of that ratio, and a document is
  rejected when the sum over its words, ``toxic_score``, is ``TOXIC_THRESHOLD`` or
  more.  Whole word hashes are used: in the shared buckets the other words of a
  bucket drown them.  At most ``max_target`` texts of each kind are read for this,
  and the strongest ``MAX_TOXIC`` words are kept.

All of it is DataFrame functions.

Defined results: a null text has no words (all counts 0, rejected by the base
rules); a text without n-grams scores 0; a null id is judged like any other
row; repeated rows are judged alike; labels of unknown documents, null labels
and other columns have no effect (documents' own columns pass through, a
column named like one of the results is replaced).  With no trusted document
or no text at all both models are the same and every score is 0; without toxic
labels every toxic score is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import documents, paired, shared_table, small_side, table, words_of

BUCKETS, ALPHA, PRIOR, THRESHOLD, MAX_TARGET = 16_384, 1.0, 100_000.0, -0.05, 200_000
TOXIC_RATIO, TOXIC_LEAST, TOXIC_THRESHOLD, MAX_TOXIC = 20.0, 5, 6.0, 4096
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "toxic_score", "kept")


def trusted_ids(labels: DataFrame, max_target: int = MAX_TARGET) -> DataFrame:
    """Ids of at most ``max_target`` documents labelled good and not toxic."""
    good = (labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id")
            .agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
            .where((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)))
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target).select("doc_id")


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(gram, F.lit(buckets).cast("long")).cast("int")


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _once(rows: DataFrame, mark: str) -> DataFrame:
    """``rows`` (_id, _text, ``mark``) without the copies of a text: _text, the
    largest ``mark`` of the copies and _weight, 1 (rows that repeat id and text
    share it)."""
    rows = rows.withColumn("_d", F.md5("_text"))
    copies = (rows.groupBy("_d", "_id").agg(F.count(F.lit(1)).alias("n"), F.max(mark).alias("mark"))
              .groupBy("_d").agg(F.sum("n").alias("all"), F.min(F.struct("_id", "n")).alias("first"), F.max("mark").alias("mark")))
    copies = shared_table(copies.where("_d IS NOT NULL AND all > 1").select(
        "_d", F.col("first._id").alias("least"), F.col("first.n").alias("n"), "mark", F.lit(True).alias("several")), "copies")
    return (rows.join(small_side(copies), "_d", "left").where(F.col("several").isNull() | F.col("_id").eqNullSafe(F.col("least")))
            .select("_text", F.when(F.col("several"), F.col("mark")).otherwise(F.col(mark)).alias(mark),
                    (1.0 / F.coalesce("n", F.lit(1))).alias("_weight")))


class Model(list):
    """log(P_target / P_raw) of each bucket; ``allowance`` is what an unseen text
    scores too low on average."""

    allowance = 0.0


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, alpha: float = ALPHA, prior: float = PRIOR,
        max_target: int = MAX_TARGET, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """log(P_target / P_raw) of each bucket."""
    good = trusted_ids(labels, max_target).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_good"))
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(good), "_id", "left"))              # bounded by max_target
    rows = (_once(rows, "_good")
            .select("_weight", "_good", _word_hashes(words_of(F.col("_text"))).alias("_h"))
            # outer: the filter that a plain explode brings along would evaluate the words once more
            .select("_weight", "_good", F.explode_outer(F.concat("_h", paired(F.col("_h"), 1))).alias("_g")).where("_g IS NOT NULL")
            .select("_weight", F.when(F.col("_good") == 1, F.col("_weight")).otherwise(0.0).alias("_t"), _bucket(F.col("_g"), buckets).alias("_b")))
    counts = rows.groupBy("_b").agg(F.sum("_weight").alias("r"), F.sum("_t").alias("t")).collect()   # <= buckets rows
    raw, target = [alpha] * buckets, [0] * buckets
    for b, r, t in counts:
        raw[b] += r
        target[b] = t
    n_raw, n_target = sum(raw), sum(target)
    # the target's prior is the raw model, so a small target says little instead of the wrong thing
    model = Model(math.log((t + prior * r / n_raw) / (n_target + prior)) - math.log(r / n_raw) for t, r in zip(target, raw, strict=True))
    if n_target:
        model.allowance = buckets / (2 * (n_target + prior))
    return model


def toxic_words(docs: DataFrame, labels: DataFrame, ratio: float = TOXIC_RATIO, least: int = TOXIC_LEAST,
                max_target: int = MAX_TARGET, max_words: int = MAX_TOXIC, text_col: str = "text", id_col: str = "doc_id") -> dict[int, float]:
    """log(share of toxic texts / share of other texts) by hash of the strongly toxic words."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    sides = [marks.where(F.col("_toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_target) for t in (0, 1)]
    ids = sides[0].union(sides[1]).select(F.col("doc_id").alias("_id"), F.col("_toxic").cast("long").alias("_toxic"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(ids), "_id")   # bounded by max_target
    rows = (_once(rows, "_toxic")
            .select("_weight", "_toxic", F.array_distinct(_word_hashes(words_of(F.col("_text")))).alias("_h"))
            # one null a text: the number of texts of either kind
            .select("_weight", "_toxic", F.explode(F.concat("_h", F.array(F.lit(None).cast("long")))).alias("_g")))
    counts = rows.groupBy("_g").agg(F.sum(F.col("_weight") * F.col("_toxic")).alias("t"), F.sum(F.col("_weight") * (1 - F.col("_toxic"))).alias("c"))
    counts = shared_table(counts.where((F.col("t") >= least) | F.col("_g").isNull()), "toxic-words")
    n = counts.where("_g IS NULL").first() or {"t": 0, "c": 0}
    if not n["t"] or not n["c"]:
        return {}
    share = (F.col("t") / n["t"]) / ((F.col("c") + 1) / (n["c"] + 1))
    strong = counts.where("_g IS NOT NULL").withColumn("share", share).where(F.col("share") >= ratio)
    return {x["_g"]: math.log(x["share"]) for x in strong.orderBy(F.desc("share"), F.desc("t"), "_g").limit(max_words).collect()}


def _with_repeat_words(df: DataFrame, own: list[str], k: int = 8) -> DataFrame:
    """``df`` with ``n_repeat_words``: the words inside windows (``_win``) that
    are found twice or more in the text.

    Most texts repeat no window: a set of the window hashes tells, and the
    rest is null for them.  The others sort (hash, place) pairs, keep those
    with an equal neighbour and add up the words that they cover.  Each step is
    a column of its own, so that it is computed once and not in every lambda."""
    w = F.col("_win")
    df = df.select(*own, F.when(F.size(F.array_distinct(w)) < F.size(w), F.sort_array(
        F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_pairs"))
    pairs, last = F.col("_pairs"), F.size("_pairs") - 1
    again = F.filter(pairs, lambda x, j: (
        ((j > 0) & (pairs[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
        | ((j < last) & (pairs[F.least(j + 1, last)]["h"] == x["h"]))))
    df = df.select(*own, F.sort_array(F.transform(again, lambda x: x["i"])).alias("_places"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    cover = F.aggregate("_places", zero, lambda acc, p: F.struct(
        (p + k).alias("end"), (acc["n"] + p + k - F.greatest(acc["end"], p)).alias("n")))["n"]
    return df.select(*own, F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"))


def judge(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, text_col: str = "text",
          toxic: dict[int, float] | None = None, toxic_threshold: float = TOXIC_THRESHOLD) -> DataFrame:
    """``docs`` with the counts of the base rules, ``score``, ``toxic_score`` and ``kept``."""
    own = [c for c in docs.columns if c not in RESULTS]
    text = F.coalesce(F.col(text_col), F.lit(""))
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.select(*own, words_of(F.col(text_col)).alias("_w"), lines.alias("_l"),
                     F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    df = df.select(*own, "n_symbols", F.size("_w").cast("long").alias("n_words"),
                   F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
                   (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                   _word_hashes(F.col("_w")).alias("_h"))
    base = [*own, "n_symbols", "n_words", "word_chars", "n_dup_lines"]
    df = df.select(*base, "_h", paired(F.col("_h"), 1).alias("_2"))

    def total(grams: str) -> Column:
        return F.aggregate(grams, F.lit(0.0), lambda s, g: s + weights[_bucket(g, len(model))])

    toxic_score = F.lit(0.0)
    if toxic:
        # few words pass the filter, a set; the weight is searched in a list only for them
        hashes, heavy = (F.split(F.lit(",".join(x)), ",") for x in zip(*((str(h), f"{v:.6f}") for h, v in toxic.items()), strict=True))
        hashes, heavy = hashes.cast("array<long>"), heavy.cast("array<double>")
        toxic_score = F.aggregate(F.filter("_h", lambda h: h.isin(list(toxic))), F.lit(0.0),
                                  lambda s, h: s + F.element_at(heavy, F.array_position(hashes, h).cast("int")))
    n_grams = F.size("_h") + F.size("_2")
    df = df.select(*base, toxic_score.alias("toxic_score"), F.when(n_grams > 0, (total("_h") + total("_2")) / n_grams).otherwise(F.lit(0.0)).alias("score"),
                   paired(F.col("_2"), 2).alias("_4"))
    base.append("toxic_score")
    df = df.select(*base, "score", paired(F.col("_4"), 4).alias("_win"))       # windows of eight words
    df = _with_repeat_words(df, [*base, "score"])
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold - getattr(model, "allowance", 0.0)) & (F.col("toxic_score") < toxic_threshold)).select(*own, *RESULTS)


def op4_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document, and its scores."""
    docs, labels = documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "labels")
    return judge(docs, fit(docs, labels), toxic=toxic_words(docs, labels)).drop("text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep."""
    labels = table(spark, sf_dir, "labels")
    judged = judge(docs, fit(docs, labels), toxic=toxic_words(docs, labels))
    # a filter on ``kept`` itself would be pushed down and copy the whole chain of
    # expressions into itself; one behind a generator is not
    mark = F.explode_outer(F.when(F.col("kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return judged.select(*docs.columns, mark.alias("_kept")).where("_kept IS NOT NULL").drop("_kept")
