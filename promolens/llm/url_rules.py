"""Operator 1: URL filters from association rules.

A url becomes a set of tokens (scheme, host, parent domains, host prefix, path
words, file ending, query names).  Over the urls whose label is bad (low quality
or toxic) Spark's FP-growth mines the frequent token sets; single tokens are
counted besides, down to ``min_count`` bad urls.  How many labelled urls hold a
set is counted by the inverted index below.  A rule ``tokens -> bad`` is kept when

* it has at least ``min_count`` bad urls; a set of several tokens also
  ``min_support`` of the bad urls.  So a host with three bad urls is caught in a
  corpus of any size, parts of a mixed host only from 0.1% of the bad urls on,
* its confidence is at least ``min_confidence``, and
* no rule on a part of its tokens is as confident (the longer one adds nothing).

Rules are matched by an inverted index: each rule hangs under its rarest token;
the distinct token sets of the corpus (urls with the same one are folded) are
exploded, joined with the index by token, and a rule holds when the set has all
its tokens.  Hand-written (host, path) rules go first: the longest fitting rule
gives the verdict; without one the mined rules block, else the url is allowed.

All of it is DataFrame functions and Spark ML's FP-growth; its frequent single
tokens, which FP-growth keeps on the driver, are at most (tokens a url) /
``min_support``.

Defined results: a null url, or one without ``://``, has empty host and path
and no tokens, so it is allowed; null ids, repeated rows and extra columns pass
through (result columns are replaced); a label of an unknown page, or with both
values null, is not used; without labels nothing is mined.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import shared_table, small_side, table

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MAX_TOKENS = 0.001, 3, 0.5, 3
RESULTS = ("host", "path", "rule", "verdict")
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, *LOWER)


def path_of(url: Column) -> Column:
    """Behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def hand_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct (verdict, rule), or null."""
    fitting = []
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        fitting.append(F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))))
    return F.coalesce(*fitting)


def tokens_of(url: Column) -> Column:
    """Sorted set of a url's tokens; numbers in the path are one token."""
    url = F.coalesce(url, F.lit(""))
    host, path = host_of(url), F.translate(path_of(url), *LOWER)
    label = F.split(host, r"\.")
    parents = F.transform(F.sequence(F.lit(2), F.greatest(F.size(label), F.lit(2))), lambda i: F.concat(
        F.lit("domain:"), F.array_join(F.slice(label, i, F.size(label)), ".")))
    words = F.transform(F.array_remove(F.split(F.regexp_replace(path, r"\d+", "0"), r"[^\p{L}\p{N}]+"), ""), lambda w: F.concat(F.lit("path:"), w))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    names = F.transform(F.array_remove(F.split(query, "&"), ""), lambda x: F.concat(F.lit("query:"), F.element_at(F.split(x, "="), 1)))
    ending = F.regexp_extract(path, r"\.([a-z0-9]{1,5})$", 1)
    one = lambda cond, x: F.when(cond, F.array(x)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    all_ = F.concat(
        one(F.lit(True), F.concat(F.lit("scheme:"), F.regexp_extract(url, r"(?s)^(.*?)://", 1))),
        one(F.lit(True), F.concat(F.lit("host:"), host)),
        F.when(F.size(label) > 1, parents).otherwise(none),
        one(F.size(label) > 2, F.concat(F.lit("prefix:"), label[0])),
        words, one(ending != "", F.concat(F.lit("ending:"), ending)), names)
    return F.when(host != "", F.array_sort(F.array_distinct(all_))).otherwise(none)


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT,
         min_confidence: float = MIN_CONFIDENCE, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """tokens, hits, confidence of the mined rules.  ``pages``: id, url."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    marks = labels.where("quality IS NOT NULL OR toxic IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max(bad.cast("int")).alias("bad"))
    baskets = pages.join(marks, "id").select(tokens_of(F.col("url")).alias("t"), "bad").where(F.size("t") > 0)
    baskets = shared_table(baskets, "baskets")
    total = baskets.where("bad = 1").count()
    spark = pages.sparkSession
    if not total:
        return spark.createDataFrame([], "tokens array<string>, hits long, confidence double")
    least = max(min_count, math.ceil(min_support * total))
    sets = FPGrowth(itemsCol="t", minSupport=(least - 0.5) / total, minConfidence=1.0).fit(baskets.where("bad = 1").select("t")).freqItemsets
    sets = sets.where(F.size("items") <= max_tokens).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("hits"))
    single = baskets.where("bad = 1").select(F.explode("t").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("hits"))
    sets = sets.where(F.size("tokens") > 1).union(single.where(F.col("hits") >= min_count).select(F.array("x"), "hits"))
    folded = shared_table(baskets.groupBy("t").agg(F.count(F.lit(1)).alias("n")), "labelled")
    held = _holding(folded, _index(sets, folded, "hits")).groupBy("tokens").agg(F.first("hits").alias("hits"), F.sum("n").alias("freq"))
    rules = held.select("tokens", "hits", (F.col("hits") / F.col("freq")).alias("confidence")).where(F.col("confidence") >= min_confidence)
    rules = shared_table(rules, "rules")
    # parts of a rule's tokens: leaving any one or more out (at most 2 ** max_tokens - 2 of them)
    parts = F.filter(F.transform(F.sequence(F.lit(1), F.shiftleft(F.lit(1), max_tokens) - 2), lambda m: F.filter(
        F.col("tokens"), lambda _, i: F.pmod(F.floor(m / F.pow(F.lit(2.0), i)), F.lit(2)) == 1)),
        lambda p: (F.size(p) > 0) & (F.size(p) < F.size(F.col("tokens"))))
    weaker = rules.select("tokens", "confidence", F.explode(F.array_distinct(parts)).alias("part")).join(
        rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("c")), "part").where("c >= confidence").select("tokens").distinct()
    return rules.join(weaker, "tokens", "left_anti")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens (of urls) that hold a rule, with the most confident one's confidence."""
    sets = shared_table(pages.select(F.xxhash64("url").alias("u"), tokens_of(F.col("url")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")), "tokensets")
    return _holding(sets, _index(rules, sets, "confidence")).groupBy("t").agg(F.max("confidence").alias("confidence"))


def _index(rules: DataFrame, sets: DataFrame, value: str) -> DataFrame:
    """token, tokens, ``value``: each rule under the token that fewest urls of ``sets`` (t, n) have."""
    rules = rules.withColumn("rid", F.monotonically_increasing_id())
    used = shared_table(rules, "rules")
    words = used.select(F.explode("tokens").alias("token")).distinct()
    counts = sets.select("n", F.explode("t").alias("token")).join(small_side(shared_table(words, "tokens")), "token").groupBy("token").agg(F.sum("n").alias("n"))
    index = used.select("rid", "tokens", value, F.explode("tokens").alias("token")).join(counts, "token").groupBy("rid").agg(
        F.min_by("token", F.struct("n", "token")).alias("token"), F.first("tokens").alias("tokens"), F.first(value).alias(value))
    return shared_table(index.drop("rid"), "index")


def _holding(sets: DataFrame, index: DataFrame) -> DataFrame:
    """The rows of ``sets`` with each rule all of whose tokens they have."""
    return sets.select("t", "n", F.explode("t").alias("token")).join(small_side(index), "token").where(F.size(F.array_except("tokens", "t")) == 0)


def judge(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))
    found = match(urls, mine(urls, labels))
    found = shared_table(found, "blocked").withColumnRenamed("t", "_t").withColumn("_blocked", F.lit(True)).drop("confidence")
    url = F.col(url_col).cast("string")
    own = [c for c in pages.columns if c not in RESULTS or c in (id_col, url_col)]
    df = pages.select(*own, host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("_t"))
    df = df.join(small_side(found, 100_000), "_t", "left").withColumn("_hand", hand_rule(F.col("host"), F.col("path"), rules))
    mined = F.when(F.col("_blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return df.select(*own, "host", "path", F.col("_hand.rule").alias("rule"), F.coalesce(F.col("_hand.verdict"), mined).alias("verdict"))


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, table(spark, sf_dir, "labels")).drop("url")
