"""Operator 8: line dedup as an exact set-similarity join.

Every line of every document is the set of its tokens, which are its words.
Two lines are alike when their sets have a Jaccard similarity of ``percent`` /
100 or more.  A line is removed when a like line stands earlier in the corpus
(by doc_id, then line number); it is judged on the input, so removals do not
depend on each other.

1. Rarity.  ``BUCKETS`` counters (bounded) hold the corpus frequency of the
   words by hash; words are ordered by their counter's magnitude, then hash:
   one global order with rare words first.  The counters are put into the plan
   as a literal.  They decide the cost only, never the result.
2. Equal sets are one class (128-bit digest) with its first place in the
   corpus, found by a grouped minimum; a hot line is one class.  Sets of fewer
   than ``_least`` words are like equal sets only and go no further.
3. Prefix filter: like sets share one of their first ``n - need(n) + 1`` words.
   A prefix word that two sets share must also leave room for the overlap they
   need (positional filter) in sets of like size (length filter), and the two
   sets' parity maps (128 bits) may differ in no more bits than the sets in words.
   All three are conditions of the join by word, so no other pair leaves it.
4. Leader rounds: a class is compared with one class, at first the earliest, that
   has the same two neighbours among its rarest words (more words than sets of one
   size can differ in; of their pairs the ``LEAD`` with the least hash).  Where that is
   alike and earlier the class is decided.  Two rare words seldom meet but in like
   lines, so a round costs dense groups of any size a linear number of pairs.  In the
   later rounds the classes of these groups meet leaders by single prefix words.
5. The undecided classes are compared with every earlier class they meet by a
   prefix word; each pair is verified by its full sets.  Nothing is capped.

All of it is DataFrame functions.

Defined results: lines are split at ``\\n``; a line without words always stays.
A null text has no lines and stays null; an empty text is one empty line.
Rows with one doc_id are one document: occurrences at the same (doc_id, line
number) have the same place and do not remove each other, also when the row is
repeated.  A null doc_id comes before all others.  Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import discard, documents, shared_table, small_side, words_of

PERCENT = 80
BUCKETS = 1 << 17
#: words from which on a set has a second parity map
LONG = 64
NO_ID = -(1 << 63)
#: a class has leaders by so many pairs of its rarest words, in so many rounds
LEAD, ROUNDS = 8, 3


def _need(n: str | Column, percent: int) -> Column:
    """Least overlap of a set of ``n`` words with a like set."""
    n = F.col(n) if isinstance(n, str) else n
    return F.floor((n * percent + 99) / 100).cast("int")


def _prefix(n: str | Column, percent: int) -> Column:
    """How many of its rarest words a set of ``n`` words shares one of with each like set."""
    return (F.col(n) if isinstance(n, str) else n) - _need(n, percent) + 1


def _both_need(sizes: Column, percent: int) -> Column:
    """Least overlap of two like sets of ``sizes`` words together."""
    return F.floor((percent * sizes + 99 + percent) / (100 + percent))


def _front(n: str | Column, percent: int) -> Column:
    """Three more of the rarest words than a set of ``n`` can have apart from a like one of its size."""
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(4), n - _both_need(2 * n, percent) + 4).cast("int")


def _least(percent: int) -> int:
    """The smallest size of a set that can be like another set than its equal."""
    n = 1
    while percent < 100 and 100 * n < percent * (n + 1):
        n += 1
    return n


def _lines(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc, line (number), text of each line with a word."""
    lines = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                        F.posexplode_outer(F.split(F.col(text_col), "\n")).alias("line", "words"))
    return lines.where(F.col("words").rlike(r"[^\x20\x09-\x0D]"))


def _hashes(words: Column) -> Column:
    return F.transform(words_of(words), lambda w: F.xxhash64(w))


def rarity(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Magnitude (doublings above an eighth of the mean) of each word counter."""
    words = docs.select(F.explode_outer(words_of(F.col(text_col))).alias("w")).where("w IS NOT NULL")
    bucket = F.pmod(F.xxhash64("w"), F.lit(BUCKETS).cast("long")).alias("b")
    counts = words.select(bucket).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()   # <= BUCKETS rows
    mean = max(1.0, sum(r["n"] for r in counts) / BUCKETS)
    tiers = [0] * BUCKETS
    for r in counts:
        tiers[r["b"]] = int(8 * r["n"] / mean).bit_length()
    return tiers


def signatures(docs: DataFrame, tiers: list[int], percent: int, text_col: str, id_col: str) -> DataFrame:
    """doc, line, k1, k2 (digest), n (set size), h1, h2 (parity maps), prefix (rarest words, as
    many as a step needs) of each line with words."""
    order = F.split(F.lit(",".join(map(str, tiers))), ",").cast("array<int>")
    keys = ["doc", "line"]
    df = _lines(docs, text_col, id_col)
    # the sort key has the tier on top; its lower 56 bits are the word.  No tier is null, and
    # saying so lets the array be sorted as plain numbers
    tier = lambda t: F.coalesce(order[t.bitwiseAND(F.lit(BUCKETS - 1).cast("long")).cast("int")].cast("long"), F.lit(0).cast("long"))
    rank = lambda t: F.shiftleft(tier(t), 56).bitwiseOR(F.shiftrightunsigned(t, 8))
    df = df.select(*keys, F.sort_array(F.array_distinct(F.transform(_hashes(F.col("words")), rank))).alias("s"))
    one = F.lit(1).cast("long")
    # every word toggles a bit of the first map; of a long set, words with bit 6 one of the second
    parity = lambda words: F.aggregate(words, F.lit(0).cast("long"), lambda m, t: m.bitwiseXOR(
        F.call_function("shiftleft", one, t.bitwiseAND(F.lit(63).cast("long")).cast("int"))))
    second = F.filter("s", lambda t: t.bitwiseAND(F.lit(64).cast("long")) != 0)
    n = F.size("s")
    used = n >= _least(percent)
    return df.select(*keys, F.xxhash64("s").alias("k1"), F.xxhash64(F.lit(1), "s").alias("k2"), n.alias("n"),
                     F.when(used, parity("s")).otherwise(0).alias("h1"), F.when(n > LONG, parity(second)).otherwise(0).alias("h2"),
                     F.when(used, F.transform(F.slice("s", 1, F.greatest(_prefix(n, percent), _front(n, percent))), lambda t: t.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int"))).alias("prefix"))


def _sets(docs: DataFrame, places: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc, line, s (distinct words' hashes) of the lines at ``places`` (doc, line)."""
    ids = shared_table(places.groupBy("doc").agg(F.collect_set("line").alias("at")), "ids")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text")).join(small_side(ids, lists="at"), "doc")
    lines = texts.select("doc", "at", F.posexplode_outer(F.split("text", "\n")).alias("line", "words")).where(F.array_contains("at", F.col("line")))
    return shared_table(lines.select("doc", "line", F.array_distinct(_hashes(F.col("words"))).alias("s")), "sets")


def _alike(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """doc, line of each y in ``pairs`` (x, y: places) whose full set is like that of its x."""
    x = sets.select(F.struct("doc", "line").alias("x"), F.col("s").alias("sx"))
    y = sets.select(F.struct("doc", "line").alias("y"), F.col("s").alias("sy"))
    both = pairs.join(y, "y").join(x, "x").select(
        "y", F.size("sx").alias("nx"), F.size("sy").alias("ny"), F.size(F.array_intersect("sx", "sy")).alias("o"))
    near = both.where((F.col("o") > 0) & (100 * F.col("o") >= percent * (F.col("nx") + F.col("ny") - F.col("o"))))
    return shared_table(near.select("y.doc", "y.line").distinct(), "near")


def _plausible(percent: int) -> Column:
    """Whether x is earlier than y, and sizes and parity maps do not rule out that they are alike."""
    nx, ny = F.abs("x.n"), F.abs("y.n")
    xor = lambda h: F.col(f"x.{h}").bitwiseXOR(F.col(f"y.{h}"))
    apart = F.when((nx > LONG) & (ny > LONG), F.bit_count(xor("h1").bitwiseXOR(xor("h2"))) + F.bit_count(xor("h2"))).otherwise(F.bit_count(xor("h1")))
    first = (F.col("x.doc") < F.col("y.doc")) | ((F.col("x.doc") == F.col("y.doc")) & (F.col("x.line") < F.col("y.line")))
    return ((100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))
            & (apart <= nx + ny - 2 * _both_need(nx + ny, percent)) & first)


def _meeting(x: DataFrame, y: DataFrame, key: str, fits: Column) -> DataFrame:
    """Pairs (x, y: places, x earlier) with a common ``key`` that ``fits`` lets through."""
    return x.alias("x").join(y.alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & fits).select(
        F.struct("x.doc", "x.line").alias("x"), F.struct("y.doc", "y.line").alias("y")).distinct()


def _led(docs: DataFrame, heads: DataFrame, percent: int, text_col: str, id_col: str) -> DataFrame:
    """doc, line of the classes that are like one of their leaders."""
    front = F.least(F.size("prefix"), _front("n", percent))
    two = F.zip_with(F.slice("prefix", 1, front - 1), F.slice("prefix", 2, front - 1), lambda a, b: F.xxhash64(a, b))
    keys = F.when(front > 1, F.slice(F.sort_array(two), 1, LEAD)).otherwise(F.transform("prefix", lambda a: F.xxhash64(a)))
    keyed = heads.select("doc", "line", "n", "h1", "h2", F.explode_outer(keys).alias("key"))
    met = shared_table(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "met")
    groups = shared_table(keyed.join(small_side(met), "key"), "groups")
    sets = _sets(docs, groups, text_col, id_col)
    ids = shared_table(groups.select("doc", "line").distinct(), "ids")
    words = shared_table(heads.join(small_side(ids), ["doc", "line"], "left_semi").select(
        "doc", "line", "n", "h1", "h2", F.explode_outer(F.slice("prefix", 1, _prefix("n", percent))).alias("key")), "words")
    near = None
    leader = F.struct("doc", "line", "n", "h1", "h2")
    for k in range(ROUNDS):
        # the earliest of two words, of one word, then others at random: what is not like the one may be like the next
        side = words if k else groups
        live = side if near is None else side.join(small_side(near, 1_000_000), ["doc", "line"], "left_anti")
        lead = side.groupBy("key").agg(F.min_by(leader, F.xxhash64(F.lit(k), "doc", "line")).alias("m") if k > 1 else F.min(leader).alias("m")).select("key", "m.*")
        found = _alike(sets, shared_table(_meeting(lead, live, "key", _plausible(percent)), "leaders"), percent)
        near = found if near is None else shared_table(near.union(found), "near")
    for part in (sets, groups, words):
        discard(part)
    return near


def duplicate_lines(docs: DataFrame, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc, line of every line to remove."""
    rows = shared_table(signatures(docs, rarity(docs, text_col), percent, text_col, id_col), "lines")
    place = F.struct("doc", "line")
    firsts = shared_table(rows.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "classes")
    # repeats of a class go at once; only its first line is compared with other classes
    repeats = rows.join(small_side(firsts, 200_000), ["k1", "k2"]).where(place != F.col("first")).select("doc", "line")
    repeats = shared_table(repeats.distinct(), "repeats")
    discard(firsts)
    heads = rows.where("prefix IS NOT NULL").join(small_side(repeats, 1_000_000), ["doc", "line"], "left_anti").select(
        "doc", "line", "n", "h1", "h2", "prefix")
    heads = shared_table(heads, "heads")
    discard(rows)
    near = _led(docs, heads, percent, text_col, id_col)

    # a decided class has a negative ``n`` and leaves no room as y; so one exchange serves both sides
    marked = heads.join(small_side(near.withColumn("decided", F.lit(True)), 1_000_000), ["doc", "line"], "left").withColumn(
        "prefix", F.slice("prefix", 1, _prefix("n", percent))).withColumn("n", F.when(F.col("decided"), -F.col("n")).otherwise(F.col("n")))
    posts = marked.select("doc", "line", "n", "h1", "h2", F.posexplode_outer("prefix").alias("i", "token"))
    room = F.least(F.abs("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))   # the common word and what stands behind it
    fits = (room >= _both_need(F.abs("x.n") + F.abs("y.n"), percent)) & _plausible(percent)
    pairs = shared_table(_meeting(posts, posts, "token", fits), "pairs")
    discard(heads)
    sets = _sets(docs, pairs.select("x.doc", "x.line").union(pairs.select("y.doc", "y.line")), text_col, id_col)
    more = _alike(sets, pairs, percent)
    discard(sets)
    return shared_table(repeats.union(near).union(more).distinct(), "gone")


def remove_lines(docs: DataFrame, gone: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``gone_lines array<int>``, and ``text_col`` without these lines."""
    lists = shared_table(gone.groupBy("doc").agg(F.array_sort(F.collect_set("line")).alias("gone_lines")), "gone")
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    df = docs.drop("gone_lines").withColumn("_doc", key).join(small_side(lists, 100_000, "gone_lines").withColumnRenamed("doc", "_doc"), "_doc", "left").drop("_doc")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains("gone_lines", i))
    return df.withColumn(text_col, F.when(F.col("gone_lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")))


def op8_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_md5 (of the text that stays) of every document."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    lines = docs.withColumn("n_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)))
    out = remove_lines(lines, duplicate_lines(docs))
    return out.select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_removed"),
                      F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later like lines go; a document that loses all its words goes too."""
    out = remove_lines(docs, duplicate_lines(docs))
    out = out.where(F.col("gone_lines").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("gone_lines").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)
