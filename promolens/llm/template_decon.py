"""Operator 7: benchmark decontamination by templates.

Names, numbers and units of a text become typed placeholders, so a question
that was re-parameterised keeps its template.  Windows of ``k`` template words
of every document are hash-joined with the windows of the benchmark items.  A
document leaks an item when the matched windows cover at least ``min_cover`` of
the item's windows, or ``min_run`` of them lie on one alignment (an excerpt of
``min_run`` + ``k`` - 1 words, whatever the item's length), and its slots are
consistent: along one alignment each value of the item stands for one value in
the document (``min_slots`` of the slots at least; a copy maps every value to itself).

* Each text has two templates: one with names, numbers and units, and a
  case-folded one with numbers and units only, as capitals tell nothing about
  names in a title or in a text of capitals.  Windows match within one kind.
* Windows with fewer than ``MIN_LITERAL`` words outside placeholders are not
  joined on either side: tables of numbers match nothing.
* An item shorter than ``k`` words is one window of its own length; windows of
  that length are joined too.
* The benchmark's windows are broadcast while there are at most
  ``MAX_BROADCAST`` of them (they are counted), else joined by shuffle.  Only
  matched windows are grouped; the texts of matched documents are read again
  for their slots.

All of it is DataFrame functions.

Defined results: null and empty texts have no windows; items without words are
never leaked; rows with one doc_id are one document, a null doc_id is one
document as well; a null item_id is an item like any other; repeated items and documents give one pair each; extra
columns are not read.  Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.llm.common import documents, paired, shared_table, small_side, table, words_of

WINDOW, MIN_COVER, MIN_RUN, MIN_SLOTS, MIN_LITERAL = 8, 0.5, 12, 0.8, 3
MAX_BROADCAST = 2_000_000
UNITS = ("mm", "cm", "dm", "m", "km", "in", "ft", "yd", "mi", "mg", "g", "kg", "t", "oz", "lb", "lbs", "ml", "cl", "l",
         "s", "sec", "min", "h", "hr", "hrs", "seconds", "minutes", "hours", "days", "weeks", "months", "years",
         "meters", "metres", "kilometers", "kilometres", "miles", "feet", "inches", "grams", "kilograms", "pounds",
         "liters", "litres", "dollars", "euros", "cents", "percent", "degrees", "mph", "kmh")
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"


def template(text: Column, names: bool = True) -> Column:
    """The text with placeholders, without closing punctuation, in lower case.
    White space is untouched, so its words stand at the places of the text's."""
    t = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "???")
    # a capital inside a sentence: after a letter, digit or comma and one space
    t = F.regexp_replace(t, r"\p{Lu}(?<=[\p{L}\p{N},;] \p{Lu})[\p{L}'’-]*", NAME) if names else F.lower(t)
    # what is rare comes first in each pattern; a look behind at every character costs most
    number = r"[$€£]?\d+(?:[.,:/]\d+)*%?"
    t = F.regexp_replace(t, rf"{number}( ?)(?:{'|'.join(UNITS)})(?!\p{{L}})", f"{NUMBER}$1{UNIT}")
    t = F.regexp_replace(t, number, NUMBER)
    t = F.regexp_replace(t, r"[.,;:!?\"')\]](?<=[\p{L}\p{N}\x01-\x03].)[.,;:!?\"')\]]*(?=\s|$)", "")
    return F.lower(t) if names else t


def _templates(text: Column) -> Column:
    return F.array(template(text), template(text, names=False))


def _literal(word: Column) -> Column:
    return ~word.rlike("[\x01-\x03]")


def _windows(df: DataFrame, own: list[str], lengths: list[int], words: str) -> DataFrame:
    """``own``, length, place and hash of every window of the word array ``words``."""
    df = df.select(*own, F.transform(words, lambda w: F.xxhash64(w)).alias("_1"))
    spans, at = [1], 1
    while at < max(lengths):
        step = min(at, max(lengths) - at)
        df = df.select(*own, *(f"_{s}" for s in spans), paired(F.col(f"_{at}"), step).alias(f"_{at + step}"))
        at += step
        spans.append(at)
    extra = [m for m in lengths if m not in spans]
    for m in extra:
        base = max(s for s in spans if s < m)
        df = df.select("*", paired(F.col(f"_{base}"), m - base).alias(f"_{m}"))
    # outer: the filter that a plain explode brings along would copy the chain of expressions into itself
    parts = [df.select(*own, F.lit(m).alias("len"), F.posexplode_outer(f"_{m}").alias("at", "h")).where("h IS NOT NULL")
             for m in sorted(lengths, reverse=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, k: int, min_cover: float, min_run: int, text_col: str,
            id_col: str) -> tuple[DataFrame | None, DataFrame]:
    """doc_id, item_id, at (document), i_at (item), len, m (windows), cover of the pairs with enough windows."""
    # the item's id is wrapped, so that a null one joins like any other
    items = benchmark.select(F.struct("item_id").alias("item_id"), F.col("text").alias("raw")).distinct()
    items = items.select("item_id", "raw", _templates(F.col("raw")).alias("t"))
    items = items.select("item_id", words_of(F.col("raw")).alias("raw"), words_of(F.col("t")[0]).alias("words"), words_of(F.col("t")[1]).alias("folded"))
    items = shared_table(items.withColumn("size", F.least(F.size("words"), F.lit(k))), "items").where("size > 0")
    lengths = sorted(r[0] for r in items.select("size").distinct().collect())             # at most k numbers
    if not lengths:
        return None, items
    bench = items.select("item_id", "size", F.posexplode_outer(F.array("words", "folded")).alias("kind", "words"))
    bench = _windows(bench, ["item_id", "size", "kind", "words"], lengths, "words").where("len = size")
    literal = F.size(F.filter(F.slice("words", F.col("at") + 1, F.col("len")), _literal))
    bench = bench.where(literal >= F.least(F.lit(MIN_LITERAL), F.col("len")))
    bench = shared_table(bench.select("item_id", "kind", "len", F.col("at").alias("i_at"), "h"), "bench")
    total = bench.groupBy("item_id").agg(F.countDistinct("i_at").alias("n"))
    # the templates are a column behind a generator: ``words_of`` looks at its text several times
    texts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode_outer(_templates(F.col(text_col))).alias("kind", "words"))
    texts = texts.select("doc_id", "kind", words_of(F.col("words")).alias("words"))
    found = _windows(texts, ["doc_id", "kind"], lengths, "words").join(small_side(bench, MAX_BROADCAST), ["h", "len", "kind"])
    found = shared_table(found.drop("h", "kind").distinct(), "found")
    cover = found.groupBy("doc_id", "item_id").agg(F.countDistinct("i_at").alias("m")).join(total, "item_id").select(
        F.col("doc_id").alias("d"), F.col("item_id").alias("i"), "m", (F.col("m") / F.col("n")).alias("cover"))
    runs = found.groupBy("doc_id", "item_id", (F.col("at") - F.col("i_at")).alias("shift")).agg(F.count(F.lit(1)).alias("run")).where(
        F.col("run") >= min_run).select(F.col("doc_id").alias("rd"), F.col("item_id").alias("ri"), F.lit(True).alias("long")).distinct()
    cover = cover.join(runs, F.col("d").eqNullSafe(F.col("rd")) & (F.col("i") == F.col("ri")), "left").where(
        F.col("long") | (F.col("cover") >= min_cover)).drop("rd", "ri", "long")
    hit = found.join(cover, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("item_id") == F.col("i"))).drop("d", "i")
    return shared_table(hit, "hits"), items


def _slots(hits: DataFrame, items: DataFrame, docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """doc_id, item_id, slots, agreeing: the slots under matched windows, and
    those whose value is the usual partner of the item's value on that alignment."""
    ids = shared_table(hits.select(F.col("doc_id").alias("d")).distinct(), "ids")
    text = docs.select(F.col(id_col).alias("d2"), F.col(text_col).alias("text")).join(small_side(ids), F.col("d2").eqNullSafe(F.col("d"))).select("d", "text").distinct()
    own = text.select("d", words_of(F.col("text")).alias("doc_raw"), template(F.col("text")).alias("t"))
    own = own.select("d", "doc_raw", words_of(F.col("t")).alias("doc_words"))
    places = hits.select("doc_id", "item_id", (F.col("at") - F.col("i_at")).alias("shift"), F.explode(
        F.sequence("i_at", F.col("i_at") + F.col("len") - 1)).alias("p")).distinct()
    places = places.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("shift", "p")).alias("places"))   # at most an item's words per alignment
    both = places.join(own, F.col("doc_id").eqNullSafe(F.col("d"))).join(items.select("item_id", "raw", "words"), "item_id")
    flat = both.select("doc_id", "item_id", "raw", "words", "doc_raw", "doc_words", F.explode("places").alias("x"))
    at = F.col("x.shift") + F.col("x.p")
    # repeated ids may hold texts in which the place does not exist
    flat = flat.where((at < F.size("doc_words")) & ~_literal(F.element_at("words", F.col("x.p") + 1)))
    clean = lambda w: F.lower(F.regexp_replace(w, r"[.,;:!?\"')\]]+$", ""))
    flat = flat.select("doc_id", "item_id", F.col("x.shift").alias("shift"), F.element_at("words", F.col("x.p") + 1).alias("kind"),
                       clean(F.element_at("raw", F.col("x.p") + 1)).alias("v"), clean(F.element_at("doc_raw", at + 1)).alias("u"))
    votes = flat.groupBy("doc_id", "item_id", "shift", "kind", "v", "u").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("doc_id", "item_id", "shift", "kind", "v").agg(F.max("c").alias("c"), F.sum("c").alias("all"))
    return best.groupBy(F.col("doc_id").alias("sd"), F.col("item_id").alias("si")).agg(F.sum("all").alias("slots"), F.sum("c").alias("agreeing"))


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, min_cover: float = MIN_COVER,
          min_run: int = MIN_RUN, min_slots: float = MIN_SLOTS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, item_id, n_windows, cover, n_slots, slot_share of every leaked item."""
    hits, items = matches(docs, benchmark, k, min_cover, min_run, text_col, id_col)
    if hits is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows long, cover double, n_slots long, slot_share double")
    pairs = hits.select("doc_id", "item_id", F.col("m").alias("n_windows"), "cover").distinct()
    slots = _slots(hits, items, docs, text_col, id_col)
    out = pairs.join(slots, F.col("doc_id").eqNullSafe(F.col("sd")) & (F.col("item_id") == F.col("si")), "left")
    share = F.when(F.coalesce("slots", F.lit(0)) > 0, F.col("agreeing") / F.col("slots")).otherwise(F.lit(1.0))
    return out.select("doc_id", "item_id.item_id", F.col("n_windows").cast("long").alias("n_windows"), "cover",
                      F.coalesce("slots", F.lit(0)).cast("long").alias("n_slots"), share.alias("slot_share")).where(F.col("slot_share") >= min_slots)


def op7_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (doc_id, item_id) of ``documents`` that leaks an item of ``benchmark``."""
    return leaks(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that leak a benchmark item go."""
    gone = shared_table(leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_gone")).distinct(), "leaks")
    return docs.join(small_side(gone, MAX_BROADCAST), F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti").select(*docs.columns)
