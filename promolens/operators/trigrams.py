"""Substring search by a trigram index (FLT_LIKE).

``build`` makes two tables of a text column: postings (gram, id), range-partitioned and
sorted by gram and id, so a gram's postings lie together and a very common gram is
spread over several files; and frequencies (gram, n).  A search looks up how often the
term's trigrams occur (at most its length), reads the postings of the rarest one (a
pushed filter on a sorted column), and verifies these candidates with ``contains``.
Every text that holds the term holds all its trigrams, so nothing is lost.  Terms of
less than three characters have no trigram: they scan the table.

Size: one posting for each different trigram of a text, at most its length less two.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.session import scratch_path

GRAM = 3


def grams_of(text: Column) -> Column:
    """Different trigrams of a text (null or shorter text: none)."""
    n = F.coalesce(F.length(text), F.lit(0)) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(GRAM))))
                  ).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class TrigramIndex:
    postings: DataFrame          # gram, id
    frequencies: DataFrame       # gram, n

    def rarest(self, term: str) -> tuple[str, int] | None:
        """The term's rarest trigram and its number of texts (0: no text has it); None
        for a term without trigrams."""
        grams = sorted({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)})
        if not grams:
            return None
        known = {r.gram: r.n for r in self.frequencies.where(F.col("gram").isin(grams)).collect()}     # <= len(term) rows
        return min(((g, known.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))

    def candidates(self, term: str) -> DataFrame | None:
        """Ids of texts that may hold the term; None: all may."""
        best = self.rarest(term)
        if best is None:
            return None
        return self.postings.where(F.col("gram") == F.lit(best[0])).select("id")


def build(df: DataFrame, text_col: str, id_col: str) -> TrigramIndex:
    """Write the index of ``text_col`` (rows of one id count as one text each)."""
    spark = df.sparkSession
    grams = df.select(F.explode(grams_of(F.col(text_col))).alias("gram"), F.col(id_col).alias("id")).distinct()
    path = scratch_path(spark, "trigrams")
    grams.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(path)
    postings = spark.read.schema(grams.schema).parquet(path)
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    path = scratch_path(spark, "trigram-counts")
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(path)
    return TrigramIndex(postings, spark.read.schema(counts.schema).parquet(path))


def search(df: DataFrame, index: TrigramIndex, term: str, text_col: str, id_col: str) -> DataFrame:
    """Rows of ``df`` whose text contains ``term`` (case as it is)."""
    found = index.candidates(term)
    rows = df if found is None else df.join(found.withColumnRenamed("id", id_col), id_col, "left_semi").select(*df.columns)
    return rows.where(F.col(text_col).contains(term))
