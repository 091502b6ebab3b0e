"""Pages of a sorted table by a page directory (ORD_PAGE).

``build`` range-partitions the rows by the sort columns, writes each range as a folder
of its own, and counts the ranges: the directory (part, n, before) has one row a range
and says how many rows come before it.  A page looks up the ranges that its rows lie in
(one or two, unless it is longer than a range), reads only these folders, sorts them and
skips what comes before.  So page n costs the same for every n, where a top
(offset + length) grows with the offset.

The sort columns should end in a unique column; of rows that are equal in all of them
the order is not defined.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promolens.session import scratch_path

ROWS = 100_000                   # of a range, about


def _order(columns: Sequence[str], ascending: bool) -> list[Column]:
    return [F.col(columns[0]).asc_nulls_first() if ascending else F.col(columns[0]).desc_nulls_last(), *[F.col(c).asc_nulls_first() for c in columns[1:]]]


@dataclass(frozen=True)
class PageDirectory:
    rows: DataFrame              # the table with its range, ``_part``
    parts: DataFrame             # part, n, before
    columns: tuple[str, ...]
    ascending: bool

    def count(self) -> int:
        return self.parts.agg(F.sum("n")).first()[0] or 0

    def parts_of(self, offset: int, length: int) -> list[tuple[int, int]]:
        """(range, rows before it) of the ranges that the page touches."""
        hit = self.parts.where((F.col("before") < offset + length) & (F.col("before") + F.col("n") > offset))
        return [(r.part, r.before) for r in hit.orderBy("before").collect()]

    def page(self, offset: int, length: int) -> DataFrame:
        """Rows ``offset`` .. ``offset + length - 1`` of the sorted table."""
        parts = self.parts_of(offset, length)
        rows = self.rows.where(F.col("_part").isin([p for p, _ in parts]) if parts else F.lit(False)).drop("_part")
        return rows.orderBy(*_order(self.columns, self.ascending)).offset(max(0, offset - (parts[0][1] if parts else 0))).limit(length)


def build(df: DataFrame, columns: Sequence[str], ascending: bool = True, ranges: int | None = None) -> PageDirectory:
    """Write ``df`` in ranges of ``columns`` (the first one in the given direction)."""
    spark = df.sparkSession
    if ranges is None:
        ranges = max(1, -(-df.count() // ROWS))
    order = _order(columns, ascending)
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    path = scratch_path(spark, "pages")
    dealt.write.partitionBy("_part").parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path)
    counts = rows.groupBy(F.col("_part").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)          # one row a range
    parts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    path = scratch_path(spark, "page-directory")
    parts.write.parquet(path)
    return PageDirectory(rows, spark.read.schema(parts.schema).parquet(path), tuple(columns), ascending)
