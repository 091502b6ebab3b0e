"""Two-sided incremental build: days are rebuilt when a file of either year changes.

A day's facts depend on its own promotion files and on last year's sales files of the
same calendar day.  ``refresh`` lists both raw zones (``sources.file_index``), compares
path, size and time with the files that the published version was built from, and maps
every new, changed or removed file to the day it affects: a promotion file to its day, a
sales file to the same day a year later.  Exactly these days are rebuilt from all their
files and published together with the new file table (``sources.fact_store``), so facts
and bookkeeping never disagree: a run that is repeated after a failure finds the same
differences and writes the same rows, and a run without differences writes nothing.

``start_refresh`` runs it from a stream that watches both zones (file states only, no
content) with ``Trigger.AvailableNow``.  The stream decides when to look, the file
table what to do; so a file replaced under its old name is also found.

The affected days and the chosen paths pass through the driver: their number is bounded
by the calendar and the files of these days.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from promolens.functions.dates import in_window, prev_year
from promolens.functions.text import na_to_null
from promolens.operators.clean import clean_promo_rows, clean_sales_rows
from promolens.operators.yoy import REFERENCE_GRAIN, Grain, article_facts_from_rows
from promolens.schemas import RAW_SALES_SCHEMA, RAW_SALES_USED
from promolens.session import dropping_shuffles, scratch_path
from promolens.sources.fact_store import FactStore
from promolens.sources.file_index import file_index, paths_of, pick_days, read_files
from promolens.sources.files import PROMO_REQUIRED
from promolens.sources.headers import read_by_header

PROMO, SALES = "promo", "sales"

WATCHED = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def zone_files(spark: SparkSession, promo_raw: str, sales_raw: str, promo_token: int = 1, sales_token: int = 2) -> DataFrame:
    """zone, path, size, modified, day, month of the files of both zones."""
    zones = {PROMO: file_index(spark, promo_raw, promo_token), SALES: file_index(spark, sales_raw, sales_token)}
    promo, sales = (df.withColumn("zone", F.lit(z)) for z, df in zones.items())
    return promo.unionByName(sales)


def next_year(day: str):
    """Same calendar day a year later; null for 29 February, which is no day's baseline."""
    shifted = F.add_months(F.col(day), 12)
    return F.when(prev_year(shifted) == F.col(day), shifted)


def affected_days(files: DataFrame, known: DataFrame) -> list[dt.date]:
    """Days to rebuild: of the files that ``known`` lists otherwise or not, and of
    files that are gone."""
    version = ["zone", "path", "size", "modified"]
    changed = files.join(known, version, "left_anti").select("zone", "day").unionByName(
        known.join(files, version, "left_anti").select("zone", "day"))
    day = F.when(F.col("zone") == PROMO, F.col("day")).otherwise(next_year("day"))
    return [r.d for r in changed.select(day.alias("d")).where("d IS NOT NULL").distinct().orderBy("d").collect()]


def day_facts(spark: SparkSession, files: DataFrame, days: list[dt.date], grain: Grain) -> DataFrame:
    """Article facts of ``days`` from all their files."""
    before = [r.d for r in spark.createDataFrame([(d,) for d in days], "day date").select(prev_year("day").alias("d")).where("d IS NOT NULL").collect()]
    promo = paths_of(pick_days(files.where(F.col("zone") == PROMO), days))
    sales = paths_of(pick_days(files.where(F.col("zone") == SALES), before)) if before else []
    ty = read_by_header(spark, promo, PROMO_REQUIRED, PROMO_REQUIRED)
    ly = read_files(spark, sales, RAW_SALES_SCHEMA)
    ty = clean_promo_rows(ty.select(*[na_to_null(c).alias(c) for c in ty.columns])).where(F.col("bdate").isin(days))
    ly = clean_sales_rows(ly.select(*[na_to_null(c).alias(c) for c in RAW_SALES_USED]))
    return article_facts_from_rows(ly, ty, grain)


def refresh(spark: SparkSession, promo_raw: str, sales_raw: str, store: FactStore, grain: Grain = REFERENCE_GRAIN,
            promo_token: int = 1, sales_token: int = 2, start=None, end=None) -> list[dt.date]:
    """Rebuild and publish the affected days; returns them.  With a window only its
    days are kept, and only their files are watched and opened."""
    if grain.period != "day":
        raise ValueError("the incremental build recomputes whole days; use a day grain")
    files = zone_files(spark, promo_raw, sales_raw, promo_token, sales_token)
    snapshot = scratch_path(spark, "zone-files")
    if start is not None:
        files = files.where(in_window(F.when(F.col("zone") == PROMO, F.col("day")).otherwise(next_year("day")), start, end))
    files.write.parquet(snapshot)                      # one listing for the comparison, the reads and the file table
    files = spark.read.schema(files.schema).parquet(snapshot)
    days = affected_days(files, store.files())
    if days:
        with dropping_shuffles(spark):
            store.publish(day_facts(spark, files, days, grain), days, files)
    return days


def start_refresh(spark: SparkSession, promo_raw: str, sales_raw: str, store: FactStore, checkpoint: str | None = None,
                  grain: Grain = REFERENCE_GRAIN, promo_token: int = 1, sales_token: int = 2, start=None, end=None) -> StreamingQuery:
    """Watch both zones once (AvailableNow); call ``awaitTermination()`` on the result."""
    def watched(base: str) -> DataFrame:
        files = spark.readStream.schema(WATCHED).format("binaryFile").option("recursiveFileLookup", True).load(base)
        return files.select("path", "modificationTime", "length")

    return (watched(promo_raw).union(watched(sales_raw)).writeStream
            .foreachBatch(lambda _batch, _epoch: refresh(spark, promo_raw, sales_raw, store, grain, promo_token, sales_token, start, end))
            .option("checkpointLocation", checkpoint or scratch_path(spark, "refresh-ckpt"))
            .trigger(availableNow=True).start())
