"""Versioned article and category facts behind one pointer (SNK_ARTICLE / SNK_CATEGORY).

    <base>/article/version=<v>/bdate_y=<day>/...    rows of the days that version wrote
    <base>/category/version=<v>/bdate_y=<day>/...
    <base>/days/version=<v>/...        (bdate_y, live): the version that holds each day
    <base>/files/version=<v>/...       file versions that the build had seen
    <base>/pointer/...                 one row for each published version

``publish`` stages a version: the article facts of the given days are written from one
join, the category facts are aggregated from the rows just written, and the day table
is the last version's without the given days, plus the days that have rows.  A single
row added to the pointer (one file, moved into place when its job commits) then makes
everything of the version visible at once.  A run that fails before that leaves the
old version as it was; its rows lie in folders that nothing points to.  A day that
was rebuilt without rows is in no day table any more, so it disappears.

Readers take the newest pointer row once and read the folders that its day table
names.  One writer at a time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.functions.dates import as_date, in_window
from promolens.operators.yoy import category_facts
from promolens.schemas import ARTICLE_FACT_SCHEMA, CATEGORY_FACT_SCHEMA
from promolens.sources.file_index import _missing

POINTER = "number long, version string"
DAYS = "bdate_y date, live string"
FILES = "zone string, path string, size long, modified timestamp, day date"


@dataclass(frozen=True)
class Version:
    number: int
    name: str


class FactStore:
    """Facts below ``base`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # --- reading ---------------------------------------------------------------

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if not _missing(e):
                raise
            return self.spark.createDataFrame([], schema)

    def current(self) -> Version | None:
        """The newest published version."""
        row = self._read(f"{self.base}/pointer", POINTER).orderBy(F.desc("number")).first()
        return Version(row.number, row.version) if row else None

    def days(self, version: Version | None = None) -> DataFrame:
        """bdate_y, live of a version (default: the newest); at most one row a day."""
        version = version or self.current()
        if version is None:
            return self.spark.createDataFrame([], DAYS)
        return self._read(f"{self.base}/days/version={version.name}", DAYS)

    def files(self, version: Version | None = None) -> DataFrame:
        """The file versions that a version was built from."""
        version = version or self.current()
        if version is None:
            return self.spark.createDataFrame([], FILES)
        return self._read(f"{self.base}/files/version={version.name}", FILES)

    def read(self, kind: str = "article", start=None, end=None, version: Version | None = None) -> DataFrame:
        """Facts of a version and window.  Only the folders of its days are listed."""
        schema = ARTICLE_FACT_SCHEMA if kind == "article" else CATEGORY_FACT_SCHEMA
        days = self.days(version)
        if start is not None:
            days = days.where(in_window("bdate_y", start, end))
        paths = [f"{self.base}/{kind}/version={r.live}/bdate_y={r.bdate_y}" for r in days.orderBy("bdate_y").collect()]   # one a day
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(T.StructType([*schema.fields, T.StructField("version", T.StringType())]))
        return df.option("basePath", f"{self.base}/{kind}").parquet(*paths).select(*[f.name for f in schema.fields])

    # --- writing ---------------------------------------------------------------

    def _write(self, df: DataFrame, kind: str, name: str) -> None:
        out = df.hint("rebalance", "bdate_y").sortWithinPartitions("bdate_y")
        out.write.partitionBy("bdate_y").parquet(f"{self.base}/{kind}/version={name}")

    def publish(self, facts: DataFrame, days: Iterable[dt.date | str] | None = None, files: DataFrame | None = None) -> Version:
        """Replace ``days`` (None: all days) by the rows of the article ``facts``, which
        hold no other days.  ``files`` are remembered as the version's inputs."""
        last, name = self.current(), uuid.uuid4().hex
        self._write(facts.select(*[f.name for f in ARTICLE_FACT_SCHEMA.fields]), "article", name)
        schema = T.StructType(ARTICLE_FACT_SCHEMA.fields)
        staged = self._read(f"{self.base}/article/version={name}", schema)
        self._write(category_facts(staged), "category", name)
        live = staged.select("bdate_y").distinct().withColumn("live", F.lit(name))
        if days is not None and last is not None:
            gone = [as_date(d) for d in days]
            kept = self.days(last)
            live = live.unionByName(kept.where(~F.col("bdate_y").isin(gone)) if gone else kept)
        live.coalesce(1).write.parquet(f"{self.base}/days/version={name}")            # one row a day
        if files is not None:
            files.select(*[f.split()[0] for f in FILES.split(", ")]).write.parquet(f"{self.base}/files/version={name}")
        version = Version(last.number + 1 if last else 1, name)
        self._point(version)
        return version

    def _point(self, version: Version) -> None:
        row = self.spark.createDataFrame([(version.number, version.name)], POINTER)
        row.coalesce(1).write.mode("append").parquet(f"{self.base}/pointer")
