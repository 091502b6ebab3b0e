"""Shared plan pieces: cached-per-call builders of the feed and facts, and
presentation of decimal measures."""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from promolens.functions.numeric import round2
from promolens.operators.clean import clean_promo_rows, clean_sales_rows
from promolens.operators.yoy import REFERENCE_GRAIN, Grain, article_facts_from_rows
from promolens.session import scratch_path, session_key
from promolens.sources.files import read_clean, write_facts
from promolens.sources.fixtures import category_days, feed_of_both_years
from promolens.sources.tables import table_path


def present(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Decimal measures -> doubles rounded half-up to two decimals."""
    names = set(cols) if cols is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)}
    return df.select(*[round2(c).alias(c) if c in names else F.col(c) for c in df.columns])


def facts_from_tables(spark: SparkSession, sf_dir: str, grain: Grain = REFERENCE_GRAIN) -> DataFrame:
    """Article facts computed from the warehouse tables (raw feed -> clean ->
    year-over-year).  A deployment reads the written fact table instead
    (``sources.files.read_clean``)."""
    # the chain's baselines by category are few where categories are; counted before the plan is made
    few = grain.keys == ("mercat",) and category_days(spark, sf_dir) <= FEW_BASELINES
    feed = feed_of_both_years(spark, sf_dir, by_article=few)
    return article_facts_from_rows(clean_sales_rows(feed), clean_promo_rows(feed), grain, few_baselines=few)


#: baselines (narrow rows) up to which they are broadcast
FEW_BASELINES = 500_000
_FACT_TABLES: dict[tuple, str] = {}
_LOCK = threading.Lock()
FEED_TABLES = ("lineitem", "orders", "part", "supplier")


def inputs_version(spark: SparkSession, sf_dir: str, tables: Iterable[str] = FEED_TABLES) -> tuple | None:
    """Name, length and modification time of every file of the input tables, from
    the store's listing; None where it cannot be asked (nothing is remembered then)."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return None
    found = []
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, t))
        files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
        found += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files]
    return tuple(sorted(found))


def facts_table(spark: SparkSession, sf_dir: str, grain: Grain = REFERENCE_GRAIN) -> str:
    """Path of the article fact table built from ``sf_dir`` (the nightly
    build's output), written into the shared checkpoint folder once for each
    version of the input files; a table that is rewritten or gains a file is
    built again.  Dashboard queries read it back with partition pruning; being a
    written table it also cuts the lineage, so a lost executor costs a re-read,
    not a re-run of the whole build."""
    version = inputs_version(spark, sf_dir)
    key = (session_key(spark), version, grain)
    with _LOCK:
        if version is None or key not in _FACT_TABLES:
            path = scratch_path(spark, "facts")
            write_facts(facts_from_tables(spark, sf_dir, grain), path)
            _FACT_TABLES[key] = path
        return _FACT_TABLES[key]


def read_facts(spark: SparkSession, sf_dir: str, grain: Grain = REFERENCE_GRAIN,
               start=None, end=None) -> DataFrame:
    return read_clean(spark, facts_table(spark, sf_dir, grain), start, end)
