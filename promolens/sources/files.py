"""File sources and sinks of the raw and clean zones (SRC_* / SNK_*).

Layouts
  raw zone    text files, ``|``-separated.  Sales files carry no header and 32
              positional columns; promotion files carry a header.
              Spark layout: ``<base>/yymm=<yyMM>/part-*`` (``write_raw_feed``);
              month pruning is partition pruning, the day a pushed filter.
              Day files (``<yyMM>/<name>_<yyyyMMdd>*.txt``, or ``yymm=/day=``
              folders): a window picks files from their index (``file_index``).
              Promotion files are read by their own headers (``headers``).
  clean zone  article facts in month folders with one sub-folder per
              business day (``yymm=<yyMM>/bdate_y=<date>``), as in the
              source's clean zone; Parquet, or pipe files with a header.  Writes use dynamic partition overwrite,
              so re-running a day replaces exactly that day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.functions.dates import FILE_DATE, MONTH_FOLDER, as_date, in_window
from promolens.functions.text import na_to_null
from promolens.operators.clean import _once
from promolens.schemas import (
    ARTICLE_FACT_SCHEMA, RAW_PROMO_USED, RAW_SALES_COLUMNS, RAW_SALES_SCHEMA, RAW_SALES_USED,
)
from promolens.sources.file_index import file_index, paths_of, pick, read_files
from promolens.sources.headers import read_by_header

# the promotion file's columns without which it cannot be read (``member`` is optional)
PROMO_REQUIRED = [c for c in RAW_PROMO_USED if c != "member"]


# --- date pruning helpers (SRC_DATE_PRUNE) ------------------------------------

def months_between(start: dt.date | str, end: dt.date | str) -> list[str]:
    """``yyMM`` folder names of every month touched by [start, end]."""
    s, e = as_date(start), as_date(end)
    out, y, m = [], s.year, s.month
    while (y, m) <= (e.year, e.month):
        out.append(f"{y % 100:02d}{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return out


def file_days(start: dt.date | str, end: dt.date | str) -> list[str]:
    s, e = as_date(start), as_date(end)
    return [(s + dt.timedelta(days=i)).strftime("%Y%m%d") for i in range((e - s).days + 1)]


# --- raw zone -------------------------------------------------------------------

def zone_folders(days: bool = False) -> dict[str, Column]:
    """Folder columns of the raw zone, from the business date text."""
    day = F.try_to_date(F.col("bdate"), "dd-MM-yyyy")
    month = {"yymm": F.coalesce(F.date_format(day, MONTH_FOLDER), F.lit("0000"))}
    return {**month, "day": F.coalesce(F.date_format(day, FILE_DATE), F.lit("none"))} if days else month


def by_folder(df: DataFrame, days: bool = False) -> DataFrame:
    """Rows laid out by the folder of the raw zone that they go to; AQE coalesces small
    folders and splits large ones.  The folder moves as one number."""
    day = F.try_to_date(F.col("bdate"), "dd-MM-yyyy")
    number = F.unix_date(day) if days else F.year(day) * 12 + F.month(day)
    return df.withColumn("_folder", number).hint("rebalance", "_folder").drop("_folder")


def write_raw_feed(feed: DataFrame, base: str, kind: str, days: bool = False, columns: list[str] | None = None,
                   mode: str = "overwrite", laid_out: bool = False, compression: str = "none") -> None:
    """Write a text feed into the raw zone, one folder per month (``yymm``), and with
    ``days`` one folder per business day (``day``) in it.

    ``kind='sales'`` writes the 32 positional columns without a header (unused
    positions empty); ``kind='promo'`` writes the promotion columns with one.
    Rows whose date does not parse land in ``yymm=0000``.  ``columns`` gives the
    promotion columns in another order, or fewer.  Rows are laid out by folder here,
    unless they come ``laid_out`` (``by_folder``).
    """
    folders = list(zone_folders(days))
    df = (feed if laid_out else by_folder(feed, days)).withColumns(zone_folders(days))
    if kind == "sales":
        cols = [F.col(c.lower()).alias(c) if c in RAW_SALES_USED and c.lower() in feed.columns
                else F.lit(None).cast("string").alias(c) for c in RAW_SALES_COLUMNS]
        header = False
    else:
        cols = [F.col(c) if c in feed.columns else F.lit("1").alias(c) for c in columns or RAW_PROMO_USED]
        header = True
    (df.select(*cols, *folders).sortWithinPartitions(*folders)
     .write.mode(mode).option("sep", "|").option("header", header).option("compression", compression)
     .partitionBy(*folders).csv(base))


def _day_filter(df: DataFrame, start, end, date_col: str) -> DataFrame:
    """Month folders of the range (partition pruning) and rows whose business
    date text is one of its days (a pushed-down string IN filter)."""
    if start is None:
        return df
    s, e = as_date(start), as_date(end)
    days = [(s + dt.timedelta(days=i)).strftime("%d-%m-%Y") for i in range((e - s).days + 1)]
    return df.where(F.col("yymm").isin(months_between(start, end)) & F.col(date_col).isin(days))


def read_sales_csv(spark: SparkSession, base: str, start=None, end=None) -> DataFrame:
    """SRC_SALES_CSV: headerless pipe file, 32 positional text columns, the 16
    used ones kept (codes stay text so leading zeros survive)."""
    schema = T.StructType(RAW_SALES_SCHEMA.fields + [T.StructField("yymm", T.StringType())])
    df = (spark.read.schema(schema)
          .option("sep", "|").option("header", False).option("mode", "PERMISSIVE")
          .csv(base))
    df = _day_filter(df, start, end, "BDATE")
    return df.select(*[na_to_null(c).alias(c) for c in RAW_SALES_USED])


def read_promo_csv(spark: SparkSession, base: str, start=None, end=None) -> DataFrame:
    """SRC_PROMO_CSV: pipe files with a header, the used columns picked by the
    header of each file; everything read as text (no schema inference).  With a
    window only files of its month folders are opened."""
    files = file_index(spark, base, token=1)
    if start is not None:
        files = files.where(F.col("month").isin(months_between(start, end)))
    df = read_by_header(spark, paths_of(files), PROMO_REQUIRED, PROMO_REQUIRED)
    if start is not None:
        s, e = as_date(start), as_date(end)
        df = df.where(F.col("bdate").isin([(s + dt.timedelta(days=i)).strftime("%d-%m-%Y") for i in range((e - s).days + 1)]))
    return df.select(*[na_to_null(c).alias(c) for c in PROMO_REQUIRED])


def read_sales_days(spark: SparkSession, base: str, start, end, token: int = 2) -> DataFrame:
    """SRC_SALES_CSV on day files: only the files of the window's days are opened."""
    df = read_files(spark, paths_of(pick(file_index(spark, base, token), start, end)), RAW_SALES_SCHEMA)
    return df.select(*[na_to_null(c).alias(c) for c in RAW_SALES_USED])


def read_promo_days(spark: SparkSession, base: str, start, end, token: int = 1) -> DataFrame:
    """SRC_PROMO_CSV on day files, each read by its own header."""
    df = read_by_header(spark, paths_of(pick(file_index(spark, base, token), start, end)), PROMO_REQUIRED, PROMO_REQUIRED)
    return df.select(*[na_to_null(c).alias(c) for c in PROMO_REQUIRED])


# --- lines that are no records (SRC_SALES_CSV) ----------------------------------------

def split_sales_lines(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine) of a zone of headerless sales files.

    A line with another number of fields than the 32 positions, or one the reader
    cannot take apart, is no record: it goes to the quarantine as ``file``, ``line``,
    ``reason``.  Together both have every line that is not empty."""
    schema = T.StructType([*RAW_SALES_SCHEMA.fields, T.StructField("_line", T.StringType())])
    lines = (spark.read.option("recursiveFileLookup", True).text(base).where(F.trim("value") != "")
             .select("value", F.col("_metadata.file_path").alias("file")))
    parsed = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "),
                        {"sep": "|", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})
    df = lines.select("file", F.inline_outer(F.array(parsed)))               # parsed once, judged behind the generator
    n = F.size(F.split("_line", r"\|"))
    reason = F.when(n < len(RAW_SALES_COLUMNS), "too few fields").when(n > len(RAW_SALES_COLUMNS), "too many fields").otherwise("unreadable")
    good = df.where(F.col("_line").isNull()).select(*[na_to_null(c).alias(c) for c in RAW_SALES_USED])
    bad = df.where(F.col("_line").isNotNull()).select("file", F.col("_line").alias("line"), reason.alias("reason"))
    return good, bad


def quarantine_report(records: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Lines by outcome: ``record`` and each reason."""
    return records.select(F.lit("record").alias("outcome")).unionAll(quarantine.select("reason")).groupBy("outcome").agg(
        F.count(F.lit(1)).alias("lines"))


def read_legacy_day_files(spark: SparkSession, base: str, start, end, token: int,
                          header: bool, schema: T.StructType | None = None) -> DataFrame:
    """SRC_DATE_PRUNE on the legacy layout: files in the month folders of the
    range whose ``_``-token ``token`` starts with a day of the range.  Only these
    are opened; short names and absent months are passed over."""
    paths = paths_of(pick(file_index(spark, base, token), start, end))
    if schema is not None or not paths:
        return read_files(spark, paths, schema or T.StructType(), header=header)
    return spark.read.option("sep", "|").option("header", header).csv(paths)


# --- clean zone -------------------------------------------------------------------

_FORMATS = {"parquet": ("parquet", {}), "pipe": ("csv", {"sep": "|", "header": "true", "mode": "FAILFAST"})}


def write_facts(facts: DataFrame, path: str, fmt: str = "parquet") -> None:
    """SNK_ARTICLE / SNK_CATEGORY: Parquet (or ``fmt="pipe"``: ``|``-separated text
    with a header, as in the source) in month folders holding one
    folder per business day (``yymm=…/bdate_y=…``), the source's clean-zone
    layout.  Dynamic partition overwrite: re-running a day replaces exactly
    that day.

    The ``rebalance`` hint lets AQE shuffle the rows by day folder, coalesce
    small partitions and split a hot day over several tasks, so each day is
    written as a few right-sized files rather than one file per task and day,
    and a day holding a third of the rows does not land in one task.  The rows are
    sorted before they move as well: like rows side by side make the shuffle smaller.
    The month comes out of a generator, past which Catalyst does not drop that sort."""
    like = [c for c in ("mercat_y", "sku") if c in facts.columns]
    out = _once(facts.sortWithinPartitions("bdate_y", *like), {"yymm": F.date_format("bdate_y", MONTH_FOLDER)})
    (out.hint("rebalance", "yymm", "bdate_y").sortWithinPartitions("yymm", "bdate_y")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**_FORMATS[fmt][1])
     .partitionBy("yymm", "bdate_y").format(_FORMATS[fmt][0]).save(path))


def read_clean(spark: SparkSession, path: str, start=None, end=None,
               schema: T.StructType = ARTICLE_FACT_SCHEMA, fmt: str = "parquet") -> DataFrame:
    """SRC_CLEAN: typed re-read of the facts, pruned to the month and day
    folders of the window (partition pruning on both levels).  Pipe files are read
    with the declared types, in the order in which ``write_facts`` writes them."""
    fields = schema.fields
    if fmt == "pipe":                                # folders are not columns of the files
        fields = [f for f in fields if f.name != "bdate_y"] + [f for f in fields if f.name == "bdate_y"]
    full = T.StructType([*fields, T.StructField("yymm", T.StringType())])
    df = spark.read.schema(full).options(**_FORMATS[fmt][1]).format(_FORMATS[fmt][0]).load(path)
    if start is not None:
        df = df.where(F.col("yymm").isin(months_between(start, end))
                      & in_window("bdate_y", start, end))
    return df.select(*[f.name for f in schema.fields])


# --- masters, article list, JSON ---------------------------------------------------

def read_master(spark: SparkSession, path: str, sep: str = ",",
                schema: T.StructType | str | None = None) -> DataFrame:
    """SRC_MASTER: a small delimited master file with a header, read as text."""
    r = spark.read.option("sep", sep).option("header", True)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", False)).csv(path)


def read_article_list(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC_ARTICLE_LIST: the uploaded list of article codes as ``plu STRING``
    (the source read a spreadsheet; Spark reads CSV or Parquet)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        df = spark.read.option("header", True).schema("plu string").csv(path)
    return df.select(F.col("plu").cast("string").alias("plu"))


def to_json_records(df: DataFrame) -> DataFrame:
    """SNK_JSON: one JSON object per row (``value`` column), built on the
    executors; write it with ``.write.text`` or hand it to a service."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
