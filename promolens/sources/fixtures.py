"""Promotion feed and master tables derived from the warehouse tables.

The source application reads confidential daily text files; the test bed
derives the same logical feed from ``lineitem ⋈ orders ⋈ part ⋈ supplier``.
Every feed column is *text*, with the dirt the cleaning chain has to remove
(sentinel dates, short and inactive site names, numeric category codes,
non-numeric quantities, missing tags).  The derivation is fixed by FIXTURES.md.

Scale notes: the four-way join is the only wide step.  ``lineitem ⋈ orders``
shuffles both sides on the order key (always: a broadcast would leave all that
follows to the tasks of the ``lineitem`` scan, however few its splits); ``part`` and ``supplier`` grow with the
data too, so no broadcast is forced -- AQE turns a join into a broadcast only
when the measured size of a side is under ``autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promolens.functions.dates import FEED_DATE
from promolens.operators.clean import _once, base_filter
from promolens.sources.tables import read_table

# Directorate of each division letter (no entry for L, so an
# inner join with the directorates drops those rows).
DIRECTORATES = [("P", "FASHION"), ("E", "FASHION"), ("M", "HOME"), ("S", "HOME")]

# Store chain type used by the dashboard's store filter.
CHAIN = "CHAIN"


def _text(c: Column) -> Column:
    return c.cast("string")


def _site_name() -> Column:
    sk = F.col("l_suppkey")
    return (F.when(sk % 41 == 0, F.lit("NA"))
            .when(sk % 43 == 0, F.lit(None).cast("string"))
            .when(sk % 47 == 0, F.concat(F.lit("NON AKTIF "), F.col("s_name")))
            .otherwise(F.col("s_name")))


def _site_code() -> Column:
    sk = F.col("l_suppkey")
    return F.when(sk % 53 == 0, F.lit(None).cast("string")).otherwise(_text(sk))


def _category() -> Column:
    return F.when(F.col("p_partkey") % 71 == 0, F.lit("123")).otherwise(F.col("p_type"))


def feed_of_both_years(spark: SparkSession, sf_dir: str, by_article: bool = False) -> DataFrame:
    """The feed's rows that pass ``base_filter``, for a plan that reads them as both years.

    The joined rows come out of an outer generator over one struct, so neither reader's
    columns and predicates go below it: the joins are the same plan on both sides and
    Spark moves their rows once (ReusedExchange).  The filter, which both sides have, is
    below it.  With ``by_article`` the rows come laid out by ``sku``, which stays outside
    the struct for that."""
    def rows(j: DataFrame) -> DataFrame:
        texts = {"nama_site": _site_name(), "kode_store": _site_code(), "mercat": _category()}
        kept = j.withColumns(texts).where(base_filter()).select(*j.columns)
        outside = ["sku"] if by_article else []
        return kept.select(*outside, F.inline_outer(F.array(F.struct(*[c for c in kept.columns if c not in outside]))))

    return raw_feed(spark, sf_dir, spread=rows, by_article=by_article)


def category_days(spark: SparkSession, sf_dir: str) -> int:
    """A bound of the feed's different (category, day) pairs, from two narrow scans."""
    types = read_table(spark, sf_dir, "part", ["p_type"]).agg(F.countDistinct("p_type")).first()[0]
    day = F.to_date("l_shipdate")
    days = read_table(spark, sf_dir, "lineitem", ["l_shipdate"]).agg(F.date_diff(F.max(day), F.min(day))).first()[0]
    return (types + 1) * (days + 1) if days is not None else 0


def raw_feed(spark: SparkSession, sf_dir: str, spread: Callable[[DataFrame], DataFrame] | None = None,
             by_article: bool = False) -> DataFrame:
    """The dirty daily feed, all columns text (sales and promotion columns).

    ``spread`` may lay out the joined rows (``bdate`` among their columns) before
    their measures become text, which is several times longer.  With ``by_article``
    the articles are joined last, by a shuffle on ``sku``: the rows that move there are
    narrow, and what groups them by article finds them in place."""
    lines = feed_lines(spark, sf_dir, by_article)
    return feed_of_lines(spread(lines) if spread is not None else lines)


def feed_lines(spark: SparkSession, sf_dir: str, by_article: bool = False) -> DataFrame:
    """The joined rows of the feed before they become text (``feed_of_lines``)."""
    l = read_table(spark, sf_dir, "lineitem",
                   ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate"])
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority"])
    p = read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_retailprice"])
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])

    # a text that several predicates use: made once a line, before the joins
    l = _once(l, {"bdate": F.when(F.col("l_orderkey") % 97 == 0, F.lit("TRICLE"))
                  .when(F.col("l_orderkey") % 89 == 0, F.lit("SUPREME"))
                  .when(F.col("l_orderkey") % 83 == 0, F.lit(None).cast("string"))
                  .otherwise(F.date_format(F.col("l_shipdate"), FEED_DATE))})

    # both sides are facts: a shuffled join, which also spreads a table of few splits
    j = l.join(o.hint("merge"), l.l_orderkey == o.o_orderkey)
    if by_article:
        j = j.join(s, l.l_suppkey == s.s_suppkey).withColumn("sku", _text(F.col("l_partkey"))).drop("l_partkey")
        p = p.withColumn("p_sku", _text(F.col("p_partkey")))
        j = j.join(p.hint("merge"), j.sku == p.p_sku).drop("p_sku")
    else:
        j = j.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey)
    return j.drop("l_shipdate", "o_orderkey", "s_suppkey")


def feed_of_lines(lines: DataFrame) -> DataFrame:
    """The feed's text columns of joined rows."""
    sku = F.col("sku") if "sku" in lines.columns else _text(F.col("l_partkey"))
    ok = F.col("l_orderkey")
    netsales = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    cogs = F.col("l_quantity") * F.col("p_retailprice")
    mercat = _category()
    return lines.select(
        "bdate",
        _site_name().alias("nama_site"),
        _site_code().alias("kode_store"),
        F.substring(mercat, 1, 1).alias("merdiv"),
        F.concat(F.lit("DIV "), F.substring(mercat, 1, 1)).alias("merdivdesc"),
        mercat.alias("mercat"),
        mercat.alias("mercatdesc"),
        sku.alias("sku"),
        F.col("p_name").alias("sku_desc"),
        F.col("p_brand").alias("brand"),
        F.col("p_brand").alias("principle"),
        F.when((F.col("l_linenumber") == 7) & (ok % 5 == 0), F.lit("n/a"))
        .otherwise(_text(F.col("l_quantity"))).alias("qty"),
        _text(cogs).alias("cogs"),
        _text(netsales).alias("netsales"),
        _text(netsales - cogs).alias("profit"),
        _text(F.col("l_quantity") - F.col("l_linenumber")).alias("tqty"),
        _text(F.col("l_extendedprice") * F.col("l_discount")).alias("tamt"),
        F.when(ok % 61 == 0, F.lit(None).cast("string")).otherwise(F.col("l_returnflag")).alias("tag"),
        F.substring(F.col("o_orderpriority"), 1, 1).alias("rulecode"),
        F.expr("substring(o_orderpriority, 3)").alias("ruletype"),
    )


# --- masters (SRC_MASTER) ---------------------------------------------------

def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stores(store_code, initial, type_store): one store per supplier."""
    s = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"])
    return s.select(
        _text(F.col("s_suppkey")).alias("store_code"),
        F.right(F.col("s_name"), F.lit(3)).alias("initial"),
        F.when(F.col("s_suppkey") % 3 > 0, F.lit(CHAIN)).otherwise(F.lit("OTHER")).alias("type_store"),
    )


def directorates(spark: SparkSession) -> DataFrame:
    """directorates(directorate_code, dirdesc): a fixed list of division letters."""
    return spark.createDataFrame(DIRECTORATES, "directorate_code string, dirdesc string")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """categories(cat, catdesc): distinct category codes of the articles."""
    p = read_table(spark, sf_dir, "part", ["p_type"])
    return p.select(F.col("p_type").alias("cat"), F.col("p_type").alias("catdesc")).distinct()


def divisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """divisions(div, divdesc): the first letters of the category codes."""
    p = read_table(spark, sf_dir, "part", ["p_type"])
    d = F.substring(F.col("p_type"), 1, 1)
    return p.select(d.alias("div"), F.concat(F.lit("DIV "), d).alias("divdesc")).distinct()


def article_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uploaded list of promoted articles, ``plu`` as text (SRC_ARTICLE_LIST).

    The test bed's list is every fourth part key (FIXTURES.md).
    """
    p = read_table(spark, sf_dir, "part", ["p_partkey"])
    return p.where(F.col("p_partkey") % 4 == 0).select(_text(F.col("p_partkey")).alias("plu"))
