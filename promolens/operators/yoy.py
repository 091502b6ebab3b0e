"""Year-over-year facts: promotion days joined with the same day last year.

The source loads exactly one day of each year, so its join on
(store, site, article) silently carries the date.  Spark processes many days
at once, so the date is an explicit join key: ``ly.period = prev_year(ty.period)``.
Without it, days would cross-multiply.

Both sides are aggregated *before* the join (partial aggregation map-side,
then one shuffle each).  After that the last-year side is unique per join key
and the promotion side is unique per fact key, so

  * the join never fans out beyond the promotion rows (a hot article that holds
    a third of the raw rows is one row per day by then), and
  * the joined rows are already at fact grain: no regrouping shuffle.

AQE may still turn the join into a broadcast when one aggregated side proves
small at run time, and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promolens.functions.dates import period_start, prev_year
from promolens.operators.aggregate import not_null_keys, sum_by
from promolens.schemas import (
    ARTICLE_FACT_COLUMNS, CATEGORY_FACT_KEYS, DESCRIPTORS, FACT_MEASURES, FACT_TYPE, PROMO_KEYS,
    PROMO_MEASURES, SALES_KEYS, SALES_MEASURES,
)


@dataclass(frozen=True)
class Grain:
    """Join keys and time bucket of the year-over-year comparison.

    The default is the source application's grain: same store, site and
    article on the same calendar day one year earlier.
    """
    keys: tuple[str, ...] = ("kode_store", "nama_site", "sku")
    period: str = "day"


REFERENCE_GRAIN = Grain()
# Article baseline over the whole chain, by calendar month (used where the
# day grain is too sparse to compare, e.g. on the test bed).
MONTHLY_ARTICLE_GRAIN = Grain(keys=("sku",), period="month")
# Category baselines by day: of each store, and of the whole chain (a daily series in
# which every promotion row has a baseline).
DAILY_STORE_CATEGORY_GRAIN = Grain(keys=("kode_store", "nama_site", "mercat"), period="day")
DAILY_CATEGORY_GRAIN = Grain(keys=("mercat",), period="day")


def _fact_column(key: str) -> str:
    """Name of a join key in the facts: descriptors are this year's (``_y``)."""
    return f"{key}_y" if key in DESCRIPTORS else key


def _ly_side(sales_clean: DataFrame, grain: Grain) -> DataFrame:
    """Last-year measures per (join keys, period), suffixed ``_x``."""
    ly = sales_clean.withColumn("period", period_start("bdate", grain.period))
    ly = sum_by(ly, [*grain.keys, "period"], SALES_MEASURES)
    return ly.select(*[F.col(k).alias(f"ly_{k}") for k in grain.keys],
                     F.col("period").alias("ly_period"),
                     *[F.col(m).alias(f"{m}_x") for m in SALES_MEASURES])


def _ty_side(promo_clean: DataFrame, grain: Grain) -> DataFrame:
    """Promotion measures per fact key, with the period of last year."""
    ty = promo_clean
    if grain.period != "day":
        ty = sum_by(ty.withColumn("bdate", period_start("bdate", grain.period)),
                    PROMO_KEYS, PROMO_MEASURES)
    ren = {"bdate": "bdate_y", **{d: f"{d}_y" for d in DESCRIPTORS},
           **{m: f"{m}_y" for m in SALES_MEASURES}}
    ty = ty.select(*[F.col(c).alias(ren.get(c, c)) for c in ty.columns])
    return ty.withColumn("ly_bdate", prev_year("bdate_y"))


def join_yoy(sales_clean: DataFrame, promo_clean: DataFrame,
             grain: Grain = REFERENCE_GRAIN) -> DataFrame:
    """JOIN_YOY: inner join of this year's promotion rows with last year's
    sales of the same keys one year earlier.  Articles sold in only one of
    the years drop out; 29 February has no baseline."""
    ly = _ly_side(sales_clean, grain)
    ty = _ty_side(promo_clean, grain)
    cond = [ty[_fact_column(k)] == ly[f"ly_{k}"] for k in grain.keys] + [ty["ly_bdate"] == ly["ly_period"]]
    return ty.join(ly, cond, "inner")


def article_facts(sales_clean: DataFrame, promo_clean: DataFrame,
                  grain: Grain = REFERENCE_GRAIN) -> DataFrame:
    """Q_ARTICLE_GROWTH: one row per promotion day x store x article x rule x
    tag with this and last year's measures (AGG_YOY_ARTICLE).

    Last-year measures repeat for every rule/tag row of an article, as in the
    source (its dashboard totals count last year once per rule).
    """
    joined = join_yoy(sales_clean, promo_clean, grain)
    return joined.select(*[F.col(c).cast(FACT_TYPE).alias(c) if c in FACT_MEASURES else F.col(c)
                           for c in ARTICLE_FACT_COLUMNS])


def category_facts(facts: DataFrame) -> DataFrame:
    """Q_CATEGORY_GROWTH: facts per day x store x category x rule
    (AGG_YOY_CATEGORY) -- a re-aggregation of the article facts."""
    return sum_by(facts, CATEGORY_FACT_KEYS, FACT_MEASURES)


def dedupe_baseline(facts: DataFrame, grain: Grain = REFERENCE_GRAIN) -> DataFrame:
    """Optional fix of the repeated baseline: last year's
    measures stay on one fact row per join key and period (the row with the
    smallest store/site/rule/tag) and are zero on the others, so totals count
    last year once.

    Skew-safe: the chosen row per key comes from a ``min`` aggregate (partial
    aggregation map-side) joined back on the key, not from a window that would
    put a hot article's whole group into one task."""
    keys = [*map(_fact_column, grain.keys), "bdate_y"]
    rank = F.struct("kode_store", "nama_site", "rulecode", "ruletype", "tag", "sku_desc_y", "merdiv_y",
                    "merdivdesc_y", "mercat_y", "mercatdesc_y", "brand_y", "principle_y", "sku")
    first = facts.groupBy(*keys).agg(F.min(rank).alias("_first"))
    j = facts.withColumn("_me", rank).join(first, keys)
    keep = F.col("_me") == F.col("_first")
    zero = F.lit(0).cast(FACT_TYPE)
    return j.select(*[F.when(keep, F.col(c)).otherwise(zero).alias(c) if c.endswith("_x") else F.col(c)
                      for c in ARTICLE_FACT_COLUMNS])


def article_facts_from_rows(sales_rows: DataFrame, promo_rows: DataFrame,
                            grain: Grain = REFERENCE_GRAIN, few_baselines: bool = False) -> DataFrame:
    """Q_ARTICLE_GROWTH computed from cleaned *rows* in one aggregation per
    side (same result as ``article_facts(clean_sales(..), clean_promo(..))``).

    Sums are associative, so the source's two-step grouping (article grain,
    then the join grain) is done as one grouping straight to the join grain;
    the source's rule that a NULL in *any* of its grouping keys drops the row
    is applied first.

    The promotion rows are the wide ones, and grouping them by 14 keys hardly makes
    them fewer.  So they move once, as rows of plain measures, to the task of their
    baseline (join keys and period, which the fact keys contain); they are grouped
    and joined there.  The sales side is collapsed map-side before it moves.

    Where the caller has counted that the baselines are few (``few_baselines``), these
    are broadcast, and the promotion rows are grouped and joined by article: rows that
    already lie by ``sku`` do not move at all.
    """
    ly = sales_rows.where(not_null_keys(SALES_KEYS)).withColumn("period", period_start("bdate", grain.period))
    ly = sum_by(ly, [*grain.keys, "period"], SALES_MEASURES, drop_null_keys=False)
    ly = ly.select(*[F.col(k).alias(f"ly_{k}") for k in grain.keys], F.col("period").alias("ly_period"),
                   *[F.col(m).alias(f"{m}_x") for m in SALES_MEASURES])
    ty = (promo_rows.where(not_null_keys(PROMO_KEYS))
          .withColumn("bdate", period_start("bdate", grain.period))
          .withColumn("ly_bdate", prev_year("bdate")))
    ty = ty.repartition(*(["sku"] if few_baselines else [*grain.keys, "ly_bdate"]))
    ty = sum_by(ty, [*PROMO_KEYS, "ly_bdate"], PROMO_MEASURES, drop_null_keys=False)
    ren = {"bdate": "bdate_y", **{d: f"{d}_y" for d in DESCRIPTORS},
           **{m: f"{m}_y" for m in SALES_MEASURES}}
    ty = ty.select(*[F.col(c).alias(ren.get(c, c)) for c in ty.columns])
    cond = [ty[_fact_column(k)] == ly[f"ly_{k}"] for k in grain.keys] + [ty["ly_bdate"] == ly["ly_period"]]
    joined = ty.join(F.broadcast(ly) if few_baselines else ly, cond, "inner")
    return joined.select(*[F.col(c).cast(FACT_TYPE).alias(c) if c in FACT_MEASURES else F.col(c)
                           for c in ARTICLE_FACT_COLUMNS])


def fact_measures() -> Sequence[str]:
    return list(FACT_MEASURES)
