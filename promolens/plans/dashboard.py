"""Layer B: promotion dashboard results over a PromoScope.

Each result is one aggregate over the scoped facts.  The group-bys end in a
handful of rows (days, rule types, categories, stores), so the final sorts,
top-5 limits and share windows work on small inputs; the heavy part is the
scan + semi joins + partial aggregation, which Spark runs map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promolens.functions.dates import chart_day
from promolens.functions.numeric import (
    growth_pct, growth_ratio, margin_pct, millions, round2, safe_ratio, sign_flag, traffic_light, unit_avg,
)
from promolens.operators.aggregate import sum_all, sum_by
from promolens.operators.scope import PromoScope, apply_scope
from promolens.operators.daily import BEFORE, DURING, daily_series, in_either_window, series_windows
from promolens.operators.yoy import DAILY_CATEGORY_GRAIN, MONTHLY_ARTICLE_GRAIN, Grain
from promolens.plans.common import present, read_facts
from promolens.schemas import FACT_MEASURES
from promolens.sources.fixtures import article_list, directorates, stores

KPI_MEASURES = ["tnetsales", "tqty", "tprofit", "netsales_x", "qty_x", "profit_x"]
DAILY_MEASURES = ["tqty", "tcogs", "tnetsales", "tprofit"]
DETAIL_KEYS = ["nama_site", "sku", "merdiv_y", "merdivdesc_y", "mercat_y", "mercatdesc_y",
               "brand_y", "sku_desc_y", "principle_y", "tag"]


# --- results over an already scoped frame ------------------------------------

def _kpi_columns(g: DataFrame, keys: list[str]) -> DataFrame:
    sales_growth = growth_pct("tnetsales", "netsales_x")
    qty_growth = growth_pct("tqty", "qty_x")
    profit_growth = growth_pct("tprofit", "profit_x")
    margin = margin_pct("tprofit", "tnetsales")
    out = g.select(
        *keys,
        millions("tnetsales").alias("total_netsales_m"),
        F.round(F.col("tqty"), 0).cast("double").alias("total_qty"),
        sales_growth.alias("sales_growth"),
        qty_growth.alias("qty_growth"),
        profit_growth.alias("profit_growth"),
        margin.alias("margin_promo"),
    )
    # PRJ_TRAFFIC_LIGHT on the two-decimal numbers shown to the user
    return out.withColumns({
        "sales_growth_class": traffic_light("sales_growth"),
        "qty_growth_class": traffic_light("qty_growth"),
        "profit_growth_class": traffic_light("profit_growth"),
        "margin_promo_class": traffic_light("margin_promo"),
    })


def kpi(scoped: DataFrame) -> DataFrame:
    """Q_KPI over all stores: one row (AGG_GLOBAL); an empty scope gives zeros."""
    g = sum_all(scoped, KPI_MEASURES)
    g = g.select(*[F.coalesce(F.col(m), F.lit(0).cast(g.schema[m].dataType)).alias(m)
                   for m in KPI_MEASURES])
    return _kpi_columns(g, [])


def kpi_by_store(scoped: DataFrame) -> DataFrame:
    """Q_KPI per store (AGG_BY_STORE)."""
    return _kpi_columns(sum_by(scoped, ["kode_store"], KPI_MEASURES), ["kode_store"])


def kpi_of_store(scoped: DataFrame, store: str) -> DataFrame:
    """Q_KPI of one store: always one row, zeros for a store without facts."""
    return kpi(scoped.where(F.col("kode_store") == F.lit(store))).select(F.lit(store).alias("kode_store"), "*")


def growth_bars(scoped: DataFrame) -> DataFrame:
    """Growth per rule type with the bar colour (PRJ_SIGN_FLAG: zero and below
    are red, judged on the exact growth)."""
    g = sum_by(scoped, ["rulecode", "ruletype"], ["tnetsales", "netsales_x"])
    return g.select("rulecode", "ruletype", growth_pct("tnetsales", "netsales_x").alias("growth"),
                    sign_flag(growth_ratio("tnetsales", "netsales_x")).alias("color"))


def daily(scoped: DataFrame, margin_scale: float = 100.0) -> DataFrame:
    """Per period of the facts (AGG_DAILY on month facts) quantity,
    unit cost, unit price (PRJ_UNIT_AVG, always guarded) and margin.
    The dashboard shows margin x100, the article search as a ratio."""
    g = sum_by(scoped, ["bdate_y"], DAILY_MEASURES)
    return (g.select(
        "bdate_y",
        chart_day("bdate_y").alias("day_label"),
        round2("tqty").alias("tqty"),
        unit_avg("tcogs", "tqty").alias("avg_tcogs"),
        unit_avg("tnetsales", "tqty").alias("avg_tnetsales"),
        round2(safe_ratio("tprofit", "tnetsales", margin_scale)).alias("total_margin"),
    ).orderBy("bdate_y"))


def growth_top(scoped: DataFrame, keys: list[str], n: int = 5, ascending: bool = True) -> DataFrame:
    """Q_TYPE_GROWTH / Q_CATEGORY_GROWTH_TOP: sales growth per group, first n.

    The source sorts ascending and takes five, so its "top" charts show the
    lowest growth; ``ascending=True`` keeps that.  The order is by the exact
    growth (rounded only for display); ties are broken by the keys.
    """
    g = sum_by(scoped, keys, ["tnetsales", "netsales_x"])
    exact = growth_ratio("tnetsales", "netsales_x")
    g = g.orderBy(exact.asc() if ascending else exact.desc(), *[F.col(k).asc() for k in keys]).limit(n)
    return g.select(*keys, round2("tnetsales").alias("tnetsales"), round2("netsales_x").alias("netsales_x"),
                    growth_pct("tnetsales", "netsales_x").alias("growth"))


def share(scoped: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Q_TYPE_SHARE / Q_CATEGORY_SHARE: each group's share of promotion sales
    (WIN_SHARE_*, unrounded), first n groups in key order, 0 when the total is 0.

    The window has no partition key, but it runs on the grouped result (one
    row per rule type or category), never on the facts."""
    g = sum_by(scoped, keys, ["tnetsales"])
    total = F.sum("tnetsales").over(Window.partitionBy())
    g = g.select(*keys, round2("tnetsales").alias("tnetsales"),
                 safe_ratio(F.col("tnetsales"), total, 100.0).alias("share"))
    return g.orderBy(*keys).limit(n)


def store_rank(scoped_all_stores: DataFrame, n: int = 5, best: bool = True) -> DataFrame:
    """Q_STORE_BEST / Q_STORE_WORST: five stores of highest / lowest growth
    (ORD_BEST5 / ORD_WORST5), tie broken by store code."""
    g = sum_by(scoped_all_stores, ["kode_store", "nama_site"], ["tnetsales", "netsales_x"])
    exact = growth_ratio("tnetsales", "netsales_x")
    g = g.orderBy(exact.desc() if best else exact.asc(), F.col("kode_store").asc()).limit(n)
    return g.select("kode_store", "nama_site", round2("tnetsales").alias("tnetsales"),
                    round2("netsales_x").alias("netsales_x"),
                    growth_pct("tnetsales", "netsales_x").alias("growth"))


def article_detail(scoped: DataFrame, dirs: DataFrame) -> DataFrame:
    """Q_ARTICLE_DETAIL: per site x article x hierarchy x tag totals with
    growth, margins and margin change, and the directorate name.  The inner
    join with the directorates drops divisions without one (JOIN_DIM_DIFFNAME).
    """
    g = sum_by(scoped, DETAIL_KEYS, FACT_MEASURES)
    ty_margin = safe_ratio("tprofit", "tnetsales", 100.0)
    ly_margin = safe_ratio("profit_x", "netsales_x", 100.0)
    g = g.select(
        *DETAIL_KEYS, *[round2(m).alias(m) for m in FACT_MEASURES],
        growth_pct("tnetsales", "netsales_x").alias("growth_netsales"),
        growth_pct("tqty", "qty_x").alias("growth_qty"),
        growth_pct("tprofit", "profit_x").alias("growth_profit"),
        round2(ty_margin).alias("ty_margin"),
        round2(ly_margin).alias("ly_margin"),
        round2(ty_margin - ly_margin).alias("margin_change"),
    )
    # directorates: a fixed list of division letters -> safe to broadcast
    return g.join(F.broadcast(dirs), g.merdiv_y == dirs.directorate_code, "inner")


ROLLUP_KEYS = ["bdate_y", "kode_store", "nama_site", "rulecode", "ruletype", "mercat_y", "mercatdesc_y"]
ROLLUP_SETS = [[], ["kode_store", "nama_site"], ["bdate_y"], ["rulecode", "ruletype"], ["mercat_y", "mercatdesc_y"]]
ROLLUP_MEASURES = ["tnetsales", "tqty", "tprofit", "tcogs", "netsales_x", "qty_x", "profit_x"]


def dashboard_rollup(scoped: DataFrame) -> DataFrame:
    """Every dashboard total in ONE aggregation pass (GROUPING SETS):
    overall, per store, per day, per rule type and per category, with growth
    and margin.  One scan and one shuffle of the scope instead of one per
    result; the Expand before the partial aggregation is collapsed map-side."""
    g = scoped.groupingSets(ROLLUP_SETS, *ROLLUP_KEYS).agg(
        *[F.sum(m).alias(m) for m in ROLLUP_MEASURES],
        F.grouping("kode_store").alias("_gs"), F.grouping("bdate_y").alias("_gd"),
        F.grouping("rulecode").alias("_gt"), F.grouping("mercat_y").alias("_gc"))
    level = (F.when(F.col("_gs") == 0, F.lit("store")).when(F.col("_gd") == 0, F.lit("day"))
             .when(F.col("_gt") == 0, F.lit("type")).when(F.col("_gc") == 0, F.lit("category"))
             .otherwise(F.lit("total")))
    return g.select(
        level.alias("level"), *ROLLUP_KEYS, *[round2(m).alias(m) for m in ROLLUP_MEASURES],
        growth_pct("tnetsales", "netsales_x").alias("sales_growth"),
        growth_pct("tqty", "qty_x").alias("qty_growth"),
        growth_pct("tprofit", "profit_x").alias("profit_growth"),
        margin_pct("tprofit", "tnetsales").alias("margin"),
        unit_avg("tnetsales", "tqty").alias("avg_price"))


# --- test-bed wiring: facts and masters derived from the warehouse tables ------

# Fixed parameters of the registered dashboard queries.  The day grain of the
# source is too sparse on the test bed (a handful of pairs), so the dashboard
# runs on chain-wide monthly article facts; windows are given in months.
FIXTURE_GRAIN: Grain = MONTHLY_ARTICLE_GRAIN
FIXTURE_SCOPE = PromoScope(start="1998-01-01", end="1998-06-30",
                           pre_start="1997-07-01", pre_end="1997-12-31")
FIXTURE_STORE = "1"
FIXTURE_ARTICLE = "1080"


def scoped(spark: SparkSession, sf_dir: str, scope: PromoScope = FIXTURE_SCOPE,
           grain: Grain = FIXTURE_GRAIN) -> DataFrame:
    facts = read_facts(spark, sf_dir, grain, scope.start, scope.end)
    return apply_scope(facts, scope, article_list(spark, sf_dir), stores(spark, sf_dir),
                       directorates(spark))


def q_promo_scope(spark, sf_dir):
    return present(scoped(spark, sf_dir))


def q_promo_scope_category(spark, sf_dir):
    from dataclasses import replace
    return present(scoped(spark, sf_dir, replace(FIXTURE_SCOPE, category="PROMO")))


def q_promo_scope_directorate(spark, sf_dir):
    from dataclasses import replace
    return present(scoped(spark, sf_dir, replace(FIXTURE_SCOPE, directorate="FASHION", division="all")))


def q_promo_scope_division(spark, sf_dir):
    from dataclasses import replace
    return present(scoped(spark, sf_dir, replace(FIXTURE_SCOPE, directorate="HOME", division="S")))


def q_kpi(spark, sf_dir):
    return kpi(scoped(spark, sf_dir))


def q_kpi_store(spark, sf_dir):
    from dataclasses import replace
    return kpi_of_store(scoped(spark, sf_dir, replace(FIXTURE_SCOPE, store=FIXTURE_STORE)), FIXTURE_STORE)


def q_kpi_empty_store(spark, sf_dir):
    """The KPI of a store that has no facts: one row of zeros."""
    return kpi_of_store(scoped(spark, sf_dir), "no such store")


def q_growth_bars(spark, sf_dir):
    return growth_bars(scoped(spark, sf_dir))


def q_kpi_dedupe(spark, sf_dir):
    """The KPI with last year counted once per article and day."""
    from promolens.operators.yoy import dedupe_baseline
    return kpi(dedupe_baseline(scoped(spark, sf_dir), FIXTURE_GRAIN))


def q_kpi_by_store(spark, sf_dir):
    return kpi_by_store(scoped(spark, sf_dir))


# the daily series: a promotion of 14 days and the 14 days before it
DAY_GRAIN: Grain = DAILY_CATEGORY_GRAIN
DAY_SCOPE = PromoScope(start="1998-03-15", end="1998-03-28")


def day_scoped(spark: SparkSession, sf_dir: str, scope: PromoScope = DAY_SCOPE, grain: Grain = DAY_GRAIN,
               which=(DURING, BEFORE)) -> DataFrame:
    """Day facts of the windows in one scan, pruned to their day folders."""
    from dataclasses import replace
    windows = [series_windows(scope)[w] for w in which]
    whole = replace(scope, start=min(s for s, _ in windows), end=max(e for _, e in windows))
    facts = read_facts(spark, sf_dir, grain, whole.start, whole.end).where(in_either_window("bdate_y", scope, which))
    return apply_scope(facts, whole, article_list(spark, sf_dir), stores(spark, sf_dir), directorates(spark))


def q_daily_during(spark, sf_dir):
    """Q_DAILY_DURING: every day of the promotion window."""
    return daily_series(day_scoped(spark, sf_dir, which=[DURING]), DAY_SCOPE, which=[DURING])


def q_daily_before(spark, sf_dir):
    """Q_DAILY_BEFORE: every one of the 14 days before it."""
    return daily_series(day_scoped(spark, sf_dir, which=[BEFORE]), DAY_SCOPE, which=[BEFORE])


def q_daily_series(spark, sf_dir):
    """Both series from one scan."""
    return daily_series(day_scoped(spark, sf_dir), DAY_SCOPE)


def q_daily_store_category(spark, sf_dir):
    """Both series of each store and category."""
    return daily_series(day_scoped(spark, sf_dir), DAY_SCOPE, ["kode_store", "mercat_y"])


def q_daily_article(spark, sf_dir, article: str | None = None):
    """Q_DAILY_ARTICLE: both series of one article, or of each article that sold (the
    article search: store filter and article only, margin as a ratio)."""
    facts = day_scoped(spark, sf_dir)
    if article is not None:
        facts = facts.where(F.col("sku") == F.lit(article))
    return daily_series(facts, DAY_SCOPE, ["sku"], margin_scale=1.0)


def q_monthly_during(spark, sf_dir):
    return daily(scoped(spark, sf_dir))


def q_monthly_before(spark, sf_dir):
    return daily(scoped(spark, sf_dir, FIXTURE_SCOPE.before()))


def q_monthly_article(spark, sf_dir, article: str = FIXTURE_ARTICLE):
    """Both series of one article on month facts."""
    from dataclasses import replace
    base = replace(FIXTURE_SCOPE, category=None, directorate=None, division=None)
    during = scoped(spark, sf_dir, base).where(F.col("sku") == F.lit(article))
    before = scoped(spark, sf_dir, base.before()).where(F.col("sku") == F.lit(article))
    return (daily(during, 1.0).withColumn("series", F.lit("during"))
            .unionByName(daily(before, 1.0).withColumn("series", F.lit("before"))))


def q_dashboard_rollup(spark, sf_dir):
    return dashboard_rollup(scoped(spark, sf_dir))


def q_type_growth(spark, sf_dir):
    return growth_top(scoped(spark, sf_dir), ["rulecode", "ruletype"])


def q_category_growth_top(spark, sf_dir):
    return growth_top(scoped(spark, sf_dir), ["mercat_y", "mercatdesc_y"])


def q_type_share(spark, sf_dir):
    return share(scoped(spark, sf_dir), ["rulecode", "ruletype"])


def q_category_share(spark, sf_dir):
    return share(scoped(spark, sf_dir), ["mercat_y", "mercatdesc_y"])


def q_store_best(spark, sf_dir):
    return store_rank(scoped(spark, sf_dir, FIXTURE_SCOPE.without_store()), best=True)


def q_store_worst(spark, sf_dir):
    return store_rank(scoped(spark, sf_dir, FIXTURE_SCOPE.without_store()), best=False)


def q_article_detail(spark, sf_dir):
    return article_detail(scoped(spark, sf_dir), directorates(spark))


# --- hierarchy look-ups (Q_DIVISIONS / Q_CATEGORIES / Q_CHAIN_STORES) --------

def divisions_of(divs: DataFrame, dirs: DataFrame, directorate: str) -> DataFrame:
    letters = dirs.where(F.col("dirdesc") == F.lit(directorate)).select("directorate_code")
    return divs.join(F.broadcast(letters), divs.div == letters.directorate_code, "left_semi")


def categories_of(cats: DataFrame, division: str) -> DataFrame:
    return cats.where(F.substring("cat", 1, 1) == F.lit(division))


def q_divisions(spark, sf_dir):
    from promolens.sources.fixtures import divisions
    return divisions_of(divisions(spark, sf_dir), directorates(spark), "FASHION")


def q_categories(spark, sf_dir):
    from promolens.sources.fixtures import categories
    return categories_of(categories(spark, sf_dir), "S")


def q_chain_stores(spark, sf_dir):
    s = stores(spark, sf_dir)
    return s.where(F.col("type_store") == "CHAIN").orderBy("initial", "store_code")


def q_directorates(spark, sf_dir):
    """AGG_DISTINCT: distinct names of the directorates that have articles, sorted."""
    from promolens.sources.fixtures import divisions
    d = directorates(spark)
    present_divs = divisions(spark, sf_dir).select(F.col("div").alias("directorate_code"))
    return (d.join(present_divs, "directorate_code", "left_semi")
            .select("dirdesc").distinct().orderBy("dirdesc"))
