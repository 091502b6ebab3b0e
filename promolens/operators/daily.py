"""Daily series of a promotion: the window and the days before it (AGG_DAILY).

Both series come from one scan of the day facts, pruned to the two windows, and one
aggregation by day.  A date spine (every day of both windows, marked with its
series) is joined with the sums, so a day without sales is a row of zeros that says
so, and a day that lies in both windows counts in both.

The spine has one row for each day and series: its size is the length of the
windows.  With keys (article, store, ...) every combination that sold in either
window gets its own spine by exploding that list of days, not by a cross join.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions.dates import as_date, chart_day, in_window
from promolens.functions.numeric import round2, safe_ratio, unit_avg
from promolens.operators.aggregate import sum_by
from promolens.operators.scope import PromoScope

DURING, BEFORE = "during", "before"
DAILY_MEASURES = ["tqty", "tcogs", "tnetsales", "tprofit"]


def series_windows(scope: PromoScope) -> dict[str, tuple[dt.date, dt.date]]:
    """First and last day of each series, both inclusive."""
    pre = scope.before()
    return {DURING: (as_date(scope.start), as_date(scope.end)), BEFORE: (as_date(pre.start), as_date(pre.end))}


def in_either_window(date_col: str, scope: PromoScope, which: Sequence[str] = (DURING, BEFORE)) -> Column:
    """The days of the windows; a predicate on the day only, so it prunes the scan."""
    cond = F.lit(False)
    for start, end in (series_windows(scope)[w] for w in which):
        cond = cond | in_window(date_col, start, end)
    return cond


def spine_days(scope: PromoScope, which: Sequence[str] = (DURING, BEFORE)) -> Column:
    """Every (series, day) of the windows, as an array of structs."""
    def marked(name: str, start: dt.date, end: dt.date) -> Column:
        return F.transform(F.sequence(F.lit(start), F.lit(end)), lambda d: F.struct(F.lit(name).alias("series"), d.alias("bdate_y")))

    days = [marked(name, start, end) for name, (start, end) in series_windows(scope).items() if name in which and start <= end]
    return F.concat(*days) if days else F.array().cast("array<struct<series:string,bdate_y:date>>")


def date_spine(keys: DataFrame, scope: PromoScope, which: Sequence[str] = (DURING, BEFORE)) -> DataFrame:
    """Each row of ``keys`` with every (series, bdate_y)."""
    return keys.select("*", F.inline(spine_days(scope, which)))


def daily_series(facts: DataFrame, scope: PromoScope, keys: Sequence[str] = (), margin_scale: float = 100.0,
                 which: Sequence[str] = (DURING, BEFORE)) -> DataFrame:
    """keys, series, bdate_y, day_label, tqty, avg_tcogs, avg_tnetsales, total_margin,
    has_sales: one row for each key, series and day.

    ``facts`` are day facts of (at least) both windows.  Without keys there is one
    spine, also where nothing was sold at all.  Averages and margin are 0 where the
    quantity or the sales are (PRJ_UNIT_AVG)."""
    sums = sum_by(facts.where(in_either_window("bdate_y", scope, which)), [*keys, "bdate_y"], DAILY_MEASURES)
    if keys:
        entities = sums.select(*keys).distinct()
        joined = date_spine(entities, scope, which).join(sums, [*keys, "bdate_y"], "left")
    else:
        one = facts.sparkSession.range(1).select(F.lit(1).alias("_one"))
        joined = date_spine(one, scope, which).drop("_one").join(sums, ["bdate_y"], "left")
    has_sales = F.col("tqty").isNotNull()
    zero = {m: F.coalesce(F.col(m), F.lit(0).cast(sums.schema[m].dataType)) for m in DAILY_MEASURES}
    return joined.withColumn("has_sales", has_sales).withColumns(zero).select(
        *keys, "series", "bdate_y", chart_day("bdate_y").alias("day_label"),
        round2("tqty").alias("tqty"),
        unit_avg("tcogs", "tqty").alias("avg_tcogs"),
        unit_avg("tnetsales", "tqty").alias("avg_tnetsales"),
        round2(safe_ratio("tprofit", "tnetsales", margin_scale)).alias("total_margin"),
        "has_sales")
