"""Cleaning chain of the daily feeds (CLN_*).

The source drops bad rows one predicate after the other; here the whole chain
is one conjunction inside a single ``filter`` (one codegen stage, pushed as far
down as Catalyst can take it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions.dates import parse_feed_date
from promolens.functions.numeric import fits_measure, measure
from promolens.functions.text import DATE_SENTINELS, finite, is_all_digits, number_or_infinite, site_suffix, to_number
from promolens.operators.aggregate import sum_by
from promolens.schemas import PROMO_KEYS, PROMO_MEASURES, PROMO_POSITIVE, SALES_KEYS, SALES_MEASURES


def lower_columns(df: DataFrame) -> DataFrame:
    """CLN_LOWER_COLS."""
    return df.toDF(*[c.lower() for c in df.columns])


def not_sentinel(c: str = "bdate") -> Column:
    """CLN_SENTINEL: not a junk date marker (NULL is handled by CLN_NOT_NULL)."""
    return ~F.coalesce(F.col(c).isin(DATE_SENTINELS), F.lit(False))


def not_null(*cols: str) -> Column:
    """CLN_NOT_NULL."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def min_length(c: str = "nama_site", n: int = 3) -> Column:
    """CLN_MIN_LEN."""
    return F.length(F.col(c)) >= n


def not_numeric_code(c: str = "mercat") -> Column:
    """CLN_NUMERIC_CODE: drop all-digit codes (shifted columns); NULL is kept."""
    return ~F.coalesce(is_all_digits(c), F.lit(False))


def numeric(*cols: str) -> Column:
    """CLN_NUMERIC_MEASURE."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & to_number(c).isNotNull()
    return cond


def positive(*cols: str) -> Column:
    """CLN_POSITIVE (promotion feed only)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & (to_number(c) > 0)
    return cond


def active_site(c: str = "nama_site") -> Column:
    """CLN_INACTIVE: the source computes this filter and discards the result,
    so it is off by default (``drop_inactive=False``)."""
    return ~F.coalesce(F.col(c).contains("NON AKTIF"), F.lit(False))


def base_filter(drop_inactive: bool = False) -> Column:
    cond = (not_sentinel("bdate") & not_null("bdate", "nama_site", "kode_store")
            & min_length("nama_site", 3) & not_numeric_code("mercat"))
    if drop_inactive:
        cond = cond & active_site("nama_site")
    return cond


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns``, each evaluated once a row.  They come out of an outer
    generator over one struct; Catalyst does not push a predicate on them below it,
    where their definitions would be copied into every predicate that uses them."""
    return df.select("*", F.inline_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _parsed(df: DataFrame, measures: list[str], date: bool = True) -> DataFrame:
    """Parse each measure text once, into ``_<name>``, and with ``date`` the business
    date into ``_bdate``.  Numbers are judged behind the generator, which evaluates a
    text's parsing again for every place that names it."""
    parsed = _once(df, {**({"_bdate": parse_feed_date("bdate")} if date else {}), **{f"_{m}": number_or_infinite(m) for m in measures}})
    return parsed.withColumns({f"_{m}": finite(f"_{m}") for m in measures})


def clean_sales_rows(feed: DataFrame, drop_inactive: bool = False) -> DataFrame:
    """Cleaned last-year rows, before grouping."""
    df = _parsed(lower_columns(feed).where(base_filter(drop_inactive)), SALES_MEASURES)
    cond = F.lit(True)
    for m in SALES_MEASURES:                                        # CLN_NUMERIC_MEASURE
        cond = cond & fits_measure(f"_{m}")
    return (df.where(cond)
            .withColumns({
                "nama_site": site_suffix("nama_site"),          # CLN_SITE_SUFFIX
                "bdate": F.col("_bdate"),                       # FN_PARSE_DATE
                **{m: measure(f"_{m}") for m in SALES_MEASURES},   # CLN_CAST
            })
            .drop("_bdate", *[f"_{m}" for m in SALES_MEASURES]))


def clean_promo_rows(feed: DataFrame, drop_inactive: bool = False) -> DataFrame:
    """Cleaned promotion rows with the promotion part of each amount."""
    df = _parsed(lower_columns(feed).where(base_filter(drop_inactive)), PROMO_POSITIVE)
    cond = F.lit(True)
    for m in PROMO_POSITIVE:                                        # CLN_NUMERIC_MEASURE + CLN_POSITIVE
        cond = cond & (F.col(f"_{m}") > 0) & fits_measure(f"_{m}")
    # PRJ_PROMO_SHARE: (amount / qty) * tqty, before the casts
    shares = {"_tnetsales": "_netsales", "_tcogs": "_cogs", "_tprofit": "_profit"}
    df = _once(df.where(cond), {t: F.try_divide(F.col(a), F.col("_qty")) * F.col("_tqty") for t, a in shares.items()})
    fits = F.lit(True)
    for t in shares:                                                # a tiny quantity can blow up a share
        fits = fits & fits_measure(t)
    return (df.where(fits)
            .withColumns({
                "nama_site": site_suffix("nama_site"),
                "bdate": F.col("_bdate"),
                **{t[1:]: measure(t) for t in shares},
                **{m: measure(f"_{m}") for m in PROMO_POSITIVE},
            })
            .drop("_bdate", *shares, *[f"_{m}" for m in PROMO_POSITIVE]))


def rejects(feed: DataFrame) -> DataFrame:
    """For each measure, the feed rows that the cleaning chain rejects because of
    it: text that is no number, numbers too large for a measure, and (for the
    promotion side) numbers that are not positive.  One pass over the feed."""
    df = _parsed(lower_columns(feed), PROMO_POSITIVE, date=False)
    counts = []
    for m in PROMO_POSITIVE:
        v = F.col(f"_{m}")
        counts += [F.count_if(F.col(m).isNotNull() & v.isNull()).alias(f"{m}_0"),
                   F.count_if(v.isNotNull() & ~fits_measure(v)).alias(f"{m}_1"), F.count_if(v <= 0).alias(f"{m}_2")]
    rows = ", ".join(f"'{m}', {m}_0, {m}_1, {m}_2" for m in PROMO_POSITIVE)
    return df.agg(*counts).selectExpr(
        f"stack({len(PROMO_POSITIVE)}, {rows}) AS (measure, not_a_number, too_large, not_positive)")


def clean_sales(feed: DataFrame, drop_inactive: bool = False) -> DataFrame:
    """Q_CLEAN_SALES: last-year measures per site/store/day/hierarchy/article
    (AGG_LY_ARTICLE, 11 keys; rows with a NULL key are dropped)."""
    return sum_by(clean_sales_rows(feed, drop_inactive), SALES_KEYS, SALES_MEASURES)


def clean_promo(feed: DataFrame, drop_inactive: bool = False) -> DataFrame:
    """Q_CLEAN_PROMO: promotion measures per article x rule x tag
    (AGG_TY_PROMO, 14 keys; a NULL tag drops the row)."""
    return sum_by(clean_promo_rows(feed, drop_inactive), PROMO_KEYS, PROMO_MEASURES)
