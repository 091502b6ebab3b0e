"""Column expressions for measures, ratios and classes.

All helpers are built from ``pyspark.sql.functions`` so they stay inside
whole-stage code generation; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from promolens.schemas import MEASURE_TYPE

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def measure(c: ColumnOrName) -> Column:
    """A double measure as DECIMAL(18,6): exact, order-independent sums."""
    return _c(c).cast(MEASURE_TYPE)


# the largest absolute value that a measure of DECIMAL(18,6) holds, as a double
MEASURE_LIMIT = 999_999_999_999.0


def fits_measure(c: ColumnOrName) -> Column:
    """Whether a number can be stored as a measure (NULL: no).  Rows with a
    measure that does not fit are rejected and counted (``clean.rejects``), so
    one absurd amount does not end the build."""
    return F.coalesce(F.abs(_c(c).cast("double")) <= F.lit(MEASURE_LIMIT), F.lit(False))


def round2(c: ColumnOrName) -> Column:
    """Round half-up to two decimals and return a double.

    Going through DECIMAL(38,6) first makes the half-up rule act on the
    decimal value (12.345 -> 12.35) rather than on the binary fraction.
    """
    return F.round(_c(c).cast("decimal(38,6)"), 2).cast("double")


def safe_ratio(num: ColumnOrName, den: ColumnOrName, scale: float = 1.0) -> Column:
    """``num / den * scale`` and 0 when ``den`` is 0 (ANSI mode raises on /0)."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d * F.lit(scale))


def growth_ratio(new: ColumnOrName, old: ColumnOrName) -> Column:
    """``(new - old) / old * 100`` unrounded; 0 when the base is 0 (ranking)."""
    n, o = _c(new), _c(old)
    return safe_ratio(n - o, o, 100.0)


def growth_pct(new: ColumnOrName, old: ColumnOrName) -> Column:
    """``(new - old) / old * 100``; 0 when the base is 0 (PRJ_GROWTH)."""
    return round2(growth_ratio(new, old))


def margin_pct(profit: ColumnOrName, sales: ColumnOrName) -> Column:
    """``profit / sales * 100``; 0 when sales are 0 (PRJ_MARGIN)."""
    return round2(safe_ratio(profit, sales, 100.0))


def unit_avg(total: ColumnOrName, qty: ColumnOrName) -> Column:
    """Average per unit, guarded against zero quantity (PRJ_UNIT_AVG)."""
    return round2(safe_ratio(total, qty, 1.0))


def traffic_light(c: ColumnOrName) -> Column:
    """KPI class: above 1 green, 0..1 yellow, below 0 red (PRJ_TRAFFIC_LIGHT)."""
    x = _c(c)
    return (F.when(x > 1, F.lit("bg-green"))
            .when(x >= 0, F.lit("bg-yellow"))
            .otherwise(F.lit("bg-red")))


def sign_flag(c: ColumnOrName, zero_is_red: bool = True) -> Column:
    """Two-way class by sign (PRJ_SIGN_FLAG).

    Bars colour zero red (``<= 0``); point movements colour only negatives red.
    """
    x = _c(c)
    red = (x <= 0) if zero_is_red else (x < 0)
    return F.when(red, F.lit("red")).otherwise(F.lit("green"))


def promo_share(amount: ColumnOrName, qty: ColumnOrName, promo_qty: ColumnOrName) -> Column:
    """Part of an amount sold under promotion: ``amount / qty * promo_qty``.

    Computed in double (qty > 0 is guaranteed by the cleaning filter), then
    stored as a decimal measure (PRJ_PROMO_SHARE).
    """
    a, q, t = _c(amount).cast("double"), _c(qty).cast("double"), _c(promo_qty).cast("double")
    return measure(a / q * t)


def millions(c: ColumnOrName) -> Column:
    """Value in millions (FN_MILLIONS)."""
    return round2(_c(c).cast("double") / F.lit(1_000_000.0))


def class_price(normal_price: ColumnOrName, percent_discount: ColumnOrName,
                size: ColumnOrName | None = None, extra_fee: ColumnOrName | None = None) -> Column:
    """Price after the customer-class discount; size XXL adds its extra fee
    (PRJ_CLASS_PRICE)."""
    p = _c(normal_price).cast("double")
    price = p - (_c(percent_discount).cast("double") / F.lit(100.0)) * p
    if size is not None and extra_fee is not None:
        price = F.when(_c(size) == "XXL", price + _c(extra_fee).cast("double")).otherwise(price)
    return round2(price)


def order_net(gross: ColumnOrName, shipping: ColumnOrName,
              shipping_discount: ColumnOrName, voucher_discount: ColumnOrName) -> Column:
    """gross + shipping - shipping discount - voucher discount (PRJ_ORDER_NET)."""
    return round2(_c(gross).cast("double") + _c(shipping).cast("double")
                  - _c(shipping_discount).cast("double") - _c(voucher_discount).cast("double"))


def pos_discount_value(discount: ColumnOrName, is_percent: ColumnOrName, total: ColumnOrName) -> Column:
    """Discount as a percentage of the total when flagged, else an amount
    (PRJ_POS_DISCOUNT), unrounded."""
    d = _c(discount).cast("double")
    return F.when(_c(is_percent) == 1, d / F.lit(100.0) * _c(total).cast("double")).otherwise(d)


def pos_discount(discount: ColumnOrName, is_percent: ColumnOrName, total: ColumnOrName) -> Column:
    """PRJ_POS_DISCOUNT rounded to two decimals for display."""
    return round2(pos_discount_value(discount, is_percent, total))
