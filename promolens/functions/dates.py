"""Date parsing, formatting and shifting."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Date layouts of the feeds and reports.
FEED_DATE = "dd-MM-yyyy"      # business date inside the feeds
FILE_DATE = "yyyyMMdd"        # date token of a daily file name
MONTH_FOLDER = "yyMM"         # month folder of the raw and clean zones
CHART_DAY = "dd/MM"           # day label of the daily charts
REPORT_TS = "dd-MM-yyyy HH:mm:ss"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_feed_date(c: ColumnOrName) -> Column:
    """``dd-mm-YYYY`` text to DATE; NULL when it does not parse (FN_PARSE_DATE)."""
    return F.try_to_date(_c(c), FEED_DATE)


def prev_year(c: ColumnOrName) -> Column:
    """Same calendar day one year earlier; NULL for 29 February, which has no
    counterpart (FN_DATE_SHIFT).  ``add_months`` alone would map it to 28 Feb."""
    d = _c(c)
    return F.when((F.month(d) == 2) & (F.dayofmonth(d) == 29), F.lit(None).cast("date")) \
        .otherwise(F.add_months(d, -12))


def period_start(c: ColumnOrName, period: str) -> Column:
    """Bucket a date to the start of its period ('day' or 'month')."""
    d = _c(c)
    if period == "day":
        return d
    if period == "month":
        return F.trunc(d, "month")
    raise ValueError(f"unknown period {period!r}")


def pre_window(start: str | _dt.date, days: int = 14) -> tuple[_dt.date, _dt.date]:
    """The ``days`` days before a promotion start, both ends inclusive."""
    s = _as_date(start)
    return s - _dt.timedelta(days=days), s - _dt.timedelta(days=1)


def _as_date(x: str | _dt.date) -> _dt.date:
    if isinstance(x, _dt.date):
        return x
    x = str(x)
    if len(x) == 10 and x[2] == "-":          # dd-mm-YYYY as typed in the form
        return _dt.datetime.strptime(x, "%d-%m-%Y").date()
    return _dt.date.fromisoformat(x)


def as_date(x: str | _dt.date) -> _dt.date:
    return _as_date(x)


def day_range(start: str | _dt.date, end: str | _dt.date) -> Column:
    """Every day between two dates, as an array column (FN_DATE_RANGE)."""
    return F.sequence(F.lit(_as_date(start)), F.lit(_as_date(end)), F.expr("interval 1 day"))


def in_window(c: ColumnOrName, start: str | _dt.date, end: str | _dt.date) -> Column:
    """Inclusive day window, written as a range so it reaches the Parquet scan
    and partition pruning."""
    d = _c(c)
    return (d >= F.lit(_as_date(start))) & (d <= F.lit(_as_date(end)))


def ts_day_range(c: ColumnOrName, start: str | _dt.date, end: str | _dt.date) -> Column:
    """Timestamp between 00:00:00 of ``start`` and the end of ``end`` (FLT_RANGE).

    Written half-open (``< end + 1 day``) so the last second is included
    whole; the source application stopped at 23:59:59.
    """
    ts = _c(c)
    lo = _dt.datetime.combine(_as_date(start), _dt.time())
    hi = _dt.datetime.combine(_as_date(end) + _dt.timedelta(days=1), _dt.time())
    return (ts >= _ntz(lo)) & (ts < _ntz(hi))


def _ntz(x: _dt.datetime) -> Column:
    # the order tables carry TIMESTAMP_NTZ; compare wall clock to wall clock
    return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")


def chart_day(c: ColumnOrName) -> Column:
    return F.date_format(_c(c), CHART_DAY)


def month_folder(c: ColumnOrName) -> Column:
    return F.date_format(_c(c), MONTH_FOLDER)


def file_day(c: ColumnOrName) -> Column:
    return F.date_format(_c(c), FILE_DATE)
