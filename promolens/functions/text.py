"""Text predicates and conversions used by the cleaning chain and the reports."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Markers that occur in the business-date column of broken rows.
DATE_SENTINELS = ["TRICLE", "SUPREME"]

# The texts a pandas CSV reader turns into a missing value by
# default; raw feeds are read as text, so they are mapped to NULL at ingest.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c: ColumnOrName) -> Column:
    x = _c(c)
    return F.when(x.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(x)


def is_all_digits(c: ColumnOrName) -> Column:
    """True when the text is only numeric characters (FN_ISNUMERIC); NULL stays NULL."""
    return _c(c).rlike(r"^\p{N}+$")


_DBL_MAX = 1.7976931348623157e308


def number_or_infinite(c: ColumnOrName) -> Column:
    """The number that a text spells, ``NaN`` and infinities included; NULL for other
    text and for one with a trailing Java type letter (``1.0d``).  The text is parsed
    once; ``finite`` then judges the number."""
    x = F.trim(_c(c))
    return F.when(~F.substring(x, -1, 1).isin("d", "D", "f", "F"), x).try_cast("double")


def finite(v: ColumnOrName) -> Column:
    """The number itself, NULL for NaN and infinities.  Spark orders NaN above every
    number, so one range test drops all three."""
    return F.when(_c(v).between(F.lit(-_DBL_MAX), F.lit(_DBL_MAX)), _c(v))


def to_number(c: ColumnOrName) -> Column:
    """Tolerant number parse (FN_TO_NUMBER): NULL for text that is not a finite
    decimal number; no regular expression runs per row."""
    return finite(number_or_infinite(c))


def is_number_text(c: ColumnOrName) -> Column:
    """CLN_NUMERIC_MEASURE predicate."""
    return to_number(c).isNotNull()


def site_suffix(c: ColumnOrName) -> Column:
    """Site code = last three characters (CLN_SITE_SUFFIX / FN_SUBSTR)."""
    return F.right(_c(c), F.lit(3))


def first_letter(c: ColumnOrName) -> Column:
    """Division letter of a category code (FLT_PREFIX / FN_SUBSTR)."""
    return F.substring(_c(c), 1, 1)


def contains_any(columns: list[str], term: str) -> Column:
    """``a LIKE %term% OR b LIKE %term% ...`` (FLT_LIKE, multi-column form)."""
    return reduce(or_, [F.coalesce(F.col(c).cast("string").contains(term), F.lit(False))
                        for c in columns])


def percent_text(c: ColumnOrName) -> Column:
    """Append a percent sign (FN_PERCENT_TEXT)."""
    return F.concat(_c(c).cast("string"), F.lit("%"))


def money_text(c: ColumnOrName, decimals: int = 0) -> Column:
    """Thousands separators and fixed decimals (FN_FORMAT_NUMBER)."""
    return F.format_number(_c(c).cast("double"), decimals)


def space_join(*cols: ColumnOrName) -> Column:
    """``CONCAT(a, ' ', b)`` with SQL NULL propagation (FN_CONCAT)."""
    parts: list[Column] = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(" "))
        parts.append(_c(c))
    return F.concat(*parts)
