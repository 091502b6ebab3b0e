"""PromoScope: the set of article facts a dashboard request looks at.

Date window (partition pruning on the fact table) ∩ uploaded article list ∩
stores of the chain ∩ optional store ∩ category hierarchy (category, else the
division letters of a directorate, else one division letter).

The article list and the store master are semi-joined.  Their size is only
known at run time (an upload, a master that grows with the chain), so no
broadcast is forced; AQE broadcasts them when their measured size is under the
threshold, which also gives dynamic partition pruning on the fact table.
The directorate master is a fixed list of division letters (bounded by the
alphabet) and is broadcast explicitly.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolens.functions.dates import as_date, in_window, pre_window
from promolens.functions.text import first_letter

ALL = "all"


def _is_all(v: str | None) -> bool:
    # an empty or missing form value means "all" (the source compared None
    # and returned nothing; SURVEY §2.12 #12)
    return v is None or v == "" or v == ALL


@dataclass(frozen=True)
class PromoScope:
    start: dt.date | str
    end: dt.date | str
    store: str | None = None
    category: str | None = None
    directorate: str | None = None
    division: str | None = None
    pre_start: dt.date | str | None = None
    pre_end: dt.date | str | None = None
    pre_days: int = 14
    chain_type: str = "CHAIN"

    def before(self) -> PromoScope:
        """The same scope over the pre-promotion window (default: the 14 days
        before the start, both ends inclusive)."""
        if self.pre_start is not None and self.pre_end is not None:
            s, e = as_date(self.pre_start), as_date(self.pre_end)
        else:
            s, e = pre_window(self.start, self.pre_days)
        return replace(self, start=s, end=e, pre_start=None, pre_end=None)

    def without_store(self) -> PromoScope:
        return replace(self, store=None)


def hierarchy_filter(scope: PromoScope, directorates: DataFrame, cat_col: str = "mercat_y",
                     facts: DataFrame | None = None) -> tuple[Column | None, DataFrame | None]:
    """FLT_HIERARCHY: (predicate, semi-join side) for the category cascade.

    * a category -> exact category;
    * else a directorate with division "all" -> the division letters of that
      directorate (semi join on the first letter, JOIN_SEMI_DIVISION);
    * else a directorate and a division -> that division letter (FLT_PREFIX);
    * directorate "all" -> no filter, even when a division is set (as in the
      source).
    """
    if not _is_all(scope.category):
        return F.col(cat_col) == F.lit(scope.category), None
    if _is_all(scope.directorate):
        return None, None
    if _is_all(scope.division):
        letters = (directorates.where(F.col("dirdesc") == F.lit(scope.directorate))
                   .select(F.col("directorate_code").alias("_div")))
        return None, F.broadcast(letters)
    return first_letter(cat_col) == F.lit(scope.division), None


def apply_scope(facts: DataFrame, scope: PromoScope, articles: DataFrame | None,
                stores: DataFrame | None, directorates: DataFrame,
                date_col: str = "bdate_y") -> DataFrame:
    """Q_PROMO_SCOPE: the facts a request looks at."""
    df = facts.where(in_window(date_col, scope.start, scope.end))      # SRC_DATE_PRUNE
    if not _is_all(scope.store):
        df = df.where(F.col("kode_store") == F.lit(scope.store))        # FLT_OPTIONAL
    pred, letters = hierarchy_filter(scope, directorates)
    if pred is not None:
        df = df.where(pred)
    if letters is not None:
        df = (df.withColumn("_div", first_letter("mercat_y"))
              .join(letters, "_div", "left_semi").drop("_div"))
    if articles is not None:                                            # JOIN_SEMI_ARTICLE
        df = df.join(articles.select(F.col("plu").alias("sku")), "sku", "left_semi")
    if stores is not None:                                              # JOIN_SEMI_STORE
        chain = (stores.where(F.col("type_store") == F.lit(scope.chain_type))
                 .select(F.col("store_code").alias("kode_store")))
        df = df.join(chain, "kode_store", "left_semi")
    return df
