
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from promolens.plans import commerce, dashboard, nightly, operators

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "q_clean_sales": nightly.q_clean_sales,
        "q_clean_promo": nightly.q_clean_promo,
        "q_article_growth": nightly.q_article_growth,
        "q_category_growth": nightly.q_category_growth,
        "q_article_growth_monthly": nightly.q_article_growth_monthly,
        "q_category_growth_monthly": nightly.q_category_growth_monthly,
        "q_article_growth_daily": nightly.q_article_growth_daily,
        "q_category_growth_daily": nightly.q_category_growth_daily,
    }
    for name in ["q_promo_scope", "q_promo_scope_category", "q_promo_scope_directorate",
                 "q_promo_scope_division", "q_kpi", "q_kpi_store", "q_kpi_empty_store", "q_kpi_dedupe", "q_growth_bars", "q_kpi_by_store",
                 "q_daily_during", "q_daily_before", "q_daily_article", "q_daily_series", "q_daily_store_category",
                 "q_monthly_during", "q_monthly_before", "q_monthly_article", "q_type_growth",
                 "q_category_growth_top", "q_type_share", "q_category_share", "q_store_best",
                 "q_store_worst", "q_article_detail", "q_divisions", "q_categories",
                 "q_chain_stores", "q_directorates", "q_dashboard_rollup"]:
        q[name] = getattr(dashboard, name)
    for name in commerce.NAMES:
        q[name] = getattr(commerce, name)
    for name in operators.NAMES:
        q[name] = getattr(operators, name)
    for alias, target in operators.ALIASES.items():
        q[alias] = q[target]
    return q
