"""Oracle SQL of the nightly build queries."""

from oracle.ctes import CLEAN, PROMO_KEYS, PROMO_MEASURES, SALES_KEYS, facts, present_facts, r2, with_

_CAT_KEYS = "bdate_y, kode_store, nama_site, mercat_y, mercatdesc_y, rulecode, ruletype"
_FM = ("qty_x", "cogs_x", "netsales_x", "profit_x", "qty_y", "cogs_y", "netsales_y", "profit_y",
       "tqty", "tnetsales", "tcogs", "tprofit")

_STORE_CATEGORY = ("kode_store", "nama_site", "mercat")


def _category(src: str) -> str:
    return (f"SELECT {_CAT_KEYS}, " + ", ".join(f"{r2(f'SUM({m})')} AS {m}" for m in _FM)
            + f" FROM {src} GROUP BY {_CAT_KEYS}")


SQL = {
    "q_clean_sales": with_(*CLEAN) + f"SELECT {SALES_KEYS}, " + ", ".join(
        f"{r2(m)} AS {m}" for m in ("qty", "cogs", "netsales", "profit")) + " FROM sales_clean",
    "q_clean_promo": with_(*CLEAN) + f"SELECT {PROMO_KEYS}, " + ", ".join(
        f"{r2(m)} AS {m}" for m in PROMO_MEASURES) + " FROM promo_clean",
    "q_article_growth": with_(*CLEAN, *facts("facts")) + present_facts("facts"),
    "q_category_growth": with_(*CLEAN, *facts("facts")) + _category("facts"),
    "q_article_growth_monthly": with_(*CLEAN, *facts("facts", ("sku",), "month")) + present_facts("facts"),
    "q_article_growth_daily": with_(*CLEAN, *facts("facts", _STORE_CATEGORY, "day")) + present_facts("facts"),
    "q_category_growth_daily": with_(*CLEAN, *facts("facts", _STORE_CATEGORY, "day")) + _category("facts"),
    "q_category_growth_monthly": with_(*CLEAN, *facts("facts", ("sku",), "month")) + _category("facts"),
}
