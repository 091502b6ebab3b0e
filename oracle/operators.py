"""Oracle SQL of the operator-level queries."""

from oracle import commerce, dashboard, nightly
from oracle.ctes import CLEAN, FEED, SALES_KEYS, dec, facts, num, present_facts, r2, with_

_CLEAN_SALES_SQL = nightly.SQL["q_clean_sales"]


def _profile(pred: str) -> str:
    return with_(FEED) + f"SELECT COALESCE({pred}, false) AS kept, COUNT(*) AS n FROM feed GROUP BY 1"


def _kpi_by_store() -> str:
    return dashboard.with_(*dashboard.BASE, dashboard.scope()) + dashboard.kpi_sql("scope", "kode_store")


_PRUNE_DAYS = ("1998-03-15", "1998-03-28")
_DATE_PRUNE = with_(*CLEAN).replace(
    "FROM sales_rows WHERE",
    f"FROM sales_rows WHERE bdate BETWEEN DATE '{_PRUNE_DAYS[0]}' AND DATE '{_PRUNE_DAYS[1]}' AND") + \
    f"SELECT {SALES_KEYS}, " + ", ".join(f"{r2(m)} AS {m}" for m in ("qty", "cogs", "netsales", "profit")) + \
    " FROM sales_clean"

_CAT_KEYS = "bdate_y, kode_store, nama_site, mercat_y, mercatdesc_y, rulecode, ruletype"
_FM = ("qty_x", "cogs_x", "netsales_x", "profit_x", "qty_y", "cogs_y", "netsales_y", "profit_y",
       "tqty", "tnetsales", "tcogs", "tprofit")

_IN_1998 = " WHERE bdate_y BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"
_BROKEN = "CAST(sku AS BIGINT) % 101 = 0 OR CAST(sku AS BIGINT) % 103 = 0"

SQL = {
    "src_promo_headers": nightly.SQL["q_clean_promo"],
    "src_day_files": _DATE_PRUNE,
    "src_quarantine": with_(FEED) + """SELECT CASE WHEN CAST(sku AS BIGINT) % 101 = 0 THEN 'too few fields'
      WHEN CAST(sku AS BIGINT) % 103 = 0 THEN 'too many fields' ELSE 'record' END AS outcome, COUNT(*) AS lines FROM feed GROUP BY 1""",
    "src_quarantine_clean": with_(*CLEAN).replace("FROM sales_rows WHERE", f"FROM sales_rows WHERE NOT ({_BROKEN}) AND")
    + f"SELECT {SALES_KEYS}, " + ", ".join(f"{r2(m)} AS {m}" for m in ("qty", "cogs", "netsales", "profit")) + " FROM sales_clean",
    "src_clean_pipe": with_(*dashboard.BASE) + present_facts("facts") + " WHERE bdate_y BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'",
    "snk_article_store": nightly.SQL["q_article_growth_daily"] + _IN_1998,
    "snk_category_store": f"SELECT * FROM ({nightly.SQL['q_category_growth_daily']})" + _IN_1998,
    "stream_day_refresh": nightly.SQL["q_article_growth_daily"] + _IN_1998,
    "stream_article_growth": with_(*CLEAN, *facts("facts", ("sku",), "day")) + present_facts("facts"),
    "src_sales_csv": _CLEAN_SALES_SQL,
    "src_promo_csv": nightly.SQL["q_clean_promo"],
    "src_date_prune": _DATE_PRUNE,
    "src_clean": with_(*dashboard.BASE) + present_facts("facts")
    + " WHERE bdate_y BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'",
    "snk_article": nightly.SQL["q_article_growth_monthly"],
    "snk_category": nightly.SQL["q_category_growth_monthly"],
    "snk_json": _kpi_by_store(),
    "src_master": """SELECT CAST(s_suppkey AS VARCHAR) AS store_code, right(s_name, 3) AS initial,
      CASE WHEN s_suppkey % 3 > 0 THEN 'CHAIN' ELSE 'OTHER' END AS type_store FROM supplier""",
    "src_article_list": "SELECT CAST(p_partkey AS VARCHAR) AS plu FROM part WHERE p_partkey % 4 = 0",
    "src_table": "SELECT p_partkey, p_name FROM part",
    "src_json_nested": """SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS ro_city_id,
      CAST(n_regionkey AS BIGINT) AS ro_province_id, 'Kota' AS ro_type, n_name AS ro_city_name
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "src_json_provinces": """SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS ro_province_id, r_name AS ro_province
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "cln_sentinel": _profile("NOT COALESCE(bdate IN ('TRICLE', 'SUPREME'), false)"),
    "cln_not_null": _profile("bdate IS NOT NULL AND nama_site IS NOT NULL AND kode_store IS NOT NULL"),
    "cln_min_len": _profile("length(nama_site) >= 3"),
    "cln_numeric_code": _profile("NOT COALESCE(regexp_matches(mercat, '^[0-9]+$'), false)"),
    "cln_numeric_measure": _profile(" AND ".join(f"{num(c)} IS NOT NULL" for c in ("qty", "cogs", "netsales", "profit"))),
    "cln_rejects": with_(FEED) + " UNION ALL ".join(
        f"""SELECT '{c}' AS measure, COUNT(*) FILTER (WHERE {c} IS NOT NULL AND {num(c)} IS NULL) AS not_a_number,
        COUNT(*) FILTER (WHERE abs({num(c)}) > 999999999999.0) AS too_large, COUNT(*) FILTER (WHERE {num(c)} <= 0) AS not_positive FROM feed"""
        for c in ("qty", "cogs", "netsales", "profit", "tqty", "tamt")),
    "cln_positive": _profile(" AND ".join(f"{num(c)} > 0" for c in ("qty", "cogs", "netsales", "profit", "tqty", "tamt"))),
    "cln_inactive": _profile("NOT COALESCE(contains(nama_site, 'NON AKTIF'), false)"),
    "cln_site_suffix": with_(FEED) + "SELECT DISTINCT nama_site, right(nama_site, 3) AS site_code FROM feed WHERE nama_site IS NOT NULL",
    "cln_cast": with_(FEED) + "SELECT " + ", ".join(
        f"{r2(f'SUM({dec(num(c))})')} AS {c}" for c in ("qty", "cogs", "netsales", "profit", "tqty", "tamt")) + " FROM feed",
    "cln_lower_cols": with_(FEED) + "SELECT merdiv, COUNT(*) AS n FROM feed GROUP BY merdiv",
    "agg_by_type": dashboard.with_(*dashboard.BASE, dashboard.scope()) + f"""
      SELECT rulecode, ruletype, {r2('SUM(tnetsales)')} AS tnetsales, {r2('SUM(netsales_x)')} AS netsales_x,
        {r2('SUM(tqty)')} AS tqty FROM scope GROUP BY rulecode, ruletype""",
    "agg_by_category": dashboard.with_(*dashboard.BASE, dashboard.scope()) + f"""
      SELECT mercat_y, mercatdesc_y, {r2('SUM(tnetsales)')} AS tnetsales, {r2('SUM(netsales_x)')} AS netsales_x,
        {r2('SUM(tqty)')} AS tqty FROM scope GROUP BY mercat_y, mercatdesc_y""",
    "fn_substr": "SELECT DISTINCT p_type AS cat, substr(p_type, 1, 1) AS div FROM part",
    "fn_length": with_(FEED) + "SELECT length(nama_site) AS len, COUNT(*) AS n FROM feed GROUP BY 1",
    "fn_isnumeric": with_(FEED) + "SELECT regexp_matches(mercat, '^[0-9]+$') AS is_numeric, COUNT(*) AS n FROM feed GROUP BY 1",
    "fn_contains": with_(FEED) + "SELECT contains(nama_site, 'NON AKTIF') AS inactive, COUNT(*) AS n FROM feed GROUP BY 1",
    "fn_split": """SELECT p_brand, split_part(p_brand, '#', 2) AS brand_no,
      split_part('newclean_article_growth_' || p_brand || '.csv', '_', 4) AS token
      FROM (SELECT DISTINCT p_brand FROM part) b""",
    "fn_replace": commerce.W() + """
      SELECT p.id AS product_id, COALESCE(printf('%.1f', round(r.avg_rating, 0)), '4.0') AS total_rating,
        replace(COALESCE(printf('%.1f', round(r.avg_rating, 0)), '4.0'), '.', '_') AS star_rating
      FROM products p LEFT JOIN (SELECT product_id, AVG(rating) AS avg_rating FROM reviews GROUP BY product_id) r
        ON r.product_id = p.id""",
    "fn_to_number": with_(FEED) + f"""SELECT {num('qty')} IS NOT NULL AS parsed, COUNT(*) AS n,
      {r2(f"SUM({dec(num('qty'))})")} AS qty FROM feed GROUP BY 1""",
    "fn_parse_date": with_(FEED) + """SELECT year(CAST(try_strptime(bdate, '%d-%m-%Y') AS DATE)) AS year, COUNT(*) AS n
      FROM feed GROUP BY 1""",
    "fn_format_date": """SELECT o_orderkey, strftime(o_orderdate, '%d/%m') AS day_label, strftime(o_orderdate, '%y%m') AS yymm,
      strftime(o_orderdate, '%Y%m%d') AS fday, strftime(o_orderdate, '%d-%m-%Y %H:%M:%S') AS stamp FROM orders""",
    "fn_date_range": commerce.W() + """SELECT id, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS day
      FROM promotions""",
    "fn_date_shift": """SELECT d, CASE WHEN month(d) = 2 AND day(d) = 29 THEN NULL ELSE CAST(d - INTERVAL 1 YEAR AS DATE) END AS ly,
      CAST(d - INTERVAL 14 DAY AS DATE) AS pre_start, CAST(d - INTERVAL 1 DAY AS DATE) AS pre_end
      FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem) x""",
    "fn_format_number": f"""SELECT kode_store, format('{{:,.2f}}', total_netsales_m) AS netsales_text,
      format('{{:,.0f}}', total_qty) AS qty_text FROM ({_kpi_by_store()}) k""",
    "fn_percent_text": f"""SELECT kode_store, printf('%.2f', sales_growth) || '%' AS growth_text FROM ({_kpi_by_store()}) k""",
}
