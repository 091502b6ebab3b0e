"""Oracle SQL of the dashboard queries (month-grain facts, H1 1998 window)."""

from oracle.ctes import CLEAN, FACT_MEASURES, facts, growth, margin, r2, ratio, with_

DIRS = "(VALUES ('P', 'FASHION'), ('E', 'FASHION'), ('M', 'HOME'), ('S', 'HOME')) AS d(directorate_code, dirdesc)"

WINDOW = ("1998-01-01", "1998-06-30")
PRE = ("1997-07-01", "1997-12-31")
STORE = "1"
ARTICLE = "1080"

BASE = [*CLEAN, *facts("facts", ("sku",), "month")]


def scope(name: str = "scope", window=WINDOW, extra: str = "", stores: bool = True) -> str:
    st = ("AND f.kode_store IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 > 0)"
          if stores else "")
    return f"""{name} AS (
  SELECT f.* FROM facts f
  WHERE f.bdate_y BETWEEN DATE '{window[0]}' AND DATE '{window[1]}'
    AND f.sku IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 0)
    {st} {extra}
)"""


def present_scope(src: str) -> str:
    dims = ("bdate_y, kode_store, nama_site, sku, sku_desc_y, merdiv_y, merdivdesc_y, mercat_y, "
            "mercatdesc_y, brand_y, principle_y, tag, rulecode, ruletype")
    return f"SELECT {dims}, " + ", ".join(f"{r2(m)} AS {m}" for m in FACT_MEASURES) + f" FROM {src}"


def _cls(c: str) -> str:
    return f"CASE WHEN {c} > 1 THEN 'bg-green' WHEN {c} >= 0 THEN 'bg-yellow' ELSE 'bg-red' END AS {c}_class"


def kpi_sql(src: str, keys: str = "") -> str:
    k = f"{keys}, " if keys else ""
    gb = f" GROUP BY {keys}" if keys else ""
    if keys:
        agg = ", ".join(f"SUM({m}) AS {m}" for m in ("tnetsales", "tqty", "tprofit", "netsales_x", "qty_x", "profit_x"))
    else:
        agg = ", ".join(f"COALESCE(SUM({m}), 0) AS {m}" for m in ("tnetsales", "tqty", "tprofit", "netsales_x", "qty_x", "profit_x"))
    inner = f"""SELECT {k}{r2('tnetsales / 1000000.0')} AS total_netsales_m,
      CAST(ROUND(tqty, 0) AS DOUBLE) AS total_qty,
      {growth('tnetsales', 'netsales_x')} AS sales_growth,
      {growth('tqty', 'qty_x')} AS qty_growth,
      {growth('tprofit', 'profit_x')} AS profit_growth,
      {margin('tprofit', 'tnetsales')} AS margin_promo
    FROM (SELECT {k}{agg} FROM {src}{gb}) g"""
    return (f"SELECT *, {_cls('sales_growth')}, {_cls('qty_growth')}, {_cls('profit_growth')}, "
            f"{_cls('margin_promo')} FROM ({inner}) k")


def daily_sql(src: str, scale: float = 100.0, extra_col: str = "") -> str:
    return f"""SELECT bdate_y, strftime(bdate_y, '%d/%m') AS day_label, {r2('tqty')} AS tqty,
      {r2(ratio('tcogs', 'tqty'))} AS avg_tcogs, {r2(ratio('tnetsales', 'tqty'))} AS avg_tnetsales,
      {r2(ratio('tprofit', 'tnetsales', scale))} AS total_margin{extra_col}
    FROM (SELECT bdate_y, SUM(tqty) AS tqty, SUM(tcogs) AS tcogs, SUM(tnetsales) AS tnetsales,
          SUM(tprofit) AS tprofit FROM {src} GROUP BY bdate_y) g"""


# Daily series: the promotion runs from 15 to 28 March 1998; the days before are
# start - 14 ... start - 1, both inclusive.
_START, _END = "DATE '1998-03-15'", "DATE '1998-03-28'"
_DAYS = {
    "during": f"SELECT 'during' AS series, CAST(d AS DATE) AS bdate_y FROM generate_series({_START}, {_END}, INTERVAL 1 DAY) AS t(d)",
    "before": f"SELECT 'before' AS series, CAST(d AS DATE) AS bdate_y FROM generate_series({_START} - INTERVAL 14 DAY, {_START} - INTERVAL 1 DAY, INTERVAL 1 DAY) AS t(d)",
}


def series_sql(which: tuple[str, ...] = ("during", "before"), keys: tuple[str, ...] = (), scale: float = 100.0) -> str:
    """One row for each key, series and day; days without sales are zero."""
    k = "".join(f"{c}, " for c in keys)
    base = with_(*CLEAN, *facts("facts", ("mercat",), "day"),
                 "days AS (" + " UNION ALL ".join(_DAYS[w] for w in which) + ")",
                 f"""sold AS (
  SELECT {k}bdate_y, SUM(tqty) AS tqty, SUM(tcogs) AS tcogs, SUM(tnetsales) AS tnetsales, SUM(tprofit) AS tprofit
  FROM facts
  WHERE bdate_y IN (SELECT bdate_y FROM days)
    AND sku IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 4 = 0)
    AND kode_store IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 3 > 0)
  GROUP BY {k}bdate_y
)""",
                 f"grid AS (SELECT * FROM {'(SELECT DISTINCT ' + k[:-2] + ' FROM sold) e CROSS JOIN ' if keys else ''}days)")
    on = " AND ".join([f"grid.{c} = sold.{c}" for c in keys] + ["grid.bdate_y = sold.bdate_y"])
    m = {c: f"COALESCE(sold.{c}, 0)" for c in ("tqty", "tcogs", "tnetsales", "tprofit")}
    return base + f"""SELECT {"".join(f"grid.{c}, " for c in keys)}grid.series, grid.bdate_y, strftime(grid.bdate_y, '%d/%m') AS day_label,
      {r2(m['tqty'])} AS tqty, {r2(ratio(m['tcogs'], m['tqty']))} AS avg_tcogs, {r2(ratio(m['tnetsales'], m['tqty']))} AS avg_tnetsales,
      {r2(ratio(m['tprofit'], m['tnetsales'], scale))} AS total_margin, sold.tqty IS NOT NULL AS has_sales
    FROM grid LEFT JOIN sold ON {on}"""


def growth_top_sql(src: str, keys: str, asc: bool = True) -> str:
    d = "ASC" if asc else "DESC"
    return f"""SELECT {keys}, {r2('tnetsales')} AS tnetsales, {r2('netsales_x')} AS netsales_x,
      {growth('tnetsales', 'netsales_x')} AS growth
    FROM (SELECT {keys}, SUM(tnetsales) AS tnetsales, SUM(netsales_x) AS netsales_x FROM {src} GROUP BY {keys}) g
    ORDER BY {ratio('g.tnetsales - g.netsales_x', 'g.netsales_x', 100.0)} {d}, {keys} LIMIT 5"""


def share_sql(src: str, keys: str) -> str:
    return f"""SELECT {keys}, {r2('tnetsales')} AS tnetsales,
      {ratio('g.tnetsales', 'SUM(g.tnetsales) OVER ()', 100.0)} AS share
    FROM (SELECT {keys}, SUM(tnetsales) AS tnetsales FROM {src} GROUP BY {keys}) g
    ORDER BY {keys} LIMIT 5"""


def store_sql(src: str, best: bool) -> str:
    d = "DESC" if best else "ASC"
    return f"""SELECT kode_store, nama_site, {r2('tnetsales')} AS tnetsales, {r2('netsales_x')} AS netsales_x,
      {growth('tnetsales', 'netsales_x')} AS growth
    FROM (SELECT kode_store, nama_site, SUM(tnetsales) AS tnetsales, SUM(netsales_x) AS netsales_x
          FROM {src} GROUP BY kode_store, nama_site) g
    ORDER BY {ratio('g.tnetsales - g.netsales_x', 'g.netsales_x', 100.0)} {d}, kode_store ASC LIMIT 5"""


DETAIL_KEYS = "nama_site, sku, merdiv_y, merdivdesc_y, mercat_y, mercatdesc_y, brand_y, sku_desc_y, principle_y, tag"


def detail_sql(src: str) -> str:
    ms = ", ".join(f"{r2(m)} AS {m}" for m in FACT_MEASURES)
    sums = ", ".join(f"SUM({m}) AS {m}" for m in FACT_MEASURES)
    tym = ratio("tprofit", "tnetsales", 100.0)
    lym = ratio("profit_x", "netsales_x", 100.0)
    return f"""SELECT g.*, d.directorate_code, d.dirdesc FROM (
      SELECT {DETAIL_KEYS}, {ms},
        {growth('tnetsales', 'netsales_x')} AS growth_netsales,
        {growth('tqty', 'qty_x')} AS growth_qty,
        {growth('tprofit', 'profit_x')} AS growth_profit,
        {r2(tym)} AS ty_margin, {r2(lym)} AS ly_margin, {r2(f'({tym}) - ({lym})')} AS margin_change
      FROM (SELECT {DETAIL_KEYS}, {sums} FROM {src} GROUP BY {DETAIL_KEYS}) a) g
    JOIN {DIRS} ON g.merdiv_y = d.directorate_code"""


_RK = "bdate_y, kode_store, nama_site, rulecode, ruletype, mercat_y, mercatdesc_y"
_RM = ("tnetsales", "tqty", "tprofit", "tcogs", "netsales_x", "qty_x", "profit_x")


def rollup_sql(src: str) -> str:
    sums = ", ".join(f"SUM({m}) AS {m}" for m in _RM)
    return f"""SELECT CASE WHEN gs = 0 THEN 'store' WHEN gd = 0 THEN 'day' WHEN gt = 0 THEN 'type'
        WHEN gc = 0 THEN 'category' ELSE 'total' END AS level, {_RK},
      {", ".join(f"{r2(m)} AS {m}" for m in _RM)},
      {growth('tnetsales', 'netsales_x')} AS sales_growth, {growth('tqty', 'qty_x')} AS qty_growth,
      {growth('tprofit', 'profit_x')} AS profit_growth, {margin('tprofit', 'tnetsales')} AS margin,
      {r2(ratio('tnetsales', 'tqty'))} AS avg_price
    FROM (SELECT {_RK}, {sums}, GROUPING(kode_store) AS gs, GROUPING(bdate_y) AS gd, GROUPING(rulecode) AS gt,
            GROUPING(mercat_y) AS gc
          FROM {src}
          GROUP BY GROUPING SETS ((), (kode_store, nama_site), (bdate_y), (rulecode, ruletype),
                                  (mercat_y, mercatdesc_y))) g"""


SQL = {
    "q_dashboard_rollup": with_(*BASE, scope()) + rollup_sql("scope"),
    "q_promo_scope": with_(*BASE, scope()) + present_scope("scope"),
    "q_promo_scope_category": with_(*BASE, scope(extra="AND f.mercat_y = 'PROMO'")) + present_scope("scope"),
    "q_promo_scope_directorate": with_(*BASE, scope(
        extra=f"AND substr(f.mercat_y, 1, 1) IN (SELECT directorate_code FROM {DIRS} WHERE dirdesc = 'FASHION')"))
    + present_scope("scope"),
    "q_promo_scope_division": with_(*BASE, scope(extra="AND substr(f.mercat_y, 1, 1) = 'S'")) + present_scope("scope"),
    "q_kpi": with_(*BASE, scope()) + kpi_sql("scope"),
    "q_kpi_store": with_(*BASE, scope(extra=f"AND f.kode_store = '{STORE}'")) + f"SELECT '{STORE}' AS kode_store, k.* FROM ({kpi_sql('scope')}) k",
    "q_kpi_empty_store": with_(*BASE, scope(extra="AND f.kode_store = 'no such store'"))
    + f"SELECT 'no such store' AS kode_store, k.* FROM ({kpi_sql('scope')}) k",
    "q_kpi_dedupe": with_(*BASE, scope(), f"""ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY sku, bdate_y ORDER BY kode_store, nama_site, rulecode, ruletype, tag, sku_desc_y, merdiv_y, merdivdesc_y, mercat_y, mercatdesc_y, brand_y, principle_y, sku) AS rn FROM scope)""",
        "once AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN rn = 1 THEN {m} ELSE 0 END AS {m}" for m in FACT_MEASURES if m.endswith("_x"))
        + ") FROM ranked)") + kpi_sql("once"),
    "q_growth_bars": with_(*BASE, scope()) + f"""SELECT rulecode, ruletype, {growth('tnetsales', 'netsales_x')} AS growth,
      CASE WHEN {ratio('tnetsales - netsales_x', 'netsales_x', 100.0)} <= 0 THEN 'red' ELSE 'green' END AS color
    FROM (SELECT rulecode, ruletype, SUM(tnetsales) AS tnetsales, SUM(netsales_x) AS netsales_x FROM scope GROUP BY rulecode, ruletype) g""",
    "q_kpi_by_store": with_(*BASE, scope()) + kpi_sql("scope", "kode_store"),
    "q_daily_during": series_sql(("during",)),
    "q_daily_before": series_sql(("before",)),
    "q_daily_series": series_sql(),
    "q_daily_store_category": series_sql(keys=("kode_store", "mercat_y")),
    "q_daily_article": series_sql(keys=("sku",), scale=1.0),
    "q_monthly_during": with_(*BASE, scope()) + daily_sql("scope"),
    "q_monthly_before": with_(*BASE, scope(window=PRE)) + daily_sql("scope"),
    "q_monthly_article": with_(*BASE, scope("during", extra=f"AND f.sku = '{ARTICLE}'"),
                             scope("before", window=PRE, extra=f"AND f.sku = '{ARTICLE}'"))
    + daily_sql("during", 1.0, ", 'during' AS series") + " UNION ALL "
    + daily_sql("before", 1.0, ", 'before' AS series"),
    "q_type_growth": with_(*BASE, scope()) + growth_top_sql("scope", "rulecode, ruletype"),
    "q_category_growth_top": with_(*BASE, scope()) + growth_top_sql("scope", "mercat_y, mercatdesc_y"),
    "q_type_share": with_(*BASE, scope()) + share_sql("scope", "rulecode, ruletype"),
    "q_category_share": with_(*BASE, scope()) + share_sql("scope", "mercat_y, mercatdesc_y"),
    "q_store_best": with_(*BASE, scope()) + store_sql("scope", True),
    "q_store_worst": with_(*BASE, scope()) + store_sql("scope", False),
    "q_article_detail": with_(*BASE, scope()) + detail_sql("scope"),
    "q_divisions": f"""SELECT DISTINCT substr(p_type, 1, 1) AS div, 'DIV ' || substr(p_type, 1, 1) AS divdesc
      FROM part WHERE substr(p_type, 1, 1) IN (SELECT directorate_code FROM {DIRS} WHERE dirdesc = 'FASHION')""",
    "q_categories": "SELECT DISTINCT p_type AS cat, p_type AS catdesc FROM part WHERE substr(p_type, 1, 1) = 'S'",
    "q_chain_stores": """SELECT CAST(s_suppkey AS VARCHAR) AS store_code, right(s_name, 3) AS initial,
      'CHAIN' AS type_store FROM supplier WHERE s_suppkey % 3 > 0 ORDER BY initial, store_code""",
    "q_directorates": f"""SELECT DISTINCT dirdesc FROM {DIRS}
      WHERE directorate_code IN (SELECT substr(p_type, 1, 1) FROM part) ORDER BY dirdesc""",
}
