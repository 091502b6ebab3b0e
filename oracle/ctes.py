"""DuckDB SQL twins of the Spark plans, written independently as plain SQL.

The driver registers the warehouse tables as views; each oracle query is a
``WITH`` chain built from the fragments below.  Decimal rules mirror the Spark
side: measures are DECIMAL(18,6), outputs are rounded half-up to two decimals
and returned as DOUBLE.
"""

from __future__ import annotations


def r2(expr: str) -> str:
    """Round half-up to 2 decimals via DECIMAL(38,6), as DOUBLE."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,6)), 2) AS DOUBLE)"


def ratio(num: str, den: str, scale: float = 1.0) -> str:
    return (f"CASE WHEN CAST({den} AS DOUBLE) = 0 THEN 0.0 "
            f"ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) * {scale!r} END")


def growth(new: str, old: str) -> str:
    return r2(ratio(f"({new}) - ({old})", old, 100.0))


def margin(profit: str, sales: str) -> str:
    return r2(ratio(profit, sales, 100.0))


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def num(col: str) -> str:
    """Tolerant number parse, NULL when not a finite decimal number."""
    t = f"trim({col})"
    v = f"TRY_CAST({t} AS DOUBLE)"
    return (f"(CASE WHEN NOT isnan({v}) AND abs({v}) <> 'inf'::DOUBLE "
            f"AND right({t}, 1) NOT IN ('d', 'D', 'f', 'F') THEN {v} END)")


def dec(expr: str) -> str:
    return f"CAST({expr} AS DECIMAL(18,6))"


def prev_year(d: str) -> str:
    return (f"(CASE WHEN month({d}) = 2 AND day({d}) = 29 THEN NULL "
            f"ELSE CAST({d} - INTERVAL 1 YEAR AS DATE) END)")


FEED = """feed AS (
  SELECT
    CASE WHEN l.l_orderkey % 97 = 0 THEN 'TRICLE'
         WHEN l.l_orderkey % 89 = 0 THEN 'SUPREME'
         WHEN l.l_orderkey % 83 = 0 THEN NULL
         ELSE strftime(l.l_shipdate, '%d-%m-%Y') END AS bdate,
    CASE WHEN l.l_suppkey % 41 = 0 THEN 'NA'
         WHEN l.l_suppkey % 43 = 0 THEN NULL
         WHEN l.l_suppkey % 47 = 0 THEN 'NON AKTIF ' || s.s_name
         ELSE s.s_name END AS nama_site,
    CASE WHEN l.l_suppkey % 53 = 0 THEN NULL ELSE CAST(l.l_suppkey AS VARCHAR) END AS kode_store,
    substr(CASE WHEN p.p_partkey % 71 = 0 THEN '123' ELSE p.p_type END, 1, 1) AS merdiv,
    'DIV ' || substr(CASE WHEN p.p_partkey % 71 = 0 THEN '123' ELSE p.p_type END, 1, 1) AS merdivdesc,
    CASE WHEN p.p_partkey % 71 = 0 THEN '123' ELSE p.p_type END AS mercat,
    CASE WHEN p.p_partkey % 71 = 0 THEN '123' ELSE p.p_type END AS mercatdesc,
    CAST(l.l_partkey AS VARCHAR) AS sku,
    p.p_name AS sku_desc,
    p.p_brand AS brand,
    p.p_brand AS principle,
    CASE WHEN l.l_linenumber = 7 AND l.l_orderkey % 5 = 0 THEN 'n/a'
         ELSE CAST(l.l_quantity AS VARCHAR) END AS qty,
    CAST(l.l_quantity * p.p_retailprice AS VARCHAR) AS cogs,
    CAST(l.l_extendedprice * (1 - l.l_discount) AS VARCHAR) AS netsales,
    CAST(l.l_extendedprice * (1 - l.l_discount) - l.l_quantity * p.p_retailprice AS VARCHAR) AS profit,
    CAST(l.l_quantity - l.l_linenumber AS VARCHAR) AS tqty,
    CAST(l.l_extendedprice * l.l_discount AS VARCHAR) AS tamt,
    CASE WHEN l.l_orderkey % 61 = 0 THEN NULL ELSE l.l_returnflag END AS tag,
    substr(o.o_orderpriority, 1, 1) AS rulecode,
    substr(o.o_orderpriority, 3) AS ruletype
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

_BASE_CLEAN = """bdate NOT IN ('TRICLE', 'SUPREME') AND bdate IS NOT NULL
    AND nama_site IS NOT NULL AND kode_store IS NOT NULL AND length(nama_site) >= 3
    AND NOT coalesce(regexp_matches(mercat, '^[0-9]+$'), false)"""

SALES_KEYS = ("nama_site, kode_store, bdate, merdiv, merdivdesc, mercat, mercatdesc, "
              "sku, sku_desc, brand, principle")
PROMO_KEYS = SALES_KEYS + ", rulecode, ruletype, tag"


def _nn(keys: str) -> str:
    return " AND ".join(f"{k.strip()} IS NOT NULL" for k in keys.split(","))


SALES_ROWS = f"""sales_rows AS (
  SELECT right(nama_site, 3) AS nama_site, kode_store,
    CAST(try_strptime(bdate, '%d-%m-%Y') AS DATE) AS bdate,
    merdiv, merdivdesc, mercat, mercatdesc, sku, sku_desc, brand, principle,
    {dec(num('qty'))} AS qty, {dec(num('cogs'))} AS cogs,
    {dec(num('netsales'))} AS netsales, {dec(num('profit'))} AS profit
  FROM feed
  WHERE {_BASE_CLEAN}
    AND {num('qty')} IS NOT NULL AND {num('cogs')} IS NOT NULL
    AND {num('netsales')} IS NOT NULL AND {num('profit')} IS NOT NULL
)"""

SALES_CLEAN = f"""sales_clean AS (
  SELECT {SALES_KEYS}, SUM(qty) AS qty, SUM(cogs) AS cogs, SUM(netsales) AS netsales, SUM(profit) AS profit
  FROM sales_rows WHERE {_nn(SALES_KEYS)}
  GROUP BY {SALES_KEYS}
)"""

_POS = " AND ".join(f"{num(c)} > 0" for c in ("qty", "cogs", "netsales", "profit", "tqty", "tamt"))

PROMO_ROWS = f"""promo_rows AS (
  SELECT right(nama_site, 3) AS nama_site, kode_store,
    CAST(try_strptime(bdate, '%d-%m-%Y') AS DATE) AS bdate,
    merdiv, merdivdesc, mercat, mercatdesc, sku, sku_desc, brand, principle, rulecode, ruletype, tag,
    {dec(num('qty'))} AS qty, {dec(num('cogs'))} AS cogs,
    {dec(num('netsales'))} AS netsales, {dec(num('profit'))} AS profit,
    {dec(num('tqty'))} AS tqty, {dec(num('tamt'))} AS tamt,
    {dec(f"{num('netsales')} / {num('qty')} * {num('tqty')}")} AS tnetsales,
    {dec(f"{num('cogs')} / {num('qty')} * {num('tqty')}")} AS tcogs,
    {dec(f"{num('profit')} / {num('qty')} * {num('tqty')}")} AS tprofit
  FROM feed
  WHERE {_BASE_CLEAN} AND {_POS}
)"""

PROMO_MEASURES = ("qty", "cogs", "netsales", "profit", "tqty", "tamt", "tnetsales", "tcogs", "tprofit")

PROMO_CLEAN = f"""promo_clean AS (
  SELECT {PROMO_KEYS}, {", ".join(f"SUM({m}) AS {m}" for m in PROMO_MEASURES)}
  FROM promo_rows WHERE {_nn(PROMO_KEYS)}
  GROUP BY {PROMO_KEYS}
)"""

CLEAN = [FEED, SALES_ROWS, SALES_CLEAN, PROMO_ROWS, PROMO_CLEAN]

FACT_SELECT = """ty.bdate AS bdate_y, ty.kode_store, ty.nama_site, ty.sku, ty.sku_desc AS sku_desc_y,
    ty.merdiv AS merdiv_y, ty.merdivdesc AS merdivdesc_y, ty.mercat AS mercat_y,
    ty.mercatdesc AS mercatdesc_y, ty.brand AS brand_y, ty.principle AS principle_y, ty.tag,
    ly.qty_x, ly.cogs_x, ly.netsales_x, ly.profit_x,
    ty.qty AS qty_y, ty.cogs AS cogs_y, ty.netsales AS netsales_y, ty.profit AS profit_y,
    ty.tqty, ty.tnetsales, ty.tcogs, ty.tprofit, ty.rulecode, ty.ruletype"""

FACT_MEASURES = ("qty_x", "cogs_x", "netsales_x", "profit_x", "qty_y", "cogs_y", "netsales_y",
                 "profit_y", "tqty", "tnetsales", "tcogs", "tprofit")


def facts(name: str = "facts", keys: tuple[str, ...] = ("kode_store", "nama_site", "sku"),
          period: str = "day") -> list[str]:
    """Article facts at a grain: join keys + 'day' or 'month' bucket."""
    bucket = "bdate" if period == "day" else "CAST(date_trunc('month', bdate) AS DATE)"
    k = ", ".join(keys)
    ly = f"""{name}_ly AS (
  SELECT {k}, {bucket} AS period, SUM(qty) AS qty_x, SUM(cogs) AS cogs_x,
    SUM(netsales) AS netsales_x, SUM(profit) AS profit_x
  FROM sales_clean WHERE {bucket} IS NOT NULL
  GROUP BY {k}, {bucket}
)"""
    if period == "day":
        ty_src = "promo_clean"
        extra = []
    else:
        ty_src = f"{name}_ty"
        keys_no_date = PROMO_KEYS.replace("bdate, ", "")
        extra = [f"""{name}_ty AS (
  SELECT {bucket} AS bdate, {keys_no_date}, {", ".join(f"SUM({m}) AS {m}" for m in PROMO_MEASURES)}
  FROM promo_clean
  GROUP BY {bucket}, {keys_no_date}
)"""]
    on = " AND ".join(f"ty.{c} = ly.{c}" for c in keys)
    fct = f"""{name} AS (
  SELECT {FACT_SELECT}
  FROM {ty_src} ty JOIN {name}_ly ly ON {on} AND ly.period = {prev_year('ty.bdate')}
)"""
    return [ly, *extra, fct]


def present_facts(src: str, extra_cols: str = "") -> str:
    dims = ("bdate_y, kode_store, nama_site, sku, sku_desc_y, merdiv_y, merdivdesc_y, mercat_y, "
            "mercatdesc_y, brand_y, principle_y, tag, rulecode, ruletype")
    ms = ", ".join(f"{r2(m)} AS {m}" for m in FACT_MEASURES)
    return f"SELECT {dims}, {ms}{extra_cols} FROM {src}"
