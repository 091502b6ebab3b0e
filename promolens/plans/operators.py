"""Operator-level queries: one per SURVEY §2 operator ID that is not already
a named query of its own.  Each runs the operator over whole warehouse
tables (or data Spark derives from them); sources and sinks write to a fresh
folder under the shared checkpoint folder and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promolens.functions import dates as D
from promolens.functions import text as X
from promolens.functions.numeric import measure, round2
from promolens.operators import clean as CL
from promolens.operators.aggregate import sum_by
from promolens.operators.yoy import DAILY_STORE_CATEGORY_GRAIN, Grain, category_facts
from promolens.schemas import ARTICLE_FACT_SCHEMA, CATEGORY_FACT_SCHEMA, RAW_PROMO_USED, RAW_SALES_COLUMNS, RAW_SALES_USED
from promolens.plans import dashboard as DB
from promolens.plans.common import facts_from_tables, inputs_version, present, read_facts
from promolens.session import discard, dropping_shuffles, scratch_path, session_key
from promolens.sources import commerce as C
from promolens.sources import files as FS
from promolens.sources.fact_store import FactStore
from promolens.sources.fixtures import article_list, feed_lines, feed_of_lines, raw_feed, stores
from promolens.sources.tables import read_table

# --- sources and sinks ----------------------------------------------------------

PRUNE_START, PRUNE_END = "1998-03-15", "1998-03-28"


_RAW: dict[tuple, str] = {}


# column orders of promotion files: as listed, reversed without the optional column, rotated
PROMO_LAYOUTS = [list(RAW_PROMO_USED), [c for c in reversed(RAW_PROMO_USED) if c != "member"], RAW_PROMO_USED[7:] + RAW_PROMO_USED[:7]]


#: lines of a compressed file of the zone without folders (about 70 MB)
LINES_A_FILE = 2_000_000


def _with_broken_lines(feed: DataFrame) -> DataFrame:
    """The feed as sales lines; by article some lost their last fields, some gained one."""
    cells = [F.coalesce(F.col(c.lower()), F.lit("")) if c in RAW_SALES_USED and c.lower() in feed.columns else F.lit("") for c in RAW_SALES_COLUMNS]
    short, sku = cells[:20], F.col("sku").cast("long")
    return feed.select(F.when(sku % 101 == 0, F.concat_ws("|", *short)).when(sku % 103 == 0, F.concat_ws("|", *cells, F.lit("x")))
                       .otherwise(F.concat_ws("|", *cells)).alias("value"))


def _write_zone(spark: SparkSession, sf: str, kind: str, path: str, lines: DataFrame | None = None) -> None:
    """One raw zone; ``lines`` are the feed's joined rows where they are there already."""
    days = kind.endswith("-days")
    lines = lines if lines is not None else feed_lines(spark, sf)
    # the text is written compressed
    if kind == "sales-broken":
        broken = _with_broken_lines(feed_of_lines(lines)).write.option("compression", "gzip")
        broken.option("maxRecordsPerFile", LINES_A_FILE).text(path)              # such a file is one task's work
        return
    # rows move to their folder before they become text
    feed = feed_of_lines(FS.by_folder(lines, days))
    how = {"laid_out": True, "compression": "gzip"}
    if kind == "promo-layouts":
        part = F.pmod(F.col("sku").cast("long"), F.lit(len(PROMO_LAYOUTS)))
        for i, columns in enumerate(PROMO_LAYOUTS):
            FS.write_raw_feed(feed.where(part == i), path, "promo", columns=columns, mode="append", **how)
    else:
        FS.write_raw_feed(feed, path, kind.removesuffix("-days"), days=days, **how)


def _raw_zones(spark: SparkSession, sf: str, *kinds: str) -> list[str]:
    """The feed written as raw text zones, once for each version of the input files and kind.

    Several zones are written from one join: its rows are staged as Parquet (no wider than
    one of the join's shuffles) and dropped with the last zone.  No step keeps the shuffle
    files of the one before."""
    version = inputs_version(spark, sf)
    keys = {kind: (session_key(spark), version, kind) for kind in kinds}
    missing = [kind for kind in kinds if version is None or keys[kind] not in _RAW]
    with dropping_shuffles(spark):
        lines = staged = None
        if len(missing) > 1:
            staged, joined = scratch_path(spark, "feed-lines"), feed_lines(spark, sf)
            joined.write.parquet(staged)
            lines = spark.read.schema(joined.schema).parquet(staged)
        try:
            for kind in missing:
                path = scratch_path(spark, f"raw-{kind}")
                _write_zone(spark, sf, kind, path, lines)
                _RAW[keys[kind]] = path
        finally:
            if staged is not None:
                discard(spark, staged)
    return [_RAW[keys[kind]] for kind in kinds]


def _raw_zone(spark: SparkSession, sf: str, kind: str) -> str:
    return _raw_zones(spark, sf, kind)[0]


STREAM_GRAIN = Grain(keys=("sku",), period="day")


def stream_article_growth(spark, sf):
    """The incremental nightly build (Structured Streaming, AvailableNow) over
    the raw zones (one micro-batch per run); the written facts equal the batch
    build's facts at the same grain."""
    from promolens.streaming.nightly import start_incremental_build
    out = scratch_path(spark, "stream-facts")
    FS.write_facts(spark.createDataFrame([], ARTICLE_FACT_SCHEMA), out)      # the table exists before the first batch
    q = start_incremental_build(spark, *_raw_zones(spark, sf, "promo", "sales"), out, grain=STREAM_GRAIN)
    q.awaitTermination()
    return present(FS.read_clean(spark, out))


def src_sales_csv(spark, sf):
    """SRC_SALES_CSV: the feed written as headerless 32-column pipe files and
    read back positionally, then cleaned (same rows as Q_CLEAN_SALES)."""
    raw = FS.read_sales_csv(spark, _raw_zone(spark, sf, "sales"))
    return present(CL.clean_sales(raw))


def src_promo_csv(spark, sf):
    """SRC_PROMO_CSV: header-carrying pipe files, columns picked by name."""
    raw = FS.read_promo_csv(spark, _raw_zone(spark, sf, "promo"))
    return present(CL.clean_promo(raw))


def src_promo_headers(spark, sf):
    """SRC_PROMO_CSV: files in three column orders, some without the optional
    column, each read by its own header."""
    raw = FS.read_promo_csv(spark, _raw_zone(spark, sf, "promo-layouts"))
    return present(CL.clean_promo(raw))


def src_day_files(spark, sf):
    """SRC_DATE_PRUNE on day files: the window picks its files from the file index;
    no other file is opened."""
    raw = FS.read_sales_days(spark, _raw_zone(spark, sf, "sales-days"), PRUNE_START, PRUNE_END)
    return present(CL.clean_sales(raw))


def src_quarantine(spark, sf):
    """SRC_SALES_CSV: lines that are no records, counted by reason beside the records."""
    return FS.quarantine_report(*FS.split_sales_lines(spark, _raw_zone(spark, sf, "sales-broken")))


def src_quarantine_clean(spark, sf):
    """SRC_SALES_CSV: the records beside the quarantine, cleaned."""
    records, _ = FS.split_sales_lines(spark, _raw_zone(spark, sf, "sales-broken"))
    return present(CL.clean_sales(records))


def src_clean_pipe(spark, sf):
    """SRC_CLEAN on pipe files: the same rows as from Parquet."""
    s = DB.FIXTURE_SCOPE
    path = scratch_path(spark, "clean-pipe")
    FS.write_facts(facts_from_tables(spark, sf, DB.FIXTURE_GRAIN), path, fmt="pipe")
    return present(FS.read_clean(spark, path, s.start, s.end, fmt="pipe"))


def snk_article_store(spark, sf):
    """SNK_ARTICLE by versions: published with the category facts, read by day."""
    return present(_published(spark, sf).read("article", *DAYS_READ))


def snk_category_store(spark, sf):
    """SNK_CATEGORY by versions: the category facts of the same version."""
    return present(_published(spark, sf).read("category", *DAYS_READ))


DAYS_READ = ("1998-01-01", "1998-12-31")


def _published(spark, sf) -> FactStore:
    store = FactStore(spark, scratch_path(spark, "fact-store"))
    store.publish(facts_from_tables(spark, sf, DAILY_STORE_CATEGORY_GRAIN))
    return store


def stream_day_refresh(spark, sf):
    """Q_ARTICLE_GROWTH, incremental from both years' day files: what the refresh
    publishes equals the batch build."""
    from promolens.streaming.refresh import start_refresh
    store = FactStore(spark, scratch_path(spark, "refresh-store"))
    start_refresh(spark, *_raw_zones(spark, sf, "promo-days", "sales-days"), store,
                  grain=DAILY_STORE_CATEGORY_GRAIN, start=DAYS_READ[0], end=DAYS_READ[1]).awaitTermination()
    return present(store.read("article", *DAYS_READ))


def src_date_prune(spark, sf):
    """SRC_DATE_PRUNE: only the month folders and days of the promotion window
    are read from the raw zone (partition pruning), then cleaned."""
    raw = FS.read_sales_csv(spark, _raw_zone(spark, sf, "sales"), PRUNE_START, PRUNE_END)
    return present(CL.clean_sales(raw))


def src_clean(spark, sf):
    """SRC_CLEAN: typed re-read of the written facts, pruned to a window."""
    s = DB.FIXTURE_SCOPE
    return present(read_facts(spark, sf, DB.FIXTURE_GRAIN, s.start, s.end))


def snk_article(spark, sf):
    """SNK_ARTICLE: facts written month-partitioned (dynamic overwrite) and
    read back whole."""
    path = scratch_path(spark, "snk-article")
    FS.write_facts(facts_from_tables(spark, sf, DB.FIXTURE_GRAIN), path)
    return present(FS.read_clean(spark, path))


def snk_category(spark, sf):
    """SNK_CATEGORY: category facts written the same way."""
    path = scratch_path(spark, "snk-category")
    FS.write_facts(category_facts(facts_from_tables(spark, sf, DB.FIXTURE_GRAIN)), path)
    return present(FS.read_clean(spark, path, schema=CATEGORY_FACT_SCHEMA))


def snk_json(spark, sf):
    """SNK_JSON: per-store KPI rows written as JSON records, read back."""
    df = DB.kpi_by_store(DB.scoped(spark, sf))
    path = scratch_path(spark, "snk-json")
    FS.to_json_records(df).write.mode("overwrite").text(path)
    return spark.read.schema(df.schema).json(path)


def src_master(spark, sf):
    """SRC_MASTER: the store master written as a comma file and read back
    with codes as text."""
    path = scratch_path(spark, "master-stores")
    stores(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return FS.read_master(spark, path, ",", "store_code string, initial string, type_store string")


def src_article_list(spark, sf):
    """SRC_ARTICLE_LIST: the uploaded article list read back as text codes."""
    path = scratch_path(spark, "article-list")
    article_list(spark, sf).write.mode("overwrite").option("header", True).csv(path)
    return FS.read_article_list(spark, path)


def src_table(spark, sf):
    """SRC_TABLE: a pruned table scan (two columns of ``part``)."""
    return read_table(spark, sf, "part", ["p_partkey", "p_name"])


JSON_SCHEMA = T.StructType([T.StructField("rajaongkir", T.StructType([T.StructField("results", T.ArrayType(
    T.StructType([T.StructField("city_id", T.LongType()), T.StructField("province_id", T.LongType()),
                  T.StructField("province", T.StringType()), T.StructField("type", T.StringType()),
                  T.StructField("city_name", T.StringType())])))]))])


def _address_docs(spark, sf) -> str:
    """One nested JSON document per customer address lookup, shaped like the
    region/city web service's answer (``rajaongkir.results`` = the customer's
    city with its province), written as JSON lines.  The documents grow with
    the customers; each holds one small array."""
    c = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf, "region", ["r_regionkey", "r_name"])
    city = F.struct(F.col("n_nationkey").cast("bigint").alias("city_id"),
                    F.col("n_regionkey").cast("bigint").alias("province_id"),
                    F.col("r_name").alias("province"), F.lit("Kota").alias("type"),
                    F.col("n_name").alias("city_name"))
    docs = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.to_json(F.struct(F.struct(F.array(city).alias("results")).alias("rajaongkir")))
                    .alias("value")))
    path = scratch_path(spark, "json-nested")
    docs.write.mode("overwrite").text(path)
    return path


def _flatten(spark, sf) -> DataFrame:
    txt = spark.read.text(_address_docs(spark, sf))
    doc = txt.select(F.from_json("value", JSON_SCHEMA).alias("d"))
    return doc.select(F.explode("d.rajaongkir.results").alias("c"))


def src_json_nested(spark, sf):
    """SRC_JSON_NESTED: nested ``rajaongkir.results`` arrays flattened
    (``from_json`` + ``explode``) into the city table, one row per city."""
    return _flatten(spark, sf).select(
        F.col("c.city_id").alias("ro_city_id"), F.col("c.province_id").alias("ro_province_id"),
        F.col("c.type").alias("ro_type"), F.col("c.city_name").alias("ro_city_name")).distinct()


def src_json_provinces(spark, sf):
    """SRC_JSON_NESTED, province part: distinct provinces of the documents."""
    return (_flatten(spark, sf)
            .select(F.col("c.province_id").alias("ro_province_id"), F.col("c.province").alias("ro_province"))
            .distinct())


# --- cleaning predicates: kept / dropped profile over the whole feed ------------------

def _profile(spark, sf, pred) -> DataFrame:
    feed = raw_feed(spark, sf)
    return (feed.select(F.coalesce(pred, F.lit(False)).alias("kept"))
            .groupBy("kept").agg(F.count(F.lit(1)).alias("n")))


def cln_sentinel(spark, sf):
    return _profile(spark, sf, CL.not_sentinel("bdate"))


def cln_not_null(spark, sf):
    return _profile(spark, sf, CL.not_null("bdate", "nama_site", "kode_store"))


def cln_min_len(spark, sf):
    return _profile(spark, sf, CL.min_length("nama_site", 3))


def cln_numeric_code(spark, sf):
    return _profile(spark, sf, CL.not_numeric_code("mercat"))


def cln_numeric_measure(spark, sf):
    return _profile(spark, sf, CL.numeric("qty", "cogs", "netsales", "profit"))


def cln_rejects(spark, sf):
    """The rows that the measures reject, counted by measure and reason."""
    return CL.rejects(raw_feed(spark, sf))


def cln_positive(spark, sf):
    return _profile(spark, sf, CL.positive("qty", "cogs", "netsales", "profit", "tqty", "tamt"))


def cln_inactive(spark, sf):
    return _profile(spark, sf, CL.active_site("nama_site"))


def cln_site_suffix(spark, sf):
    """CLN_SITE_SUFFIX: site name -> last three characters."""
    feed = raw_feed(spark, sf).where(F.col("nama_site").isNotNull())
    return feed.select("nama_site", X.site_suffix("nama_site").alias("site_code")).distinct()


def cln_cast(spark, sf):
    """CLN_CAST: the measures parsed and cast, summed exactly."""
    feed = raw_feed(spark, sf)
    return feed.agg(*[round2(F.sum(measure(X.to_number(c)))).alias(c)
                      for c in ("qty", "cogs", "netsales", "profit", "tqty", "tamt")])


def cln_lower_cols(spark, sf):
    """CLN_LOWER_COLS: upper-case file columns become lower-case names."""
    raw = CL.lower_columns(FS.read_sales_csv(spark, _raw_zone(spark, sf, "sales")))
    return raw.groupBy("merdiv").agg(F.count(F.lit(1)).alias("n"))


# --- dashboard totals without the top-5 cut --------------------------------------------

def agg_by_type(spark, sf):
    """AGG_BY_TYPE: promotion totals per rule code and type."""
    return present(sum_by(DB.scoped(spark, sf), ["rulecode", "ruletype"], ["tnetsales", "netsales_x", "tqty"]))


def agg_by_category(spark, sf):
    """AGG_BY_CATEGORY: promotion totals per category."""
    return present(sum_by(DB.scoped(spark, sf), ["mercat_y", "mercatdesc_y"], ["tnetsales", "netsales_x", "tqty"]))


# --- scalar functions -------------------------------------------------------------------

def fn_substr(spark, sf):
    """FN_SUBSTR: division letter (first character) of each category."""
    p = read_table(spark, sf, "part", ["p_type"])
    return p.select(F.col("p_type").alias("cat"), X.first_letter("p_type").alias("div")).distinct()


def fn_length(spark, sf):
    """FN_LENGTH: site names by length."""
    feed = raw_feed(spark, sf)
    return feed.groupBy(F.length("nama_site").alias("len")).agg(F.count(F.lit(1)).alias("n"))


def fn_isnumeric(spark, sf):
    feed = raw_feed(spark, sf)
    return feed.groupBy(X.is_all_digits("mercat").alias("is_numeric")).agg(F.count(F.lit(1)).alias("n"))


def fn_contains(spark, sf):
    feed = raw_feed(spark, sf)
    return feed.groupBy(F.col("nama_site").contains("NON AKTIF").alias("inactive")).agg(
        F.count(F.lit(1)).alias("n"))


def fn_split(spark, sf):
    """FN_SPLIT: the number after ``#`` of a brand; the date token of a
    daily file name (``_``-separated)."""
    p = read_table(spark, sf, "part", ["p_brand"]).distinct()
    fname = F.concat(F.lit("newclean_article_growth_"), F.col("p_brand"), F.lit(".csv"))
    return p.select("p_brand", F.split("p_brand", "#").getItem(1).alias("brand_no"),
                    F.split(fname, "_").getItem(3).alias("token"))


def fn_replace(spark, sf):
    """FN_REPLACE: rating text with ``.`` replaced for the star widget."""
    from promolens.plans.commerce import q_ratings
    r = q_ratings(spark, sf)
    return r.withColumn("star_rating", F.replace(F.col("total_rating"), F.lit("."), F.lit("_")))


def fn_to_number(spark, sf):
    feed = raw_feed(spark, sf)
    v = X.to_number("qty")
    return feed.groupBy(v.isNotNull().alias("parsed")).agg(
        F.count(F.lit(1)).alias("n"), round2(F.sum(measure(v))).alias("qty"))


def fn_parse_date(spark, sf):
    feed = raw_feed(spark, sf)
    return feed.groupBy(F.year(D.parse_feed_date("bdate")).alias("year")).agg(F.count(F.lit(1)).alias("n"))


def fn_format_date(spark, sf):
    """FN_FORMAT_DATE: day label, month folder, file date and report stamp."""
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    d = F.col("o_orderdate")
    return o.select("o_orderkey", F.date_format(d, D.CHART_DAY).alias("day_label"),
                    F.date_format(d, D.MONTH_FOLDER).alias("yymm"),
                    F.date_format(d, D.FILE_DATE).alias("fday"),
                    F.date_format(d, D.REPORT_TS).alias("stamp"))


def fn_date_range(spark, sf):
    """FN_DATE_RANGE: every day of every promotion (``explode(sequence)``)."""
    p = C.promotions(spark, sf)
    return p.select("id", F.explode(F.sequence("start_date", "end_date")).alias("day"))


def fn_date_shift(spark, sf):
    """FN_DATE_SHIFT: same day last year (NULL on 29 February), 14 days and
    one day earlier, for every business day."""
    l = read_table(spark, sf, "lineitem", ["l_shipdate"])
    d = l.select(F.to_date("l_shipdate").alias("d")).distinct()
    return d.select("d", D.prev_year("d").alias("ly"), F.date_sub("d", 14).alias("pre_start"),
                    F.date_sub("d", 1).alias("pre_end"))


def fn_format_number(spark, sf):
    """FN_FORMAT_NUMBER: KPI figures as text with thousands separators."""
    k = DB.kpi_by_store(DB.scoped(spark, sf))
    return k.select("kode_store", X.money_text("total_netsales_m", 2).alias("netsales_text"),
                    X.money_text("total_qty", 0).alias("qty_text"))


def fn_percent_text(spark, sf):
    """FN_PERCENT_TEXT: growth with two decimals and a percent sign."""
    k = DB.kpi_by_store(DB.scoped(spark, sf))
    return k.select("kode_store", F.concat(F.format_string("%.2f", "sales_growth"), F.lit("%")).alias("growth_text"))


NAMES = [
    "src_sales_csv", "src_promo_csv", "src_date_prune", "src_clean", "snk_article", "snk_category", "snk_json",
    "src_master", "src_article_list", "src_table", "src_json_nested", "src_json_provinces",
    "cln_sentinel", "cln_not_null", "cln_min_len", "cln_numeric_code", "cln_numeric_measure", "cln_rejects", "cln_positive",
    "cln_inactive", "cln_site_suffix", "cln_cast", "cln_lower_cols", "agg_by_type", "agg_by_category",
    "fn_substr", "fn_length", "fn_isnumeric", "fn_contains", "fn_split", "fn_replace", "fn_to_number",
    "fn_parse_date", "fn_format_date", "fn_date_range", "fn_date_shift", "fn_format_number", "fn_percent_text",
    "stream_article_growth", "src_promo_headers", "src_day_files", "src_quarantine", "src_quarantine_clean", "src_clean_pipe",
    "snk_article_store", "snk_category_store", "stream_day_refresh",
]

# Operator IDs whose behaviour is exactly a named query's: same callable.
ALIASES = {
    "flt_eq": "q_report_unpaid", "flt_ne": "q_online_list", "flt_optional": "q_report_sales_pos",
    "flt_hierarchy": "q_promo_scope_directorate", "flt_prefix": "q_categories", "flt_like": "q_catalog_search",
    "flt_range": "q_report_sales", "flt_active_on": "q_redeemable", "flt_null_or": "q_catalog",
    "prj_select": "q_article_growth", "prj_promo_share": "q_clean_promo", "prj_growth": "q_type_growth",
    "prj_margin": "q_article_detail", "prj_unit_avg": "q_daily_during", "prj_traffic_light": "q_kpi_by_store",
    "prj_sign_flag": "q_point_history", "prj_class_price": "q_price_list", "prj_order_net": "q_online_list",
    "prj_pos_discount": "q_pos_order_totals",
    "join_yoy": "q_article_growth_monthly", "join_semi_article": "q_promo_scope",
    "join_semi_store": "q_store_best", "join_semi_division": "q_divisions",
    "join_dim_diffname": "q_article_detail", "join_inner_sql": "q_usable_vouchers",
    "join_multi_sql": "q_order_lines", "join_left_sql": "q_catalog", "join_mixed": "q_pos_order_lines",
    "agg_ly_article": "q_clean_sales", "agg_ty_promo": "q_clean_promo",
    "agg_yoy_article": "q_article_growth_monthly", "agg_yoy_category": "q_category_growth_monthly",
    "agg_global": "q_kpi", "agg_by_store": "q_kpi_by_store", "agg_daily": "q_daily_during",
    "agg_article_detail": "q_article_detail", "agg_distinct": "q_directorates",
    "agg_distinct_on": "q_catalog_categories", "agg_sum_product": "q_order_history",
    "agg_weighted_avg": "q_catalog_cost", "agg_points": "q_points", "agg_rating": "q_ratings",
    "agg_count": "q_customer_counts", "agg_grand_total": "q_report_sales",
    "win_share_type": "q_type_share", "win_share_category": "q_category_share",
    "ord_sort": "q_chain_stores", "ord_best5": "q_store_best", "ord_worst5": "q_store_worst",
    "ord_top_type": "q_type_growth", "ord_top_category": "q_category_growth_top",
    "ord_head_share": "q_type_share", "ord_latest_n": "q_latest_products", "ord_limit": "q_products_of_type",
    "ord_page": "q_customer_page",
    "set_concat": "q_daily_article", "set_sales_types": "q_report_sales",
    "fn_concat": "q_customer_places", "fn_if_zero": "q_daily_during", "fn_round": "q_ratings",
    "fn_millions": "q_kpi",
}

