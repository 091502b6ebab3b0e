
import datetime as dt

from pyspark.sql import functions as F

from promolens.functions import dates as D
from promolens.functions import numeric as N
from promolens.functions import text as X
from promolens.operators import clean as CL
from promolens.operators.scope import PromoScope, hierarchy_filter
from promolens.operators.yoy import Grain, article_facts, article_facts_from_rows


def one(spark, expr, schema="x double", row=(None,)):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_growth_zero_base(spark):
    df = spark.createDataFrame([(0.0, 5.0), (80.0, 100.0)], "old double, new double")
    got = [r.g for r in df.select(N.growth_pct("new", "old").alias("g")).collect()]
    assert got == [0.0, 25.0]


def test_margin_zero_sales(spark):
    df = spark.createDataFrame([(0.0, 7.0), (200.0, 50.0)], "s double, p double")
    assert [r.m for r in df.select(N.margin_pct("p", "s").alias("m")).collect()] == [0.0, 25.0]


def test_traffic_light(spark):
    df = spark.createDataFrame([(1.01,), (1.0,), (0.0,), (-0.01,)], "g double")
    got = [r.c for r in df.select(N.traffic_light("g").alias("c")).collect()]
    assert got == ["bg-green", "bg-yellow", "bg-yellow", "bg-red"]


def test_sign_flag(spark):
    df = spark.createDataFrame([(0,), (-1,), (3,)], "p int")
    bars = [r.c for r in df.select(N.sign_flag("p", zero_is_red=True).alias("c")).collect()]
    points = [r.c for r in df.select(N.sign_flag("p", zero_is_red=False).alias("c")).collect()]
    assert bars == ["red", "red", "green"] and points == ["green", "red", "green"]


def test_promo_part(spark):
    df = spark.createDataFrame([(100.0, 10.0, 4.0)], "n double, q double, t double")
    assert float(df.select(N.promo_share("n", "q", "t").alias("v")).first().v) == 40.0


def test_round_half_up(spark):
    df = spark.createDataFrame([(12.345,), (2.675,), (-12.345,)], "x double")
    assert [r.v for r in df.select(N.round2("x").alias("v")).collect()] == [12.35, 2.68, -12.35]


def test_number_text(spark):
    df = spark.createDataFrame([("12",), ("1e3",), ("abc",), ("",), ("NaN",), ("Infinity",), ("1.0d",),
                                (" 7 ",), (None,)], "s string")
    got = [r.v for r in df.select(X.to_number("s").alias("v")).collect()]
    assert got == [12.0, 1000.0, None, None, None, None, None, 7.0, None]


def test_numeric_code_keeps_null(spark):
    df = spark.createDataFrame([("123",), ("P1",), (None,), ("٣٤",)], "mercat string")
    kept = [r.mercat for r in df.where(CL.not_numeric_code("mercat")).collect()]
    assert kept == ["P1", None]


def test_sentinel_and_length(spark):
    df = spark.createDataFrame([("TRICLE", "ABCDE"), ("SUPREME", "ABCDE"), (None, "ABCDE"),
                                ("01-01-2020", "AB"), ("01-01-2020", "ABC")], "bdate string, nama_site string")
    cond = CL.not_sentinel() & CL.not_null("bdate", "nama_site") & CL.min_length()
    assert [r.nama_site for r in df.where(cond).collect()] == ["ABC"]


def test_na_tokens_become_null(spark):
    df = spark.createDataFrame([("NA",), ("n/a",), ("NULL",), ("SITE",)], "s string")
    assert [r.v for r in df.select(X.na_to_null("s").alias("v")).collect()] == [None, None, None, "SITE"]


def test_leap_day_has_no_last_year(spark):
    df = spark.createDataFrame([(dt.date(2024, 2, 29),), (dt.date(2024, 3, 1),), (dt.date(2023, 2, 28),)], "d date")
    got = [r.v for r in df.select(D.prev_year("d").alias("v")).collect()]
    assert got == [None, dt.date(2023, 3, 1), dt.date(2022, 2, 28)]


def test_pre_window():
    assert D.pre_window("15-03-1998") == (dt.date(1998, 3, 1), dt.date(1998, 3, 14))
    s = PromoScope(start="1998-03-15", end="1998-03-28").before()
    assert (s.start, s.end) == (dt.date(1998, 3, 1), dt.date(1998, 3, 14))


def test_hierarchy(spark):
    dirs = spark.createDataFrame([("P", "FASHION"), ("E", "FASHION"), ("M", "HOME")], "directorate_code string, dirdesc string")
    facts = spark.createDataFrame([("PROMO",), ("ECONOMY",), ("MEDIUM",), ("LARGE",)], "mercat_y string")
    # category all, directorate FASHION, division all -> letters P and E
    _, letters = hierarchy_filter(PromoScope("1998-01-01", "1998-01-02", category="all",
                                             directorate="FASHION", division="all"), dirs)
    got = sorted(r.mercat_y for r in facts.withColumn("_div", F.substring("mercat_y", 1, 1))
                 .join(letters, "_div", "left_semi").collect())
    assert got == ["ECONOMY", "PROMO"]
    # directorate all with a division set -> no filter at all
    pred, letters = hierarchy_filter(PromoScope("1998-01-01", "1998-01-02", directorate="all", division="M"), dirs)
    assert pred is None and letters is None
    # empty form value means all
    pred, letters = hierarchy_filter(PromoScope("1998-01-01", "1998-01-02", category=""), dirs)
    assert pred is None and letters is None


def test_class_price_and_pos_discount_and_order_net(spark):
    df = spark.createDataFrame([(100.0, 10, "S", 5), (100.0, 10, "XXL", 5)], "p double, pct int, size string, fee int")
    assert [r.v for r in df.select(N.class_price("p", "pct", "size", "fee").alias("v")).collect()] == [90.0, 95.0]
    d = spark.createDataFrame([(10, 1, 200.0), (10, 0, 200.0)], "d int, pc int, t double")
    assert [r.v for r in d.select(N.pos_discount("d", "pc", "t").alias("v")).collect()] == [20.0, 10.0]
    o = spark.createDataFrame([(100.0, 20, 5, 10)], "g double, s int, sd int, vd int")
    assert o.select(N.order_net("g", "s", "sd", "vd").alias("v")).first().v == 105.0


def test_footer_truncates_each_row(spark):
    from promolens.plans.commerce import report_sales
    view = spark.createDataFrame(
        [("A", 1, "x", "k", dt.datetime(1998, 1, 5), "POS", "s", 1.9, 0.0, 1.9),
         ("B", 1, "x", "k", dt.datetime(1998, 1, 6), "POS", "s", 1.9, 0.0, 1.9)],
        "code string, customer_id bigint, customer_name string, customer_class_name string, "
        "created_at timestamp, sales_type string, status string, total double, total_cogs double, "
        "total_profit double").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    out = report_sales(view, "1998-01-01", "1998-01-31")
    footer = out.where("row_type = 'total'").first()
    assert footer.total == 2.0


def _feed_rows(spark, rows):
    cols = ["bdate", "nama_site", "kode_store", "merdiv", "merdivdesc", "mercat", "mercatdesc", "sku",
            "sku_desc", "brand", "principle", "qty", "cogs", "netsales", "profit", "tqty", "tamt", "tag",
            "rulecode", "ruletype"]
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))


def _row(day, tag, rule, qty="10", net="100", tqty="4"):
    return (day, "STORE001", "7", "P", "DIV P", "PROMO", "PROMO", "42", "widget", "B1", "B1",
            qty, "50", net, "50", tqty, "5", tag, rule, "TYPE" + rule)


def test_null_tag_drops_and_baseline_repeats(spark):
    ly = _feed_rows(spark, [_row("10-03-1997", "A", "1")])
    ty = _feed_rows(spark, [_row("10-03-1998", "A", "1"), _row("10-03-1998", "R", "2"),
                            _row("10-03-1998", None, "3"),                       # NULL tag: gone
                            _row("29-02-2000", "A", "1")])                       # leap day: no baseline
    facts = article_facts(CL.clean_sales(ly), CL.clean_promo(ty))
    rows = facts.collect()
    assert sorted((r.rulecode, r.tag) for r in rows) == [("1", "A"), ("2", "R")]
    # last year's sales are counted once per rule, as in the source
    assert sum(float(r.netsales_x) for r in rows) == 200.0
    # the one-pass plan gives the same facts
    fast = article_facts_from_rows(CL.clean_sales_rows(ly), CL.clean_promo_rows(ty))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, rows))


def test_month_grain_matches_two_step(spark):
    ly = _feed_rows(spark, [_row("10-03-1997", "A", "1"), _row("11-03-1997", "A", "1", net="300")])
    ty = _feed_rows(spark, [_row("10-03-1998", "A", "1"), _row("20-03-1998", "A", "1")])
    g = Grain(keys=("sku",), period="month")
    a = article_facts(CL.clean_sales(ly), CL.clean_promo(ty), g).collect()
    b = article_facts_from_rows(CL.clean_sales_rows(ly), CL.clean_promo_rows(ty), g).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert len(a) == 1 and float(a[0].netsales_x) == 400.0 and a[0].bdate_y == dt.date(1998, 3, 1)


def test_dedupe_baseline_counts_last_year_once(spark):
    from promolens.operators.yoy import dedupe_baseline
    ly = _feed_rows(spark, [_row("10-03-1997", "A", "1")])
    ty = _feed_rows(spark, [_row("10-03-1998", "A", "1"), _row("10-03-1998", "R", "2")])
    facts = article_facts(CL.clean_sales(ly), CL.clean_promo(ty))
    rows = dedupe_baseline(facts).collect()
    assert len(rows) == 2 and sum(float(r.netsales_x) for r in rows) == 100.0
    assert sum(float(r.netsales_y) for r in rows) == 200.0


def test_ranking_uses_the_exact_growth(spark):
    from promolens.plans.dashboard import growth_top, store_rank
    rows = [("a", "A", "110.001", "100"), ("b", "B", "110.004", "100"), ("c", "C", "105", "100")]
    df = spark.createDataFrame(rows, "kode_store string, nama_site string, n string, o string").selectExpr(
        "kode_store", "nama_site", "CAST(n AS DECIMAL(28,6)) AS tnetsales", "CAST(o AS DECIMAL(28,6)) AS netsales_x")
    best = store_rank(df, n=1).first()
    assert (best.kode_store, best.growth) == ("b", 10.0)
    assert [r.kode_store for r in growth_top(df, ["kode_store"], n=3, ascending=False).collect()] == ["b", "a", "c"]


def test_measures_that_do_not_fit_are_rejected_and_counted(spark):
    from promolens.operators import clean
    from promolens.schemas import PROMO_KEYS, PROMO_POSITIVE
    good = {**{k: "x" for k in PROMO_KEYS}, "bdate": "01-03-1998", "nama_site": "Site A01", **{m: "10" for m in PROMO_POSITIVE}}
    rows = [good, {**good, "sku": "big", "netsales": "1e15"}, {**good, "sku": "tiny", "qty": "1e-300"}, {**good, "sku": "text", "cogs": "n/a"}, {**good, "sku": "minus", "tamt": "-1"}]
    feed = spark.createDataFrame([tuple(r[c] for c in good) for r in rows], ", ".join(f"{c} string" for c in good))
    assert [r.sku for r in clean.clean_promo_rows(feed).collect()] == ["x"]
    assert {r.sku for r in clean.clean_sales_rows(feed).collect()} == {"x", "tiny", "minus"}
    got = {r.measure: (r.not_a_number, r.too_large, r.not_positive) for r in clean.rejects(feed).collect()}
    assert got["netsales"] == (0, 1, 0) and got["cogs"] == (1, 0, 0) and got["tamt"] == (0, 0, 1) and got["tqty"] == (0, 0, 0)


def test_scratch_needs_a_shared_folder_on_a_cluster():
    import pytest

    from promolens.session import checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())
