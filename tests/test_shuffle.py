"""What moves in the fact build and in the raw zones, on rows of the tests' own."""

import datetime as dt
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from promolens.operators.clean import _parsed, clean_promo, clean_promo_rows, clean_sales, clean_sales_rows
from promolens.operators.yoy import (
    DAILY_CATEGORY_GRAIN, DAILY_STORE_CATEGORY_GRAIN, MONTHLY_ARTICLE_GRAIN, REFERENCE_GRAIN, article_facts, article_facts_from_rows,
)
from promolens.plans import operators as OPS
from promolens.plans.common import facts_from_tables
from promolens.sources import files as FS
from promolens.sources.fixtures import raw_feed


@pytest.fixture()
def tables(spark, tmpdir_spark):
    """Lines of the same day of two years and of a leap day, repeated rows, null keys and
    dates, orders that lines lack and lines whose order is missing."""
    base = tmpdir_spark("tables")
    days = [dt.datetime(1997, 3, 15), dt.datetime(1998, 3, 15), dt.datetime(1996, 2, 29), dt.datetime(1996, 3, 15), None]
    lines = [(o, o % 3 + 1, o % 4 + 1, n, 10.0 + o % 5, 40000.0 + o, 0.05, None if o % 11 == 0 else "AR"[o % 2], days[(o + n) % 5])
             for o in range(1, 90) for n in range(1, 4)]
    lines += lines[:30] + [(None, 1, 1, 1, 5.0, 9000.0, 0.1, "A", days[0]), (7, None, 1, 1, 5.0, 9000.0, 0.1, "A", days[0]), (5000, 1, 1, 1, 5.0, 9000.0, 0.1, "A", days[1])]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                          "l_discount double, l_returnflag string, l_shipdate timestamp_ntz").write.parquet(f"{base}/lineitem.parquet")
    orders = [(o, None if o % 13 == 0 else f"{o % 2 + 1}-URGENT") for o in range(1, 100)] + [(3, "1-URGENT"), (None, "2-HIGH")]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{base}/orders.parquet")
    parts = [(1, "red", "Brand#1", "PROMO", 900.0), (2, "blue", "Brand#2", "SMALL", 950.0), (3, None, "Brand#3", "LARGE", 990.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_retailprice double").write.parquet(f"{base}/part.parquet")
    sites = [(1, "Supplier#001"), (2, "Supplier#002"), (3, None), (4, "Supplier#004")]
    spark.createDataFrame(sites, "s_suppkey long, s_name string").write.parquet(f"{base}/supplier.parquet")
    return base


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("grain", [REFERENCE_GRAIN, MONTHLY_ARTICLE_GRAIN, DAILY_CATEGORY_GRAIN])
def test_one_step_facts_equal_two_steps(spark, tables, grain):
    feed = raw_feed(spark, tables)
    want = rows(article_facts(clean_sales(feed), clean_promo(feed), grain))
    assert want and rows(facts_from_tables(spark, tables, grain)) == want


@pytest.mark.parametrize("grain", [REFERENCE_GRAIN, MONTHLY_ARTICLE_GRAIN, DAILY_CATEGORY_GRAIN])
def test_promotion_rows_move_once(spark, tables, tmpdir_spark, grain):
    path = tmpdir_spark("feed")
    raw_feed(spark, tables).write.parquet(path)
    feed = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = article_facts_from_rows(clean_sales_rows(feed), clean_promo_rows(feed), grain)
        plan = facts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) == 2         # one of each year


def test_a_line_makes_its_date_once_a_side(spark, tables):
    plan = facts_from_tables(spark, tables, REFERENCE_GRAIN)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("date_format(") == 2 and plan.count("gettimestamp(") == 2


def test_a_measure_is_parsed_once(spark):
    texts = ["1", " 2.5 ", "1e400", "-1e400", "NaN", "Infinity", "1.0d", "7F", "", "x", None, "-3"]
    feed = spark.createDataFrame([("15-03-1998", t, t) for t in texts], "bdate string, qty string, cogs string")
    parsed = _parsed(feed, ["qty", "cogs"])
    assert [r["_qty"] for r in parsed.collect()] == [1.0, 2.5, *[None] * 9, -3.0]
    kept = parsed.where((F.col("_qty") > 0) & F.col("_cogs").isNotNull())
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_cast(") == 2 and [r["_qty"] for r in kept.collect()] == [1.0, 2.5]


@pytest.mark.parametrize("grain", [REFERENCE_GRAIN, MONTHLY_ARTICLE_GRAIN, DAILY_CATEGORY_GRAIN])
def test_both_years_read_one_join_of_the_feed(spark, tables, grain):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        plan = facts_from_tables(spark, tables, grain)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for key in ("l_orderkey", "o_orderkey", "l_partkey", "p_partkey", "l_suppkey", "s_suppkey"):
        assert len(re.findall(rf"- Exchange hashpartitioning\({key}#", plan)) <= 1, key
    assert "ReusedExchange" in plan and plan.count("FileScan parquet") == 4     # each table once


@pytest.mark.parametrize("few", [10 ** 6, 0])
def test_rows_of_few_baselines_are_grouped_where_they_were_joined(spark, tables, monkeypatch, few):
    monkeypatch.setattr("promolens.plans.common.FEW_BASELINES", few)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts = facts_from_tables(spark, tables, DAILY_CATEGORY_GRAIN)
        plan = facts._jdf.queryExecution().executedPlan().toString()
        got = rows(facts)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # six exchanges of the joins' sides, the baselines' own and, where these are many, that of the promotion rows
    assert len(re.findall(r"- Exchange hashpartitioning", plan)) == (7 if few else 8)
    assert ("BroadcastHashJoin" in plan) == bool(few)
    feed = raw_feed(spark, tables)
    assert got == rows(article_facts(clean_sales(feed), clean_promo(feed), DAILY_CATEGORY_GRAIN))


def test_facts_are_sorted_before_they_move(spark, tables, tmpdir_spark, monkeypatch):
    made = []
    once = FS._once
    monkeypatch.setattr(FS, "_once", lambda df, columns: made.append(once(df, columns)) or made[-1])
    path = tmpdir_spark("facts")
    facts = facts_from_tables(spark, tables, MONTHLY_ARTICLE_GRAIN)
    FS.write_facts(facts, path)
    moved = made[0].hint("rebalance", "yymm", "bdate_y").sortWithinPartitions("yymm", "bdate_y")
    plan = moved._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.find("RebalancePartitions") < plan.rfind("Sort [bdate_y")
    assert rows(FS.read_clean(spark, path).select(*facts.columns)) == rows(facts)


@pytest.mark.parametrize("kind", ["promo", "promo-days", "promo-layouts", "sales", "sales-days"])
def test_zones_hold_the_feed_and_move_it_before_it_is_text(spark, tables, tmpdir_spark, monkeypatch, kind):
    plans = []
    write = FS.write_raw_feed
    monkeypatch.setattr(FS, "write_raw_feed", lambda feed, *a, **k: (plans.append(feed), write(feed, *a, **k)))
    path = tmpdir_spark(kind)
    OPS._write_zone(spark, tables, kind, path)
    for feed in plans:
        plan = feed._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.find(" AS netsales") < plan.find("RebalancePartitions")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").collect()
    assert files and all(r.path.endswith(".csv.gz") for r in files)
    got = FS.read_promo_csv(spark, path) if kind.startswith("promo") else FS.read_sales_csv(spark, path)
    feed = raw_feed(spark, tables)
    names = [c for c in got.columns if c.lower() in feed.columns]
    want = feed.select(*[FS.na_to_null(c.lower()).alias(c) for c in names])
    assert rows(got.select(*names)) == rows(want)
    assert feed.where(F.col("bdate").isNull()).count() > 0


def shuffle_files(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().iterator()
    names = set()
    while found.hasNext():
        names.add(found.next().getName())
    return {n for n in names if n.startswith("shuffle_")}


def test_zones_written_together_read_one_join_and_leave_no_shuffle_files(spark, tables, monkeypatch):
    joins, staged = [], []
    real, drop = OPS.feed_lines, OPS.discard
    monkeypatch.setattr(OPS, "feed_lines", lambda *a: joins.append(a) or real(*a))
    monkeypatch.setattr(OPS, "discard", lambda spark, path: (staged.append(spark.read.parquet(path).count()), drop(spark, path), staged.append(path)))
    before = shuffle_files(spark)
    promo, sales = OPS._raw_zones(spark, tables, "promo", "sales")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:                 # they go in the background
        time.sleep(0.2)
    assert len(joins) == 1 and not shuffle_files(spark) - before
    feed = raw_feed(spark, tables)
    assert staged[0] == feed.count() and not os.path.exists(staged[1].removeprefix("file:"))
    for got in (FS.read_promo_csv(spark, promo), FS.read_sales_csv(spark, sales)):
        names = [c for c in got.columns if c.lower() in feed.columns]
        assert rows(got.select(*names)) == rows(feed.select(*[FS.na_to_null(c.lower()).alias(c) for c in names]))
    assert OPS._raw_zones(spark, tables, "sales", "promo") == [sales, promo] and len(joins) == 1
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_a_first_build_moves_one_year_at_a_time_and_its_rows_once(spark, tables, tmpdir_spark, monkeypatch):
    from promolens.streaming import nightly
    written, out = [], tmpdir_spark("stream")
    write = nightly.write_facts
    monkeypatch.setattr(nightly, "write_facts", lambda facts, path: (written.append(facts), write(facts, path)))
    promo, sales = OPS._raw_zones(spark, tables, "promo", "sales")
    nightly.start_incremental_build(spark, promo, sales, out, grain=OPS.STREAM_GRAIN).awaitTermination()
    years = [sorted({r.bdate_y.year for r in f.select("bdate_y").collect()}) for f in written]
    assert len(years) == 3 and years[0] == [] and years[1:] == [[1997], [1998]]      # 1996 has no year before it
    assert not any("LeftSemi" in f._jdf.queryExecution().optimizedPlan().toString() for f in written)
    feed = raw_feed(spark, tables)
    want = article_facts(clean_sales(feed), clean_promo(feed), OPS.STREAM_GRAIN)
    assert rows(FS.read_clean(spark, out).select(*want.columns)) == rows(want)


def test_day_refresh_reads_one_join_and_equals_the_batch_build(spark, tables, monkeypatch):
    joins = []
    real = OPS.feed_lines
    monkeypatch.setattr(OPS, "feed_lines", lambda *a: joins.append(a) or real(*a))
    got = rows(OPS.stream_day_refresh(spark, tables))
    assert len(joins) == 1
    monkeypatch.undo()
    feed = raw_feed(spark, tables)
    want = article_facts(clean_sales(feed), clean_promo(feed), DAILY_STORE_CATEGORY_GRAIN).where(F.year("bdate_y") == 1998)
    assert got and got == rows(OPS.present(want))
    for days in (True, False):                                                # a folder moves as one number
        plan = FS.by_folder(feed, days)._jdf.queryExecution().optimizedPlan().toString()
        assert "RebalancePartitions [_folder" in plan and not re.search(r"AS (yymm|day)#", plan)


def test_broken_sales_lines_are_written_compressed_in_bounded_files(spark, tables, tmpdir_spark, monkeypatch):
    monkeypatch.setattr(OPS, "LINES_A_FILE", 50)
    path = tmpdir_spark("broken")
    parts = [(101, "red", "Brand#1", "PROMO", 900.0), (103, "blue", "Brand#2", "SMALL", 950.0)]
    base = tmpdir_spark("broken-tables")
    for name in ("lineitem", "orders", "part", "supplier"):
        t = spark.read.parquet(f"{tables}/{name}.parquet")
        if name == "part":
            t = t.unionAll(spark.createDataFrame(parts, t.schema))
        if name == "lineitem":
            t = t.unionAll(t.where("l_orderkey % 4 = 0").withColumn("l_partkey", F.when(F.col("l_linenumber") == 1, 101).otherwise(103).cast("long")))
        t.write.parquet(f"{base}/{name}.parquet")
    OPS._write_zone(spark, base, "sales-broken", path)
    want = OPS._with_broken_lines(raw_feed(spark, base))
    files = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).count().collect()
    assert files and all(r.path.endswith(".gz") and r["count"] <= 50 for r in files)
    assert rows(spark.read.text(path)) == rows(want)
    records, bad = FS.split_sales_lines(spark, path)
    assert {r.reason for r in bad.select("reason").collect()} == {"too few fields", "too many fields"}
    feed = raw_feed(spark, base).where("sku NOT IN ('101', '103')")
    assert records.count() == feed.count() and records.count() + bad.count() == want.count()
    assert rows(clean_sales(records)) == rows(clean_sales(feed))
