"""Daily series, file and header index, quarantine, versioned facts, two-sided refresh."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from promolens.operators.daily import daily_series
from promolens.operators.scope import PromoScope
from promolens.operators.yoy import Grain
from promolens.schemas import ARTICLE_FACT_SCHEMA, RAW_PROMO_USED, RAW_SALES_COLUMNS
from promolens.sources import files as FS
from promolens.sources.fact_store import FactStore
from promolens.sources.file_index import file_index, paths_of, pick
from promolens.sources.headers import header_index, layouts, read_by_header

GRAIN = Grain(keys=("kode_store", "nama_site", "sku"), period="day")


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


# --- daily series -------------------------------------------------------------------

def facts(spark, rows):
    df = spark.createDataFrame(rows, "bdate_y date, sku string, tqty double, tcogs double, tnetsales double, tprofit double")
    return df.select("bdate_y", "sku", *[F.col(m).cast("decimal(28,6)").alias(m) for m in ("tqty", "tcogs", "tnetsales", "tprofit")])


def test_every_day_of_both_windows_is_there(spark):
    df = facts(spark, [(dt.date(1998, 3, 15), "a", 4.0, 8.0, 20.0, 5.0), (dt.date(1998, 3, 1), "a", 2.0, 2.0, 4.0, 1.0),
                       (dt.date(1998, 2, 28), "a", 9.0, 9.0, 9.0, 9.0), (dt.date(1998, 3, 29), "a", 9.0, 9.0, 9.0, 9.0)])
    rows = daily_series(df, PromoScope("1998-03-15", "1998-03-28")).collect()
    assert len(rows) == 28 and len({(r.series, r.bdate_y) for r in rows}) == 28
    sold = {(r.series, r.day_label): (r.tqty, r.avg_tcogs, r.avg_tnetsales, r.total_margin) for r in rows if r.has_sales}
    assert sold == {("during", "15/03"): (4.0, 2.0, 5.0, 25.0), ("before", "01/03"): (2.0, 1.0, 2.0, 25.0)}
    assert all((r.tqty, r.avg_tcogs, r.total_margin) == (0.0, 0.0, 0.0) for r in rows if not r.has_sales)


def test_a_scope_without_sales_still_has_its_days(spark):
    assert daily_series(facts(spark, []), PromoScope("1998-03-15", "1998-03-16")).where("NOT has_sales").count() == 2 + 14


def test_series_of_each_article_and_overlapping_windows(spark):
    df = facts(spark, [(dt.date(1998, 3, 2), "a", 1.0, 1.0, 1.0, 1.0), (dt.date(1998, 3, 3), "b", 1.0, 1.0, 1.0, 0.5), (dt.date(1999, 1, 1), "c", 1.0, 1.0, 1.0, 1.0)])
    scope = PromoScope("1998-03-02", "1998-03-03", pre_start="1998-03-01", pre_end="1998-03-02")
    rows = daily_series(df, scope, ["sku"], margin_scale=1.0).collect()
    assert len(rows) == 2 * 4 and {r.sku for r in rows} == {"a", "b"}
    assert {(r.sku, r.series, r.bdate_y.day) for r in rows if r.has_sales} == {("a", "during", 2), ("a", "before", 2), ("b", "during", 3)}
    assert [r.total_margin for r in rows if r.sku == "b" and r.has_sales] == [0.5]


def test_daily_series_scans_the_days_of_both_windows_only(spark, tmpdir_spark):
    from promolens.operators.daily import in_either_window
    path = tmpdir_spark("day-facts")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ARTICLE_FACT_SCHEMA.fields)
    row = {f.name: None for f in ARTICLE_FACT_SCHEMA.fields}
    rows = [tuple({**row, "bdate_y": dt.date(1998, 1, 1) + dt.timedelta(days=i)}.values()) for i in range(200)]
    FS.write_facts(spark.createDataFrame(rows, schema), path)
    scope = PromoScope("1998-03-15", "1998-03-28")
    df = FS.read_clean(spark, path, "1998-03-01", "1998-03-28").where(in_either_window("bdate_y", scope))
    assert df.count() == 28
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bdate_y" in plan.split("PartitionFilters:")[1].split("]")[0]


# --- file index -----------------------------------------------------------------------

def day_zone(base):
    for name in ("9803/promo_19980314_a.txt", "9803/promo_19980315_a.txt", "9803/promo_19980315_b.txt", "9803/short.txt", "9803/promo_x.txt",
                 "9803/promo_19980401_wrong-month.txt", "9805/promo_19980501.txt", "9803/promo_1998.txt"):
        put(f"{base}/{name}", "sku|qty\n" + name + "|1\n")


def test_index_lists_days_and_passes_over_odd_names(spark, tmpdir_spark):
    base = tmpdir_spark("zone")
    day_zone(base)
    rows = {r.name: (r.month, r.day, r.size) for r in file_index(spark, base, 1).collect()}
    assert len(rows) == 8
    assert rows["promo_19980315_b.txt"] == ("9803", dt.date(1998, 3, 15), len("sku|qty\n9803/promo_19980315_b.txt|1\n"))
    assert {n for n, (_, d, _) in rows.items() if d is None} == {"short.txt", "promo_x.txt", "promo_1998.txt"}
    assert file_index(spark, base + "-none", 1).count() == 0


def test_a_window_opens_only_its_files(spark, tmpdir_spark):
    base = tmpdir_spark("zone")
    day_zone(base)
    # March to May: April has no folder, the file of 1 April lies in another month
    picked = paths_of(pick(file_index(spark, base, 1), "1998-03-15", "1998-05-31"))
    assert [p.split("/")[-1] for p in picked] == ["promo_19980315_a.txt", "promo_19980315_b.txt", "promo_19980501.txt"]
    df = FS.read_legacy_day_files(spark, base, "1998-03-15", "1998-05-31", token=1, header=True)
    assert sorted(f.split("/")[-1] for f in df.inputFiles()) == [p.split("/")[-1] for p in picked]
    assert df.count() == 3
    assert FS.read_legacy_day_files(spark, base, "1999-01-01", "1999-01-31", token=1, header=True).count() == 0


# --- headers --------------------------------------------------------------------------

def test_mixed_column_orders_and_a_missing_optional_column(spark, tmpdir_spark):
    base = tmpdir_spark("headers")
    put(f"{base}/a.txt", "sku|qty|tag\n1|10|x\n2|20|\n")
    put(f"{base}/b.txt", "﻿TAG| Qty |extra|sku\ny|30|z|3\n")
    put(f"{base}/c.txt", "qty|sku\n40|4\n")
    put(f"{base}/d.txt", "sku|qty|tag\n5|50|w\n")
    put(f"{base}/e.txt", "sku|qty|sku\n6|60|six\n")
    index = file_index(spark, base, 0)
    df = read_by_header(spark, paths_of(index), ["sku", "qty", "tag"], ["sku", "qty"])
    assert sorted(tuple(r) for r in df.collect()) == [("1", "10", "x"), ("2", "20", None), ("3", "30", "y"), ("4", "40", None), ("5", "50", "w"), ("6", "60", None)]
    heads = header_index(spark, paths_of(index), ["sku", "qty"])
    assert sorted(len(p) for _, p in layouts(heads)) == [1, 1, 1, 2]           # one scan a layout


def test_a_file_without_a_header_is_an_error(spark, tmpdir_spark):
    base = tmpdir_spark("headers")
    put(f"{base}/a.txt", "1|2\n3|4\n")
    with pytest.raises(ValueError, match="no header"):
        read_by_header(spark, paths_of(file_index(spark, base, 0)), ["sku"], ["sku"])
    assert read_by_header(spark, [], ["sku"], ["sku"]).collect() == []


def test_a_kept_index_reads_new_files_only(spark, tmpdir_spark):
    base = tmpdir_spark("headers")
    put(f"{base}/a.txt", "sku|qty\n1|2\n")
    known = spark.createDataFrame(header_index(spark, paths_of(file_index(spark, base, 0)), ["sku"]).collect(),
                                  "path string, size long, modified timestamp, header array<string>")
    kept = known.withColumn("header", F.array(F.lit("kept"), F.lit("sku")))
    put(f"{base}/b.txt", "qty|sku\n1|2\n")
    rows = {r.path.split("/")[-1]: r.header for r in header_index(spark, paths_of(file_index(spark, base, 0)), ["sku"], known=kept).collect()}
    assert rows == {"a.txt": ["kept", "sku"], "b.txt": ["qty", "sku"]}


# --- quarantine -----------------------------------------------------------------------

def test_every_line_is_a_record_or_in_quarantine(spark, tmpdir_spark):
    base = tmpdir_spark("lines")
    good = "|".join(f"v{i}" for i in range(len(RAW_SALES_COLUMNS)))
    quoted = "|".join(['"a|b"', *(f"v{i}" for i in range(1, len(RAW_SALES_COLUMNS)))])
    put(f"{base}/x.txt", f"{good}\n{good}|more\nonly|three|fields\n{quoted}\n\n")
    put(f"{base}/y.txt", f"{good}\nbroken\n")
    records, bad = FS.split_sales_lines(spark, base)
    assert records.count() == 3
    assert sorted((r.file.split("/")[-1], r.line, r.reason) for r in bad.collect()) == [
        ("x.txt", "only|three|fields", "too few fields"), ("x.txt", f"{good}|more", "too many fields"), ("y.txt", "broken", "too few fields")]
    report = {r.outcome: r.lines for r in FS.quarantine_report(records, bad).collect()}
    assert report == {"record": 3, "too many fields": 1, "too few fields": 2} and sum(report.values()) == 6


# --- versions and refresh ---------------------------------------------------------------

DAY, OTHER = dt.date(1998, 3, 10), dt.date(1998, 3, 11)
FEED = {"nama_site": "STORE001", "kode_store": "7", "merdiv": "P", "merdivdesc": "DIV P", "mercat": "PROMO", "mercatdesc": "PROMO",
        "sku_desc": "widget", "brand": "B1", "principle": "B1", "rulecode": "1", "ruletype": "T", "member": "1", "qty": "10", "cogs": "50",
        "netsales": "100", "profit": "50", "tqty": "4", "tamt": "5", "tag": "A"}


def promo_file(base, day, skus, order=None, suffix=""):
    order = order or RAW_PROMO_USED
    lines = ["|".join(order)] + ["|".join({**FEED, "bdate": day.strftime("%d-%m-%Y"), "sku": s}[c] for c in order) for s in skus]
    put(f"{base}/{day:%y%m}/promo_{day:%Y%m%d}{suffix}.txt", "\n".join(lines) + "\n")


def sales_file(base, day, skus, net="80"):
    rows = [{**FEED, "bdate": day.strftime("%d-%m-%Y"), "sku": s, "netsales": net} for s in skus]
    put(f"{base}/{day:%y%m}/all_sales_{day:%Y%m%d}.txt", "\n".join("|".join(r.get(c.lower(), "") for c in RAW_SALES_COLUMNS) for r in rows) + "\n")


def content(store, kind="article"):
    key = "sku" if kind == "article" else "mercat_y"
    return sorted((r.bdate_y, r[key], float(r.netsales_x), float(r.tqty)) for r in store.read(kind).collect())


@pytest.fixture()
def zones(tmpdir_spark):
    promo, sales = tmpdir_spark("promo"), tmpdir_spark("sales")
    promo_file(promo, DAY, ["1", "2"])
    promo_file(promo, DAY, ["3"], order=list(reversed(RAW_PROMO_USED)), suffix="_2")
    promo_file(promo, OTHER, ["1"])
    put(f"{promo}/9803/readme.txt", "no day in this name\n")
    for day in (DAY, OTHER):
        sales_file(sales, day.replace(year=1997), ["1", "2", "3"])
    return promo, sales


def test_refresh_builds_changes_and_empties_exactly_their_days(spark, tmpdir_spark, zones):
    from promolens.streaming.refresh import refresh
    promo, sales = zones
    store = FactStore(spark, tmpdir_spark("store"))
    assert refresh(spark, promo, sales, store, GRAIN) == [DAY, OTHER]
    assert content(store) == [(DAY, "1", 80.0, 4.0), (DAY, "2", 80.0, 4.0), (DAY, "3", 80.0, 4.0), (OTHER, "1", 80.0, 4.0)]
    assert content(store, "category") == [(DAY, "PROMO", 240.0, 12.0), (OTHER, "PROMO", 80.0, 4.0)]
    first = {r.bdate_y: r.live for r in store.days().collect()}

    # nothing changed: nothing is published
    before = store.current()
    assert refresh(spark, promo, sales, store, GRAIN) == [] and store.current() == before

    # a changed file of last year rebuilds its day only
    sales_file(sales, OTHER.replace(year=1997), ["1", "2", "3"], net="1000")
    assert refresh(spark, promo, sales, store, GRAIN) == [OTHER]
    assert content(store)[-1] == (OTHER, "1", 1000.0, 4.0)
    second = {r.bdate_y: r.live for r in store.days().collect()}
    assert second[DAY] == first[DAY] and second[OTHER] != first[OTHER]

    # a day whose new rows all fail cleaning disappears, as does one whose files are gone
    put(f"{promo}/{OTHER:%y%m}/promo_{OTHER:%Y%m%d}.txt", "|".join(RAW_PROMO_USED) + "\n")
    assert refresh(spark, promo, sales, store, GRAIN) == [OTHER]
    assert {d for d, *_ in content(store)} == {DAY} and {d for d, *_ in content(store, "category")} == {DAY}
    for name in ("", "_2"):
        os.remove(f"{promo}/{DAY:%y%m}/promo_{DAY:%Y%m%d}{name}.txt")
    assert refresh(spark, promo, sales, store, GRAIN) == [DAY]
    assert content(store) == []


def test_a_failure_between_the_writes_leaves_the_old_version(spark, tmpdir_spark, zones, monkeypatch):
    from promolens.streaming.refresh import refresh
    promo, sales = zones
    store = FactStore(spark, tmpdir_spark("store"))
    refresh(spark, promo, sales, store, GRAIN)
    old = content(store), content(store, "category"), store.current()
    promo_file(promo, DAY, ["1"])

    real = FactStore._write

    def fails(self, df, kind, name):
        if kind == "category":
            raise RuntimeError("lost")
        real(self, df, kind, name)

    for broken in ("_write", "_point"):
        with monkeypatch.context() as m:
            m.setattr(FactStore, broken, fails if broken == "_write" else lambda self, v: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError, match="lost"):
                refresh(spark, promo, sales, store, GRAIN)
        assert (content(store), content(store, "category"), store.current()) == old
    # the repeated run finds the same difference
    assert refresh(spark, promo, sales, store, GRAIN) == [DAY]
    assert [s for d, s, *_ in content(store) if d == DAY] == ["1", "3"]


def test_a_reader_keeps_its_version(spark, tmpdir_spark, zones):
    from promolens.streaming.refresh import refresh
    promo, sales = zones
    store = FactStore(spark, tmpdir_spark("store"))
    refresh(spark, promo, sales, store, GRAIN)
    mine = store.read("article", DAY, DAY)
    n, version = mine.count(), store.current()
    promo_file(promo, DAY, ["1"])
    refresh(spark, promo, sales, store, GRAIN)
    assert mine.count() == n == store.read("article", DAY, DAY, version).count()
    assert store.read("article", DAY, DAY).count() == 2
    assert store.read("article", "1990-01-01", "1990-12-31").count() == 0


def test_the_stream_watches_both_zones(spark, tmpdir_spark, zones):
    from promolens.streaming.refresh import start_refresh
    promo, sales = zones
    store, ckpt = FactStore(spark, tmpdir_spark("store")), tmpdir_spark("ckpt")
    start_refresh(spark, promo, sales, store, ckpt, GRAIN).awaitTermination()
    assert len(content(store)) == 4
    sales_file(sales, dt.date(1997, 3, 12), ["9"])
    promo_file(promo, dt.date(1998, 3, 12), ["9"])
    start_refresh(spark, promo, sales, store, ckpt, GRAIN).awaitTermination()
    assert (dt.date(1998, 3, 12), "9", 80.0, 4.0) in content(store) and len(content(store)) == 5


def test_leap_day_files_affect_no_other_day(spark):
    from promolens.streaming.refresh import affected_days
    schema = "zone string, path string, size long, modified timestamp, day date"
    now = dt.datetime(2024, 1, 1)
    files = spark.createDataFrame([("sales", "a", 1, now, dt.date(2024, 2, 29)), ("sales", "b", 1, now, dt.date(2024, 2, 28)),
                                   ("promo", "c", 1, now, dt.date(2024, 2, 29)), ("promo", "d", 1, now, None)], schema)
    assert affected_days(files, spark.createDataFrame([], schema)) == [dt.date(2024, 2, 29), dt.date(2025, 2, 28)]


def test_pipe_files_hold_the_same_facts(spark, tmpdir_spark):
    from conftest import SMALL
    from promolens.plans import dashboard
    from promolens.plans.common import facts_from_tables
    facts = facts_from_tables(spark, SMALL, dashboard.FIXTURE_GRAIN)
    a, b = tmpdir_spark("parquet"), tmpdir_spark("pipe")
    FS.write_facts(facts, a)
    FS.write_facts(facts, b, fmt="pipe")
    want, got = FS.read_clean(spark, a, "1998-01-01", "1998-12-31"), FS.read_clean(spark, b, "1998-01-01", "1998-12-31", fmt="pipe")
    assert want.schema == got.schema and want.count() > 0
    assert sorted(map(str, want.collect())) == sorted(map(str, got.collect()))
