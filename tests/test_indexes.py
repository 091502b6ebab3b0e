"""Bucketed tables, trigram index, page directory, run-time filter of the fact scan."""

import random
import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from promolens.operators import pages, trigrams
from promolens.plans import commerce


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- bucketed tables --------------------------------------------------------------------

@pytest.mark.parametrize("name", ["q_order_lines", "q_order_totals"])
def test_bucketed_orders_join_without_a_shuffle(spark, name):
    plain, bucketed = getattr(commerce, name)(spark, SMALL), getattr(commerce, name + "_bucketed")(spark, SMALL)
    plan = plan_of(bucketed)
    assert "hashpartitioning" not in plan.split("Initial Plan")[0] and "Bucketed: true" in plan
    assert sorted(map(str, plain.collect())) == sorted(map(str, bucketed.select(*plain.columns).collect()))


def test_bucketed_tables_hold_one_sorted_file_a_bucket(spark):
    from promolens.sources.buckets import save_bucketed
    name = save_bucketed(spark.range(1000).withColumnRenamed("id", "k"), "k", 4)
    files = spark.table(name).inputFiles()
    assert len(files) == 4
    for f in files:
        keys = [r.k for r in spark.read.parquet(f).collect()]
        assert keys == sorted(keys)


# --- trigrams -----------------------------------------------------------------------------

def test_search_equals_the_scan_for_every_term(spark):
    r = random.Random(3)
    words = ["spring", "ring", "Ring", "rings", "ri", "", "blue rain", "ra_in", "100%", "äöü", "aaa", "aaaa", None]
    names = [None if (w := r.choice(words)) is None else w + " " + (r.choice(words) or "") for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    index = trigrams.build(df, "name", "id")
    terms = {n[i:i + k] for n in names[:40] if n for k in (1, 2, 3, 4, 7) for i in range(0, max(1, len(n) - k), 3)} | {"zzz", "ring xyz", "%", "", "aaaaa"}
    for term in sorted(terms)[:40]:
        got = sorted(x.id for x in trigrams.search(df, index, term, "name", "id").collect())
        assert got == [i for i, n in enumerate(names) if n is not None and term in n], term


def test_candidates_are_those_of_the_rarest_trigram(spark):
    df = spark.createDataFrame([(1, "abcd"), (2, "abcx"), (3, "bcd"), (4, "ab")], "id long, name string")
    index = trigrams.build(df, "name", "id")
    assert index.rarest("abcd") == ("abc", 2) and index.rarest("abcq") == ("bcq", 0) and index.rarest("ab") is None
    assert sorted(r.id for r in index.candidates("abcd").collect()) == [1, 2]
    assert index.postings.count() == 2 + 2 + 1                       # one a different trigram of a text
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,abc)]" in plan_of(index.candidates("abcd"))


def test_index_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, name string")
    assert trigrams.search(df, trigrams.build(df, "name", "id"), "abc", "name", "id").collect() == []


# --- pages ----------------------------------------------------------------------------------

@pytest.mark.parametrize("ascending", [True, False])
def test_all_pages_together_are_the_full_sort(spark, ascending):
    r = random.Random(5)
    rows = [(i, r.choice(["a", "b", "b", "b", "c", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, code string")
    directory = pages.build(df, ["code", "id"], ascending, ranges=7)
    assert directory.count() == 500
    got = [tuple(x) for p in range(0, 510, 37) for x in directory.page(p, 37).collect()]
    order = [F.col("code").asc_nulls_first() if ascending else F.col("code").desc_nulls_last(), F.col("id")]
    assert got == [tuple(x) for x in df.orderBy(*order).collect()]
    assert directory.page(500, 10).collect() == [] and directory.page(10_000, 10).collect() == []


def test_a_late_page_reads_one_or_two_ranges(spark):
    directory = pages.build(spark.range(10_000).withColumn("code", F.col("id") % 1000), ["code", "id"], ranges=20)
    late = directory.page(9_000, 20)
    assert 1 <= len(directory.parts_of(9_000, 20)) <= 2
    assert len({re.search(r"_part=(\d+)", f)[1] for f in late.inputFiles()}) >= 1
    assert [x.code for x in late.collect()] == [900] * 10 + [901] * 10
    assert "PartitionFilters: [" in plan_of(late) and "_part" in plan_of(late).split("PartitionFilters:")[1].split("]")[0]


def test_pages_of_an_empty_table(spark):
    assert pages.build(spark.createDataFrame([], "id long, code string"), ["code", "id"]).page(0, 10).collect() == []


# --- run-time filter ------------------------------------------------------------------------

def test_long_article_lists_filter_the_fact_scan_at_run_time(spark):
    """Beyond the broadcast bound the facts are filtered by a Bloom filter of the list
    before they are shuffled."""
    from promolens.operators.scope import PromoScope, apply_scope
    from promolens.session import scratch_path
    path = scratch_path(spark, "bloom")
    spark.range(20_000).selectExpr("CAST(id AS STRING) AS sku", "DATE'1998-01-05' AS bdate_y", "'1' AS kode_store", "'P1' AS mercat_y").write.parquet(path)
    plus = scratch_path(spark, "plus")
    spark.range(0, 20_000, 500).selectExpr("CAST(id AS STRING) AS plu").write.parquet(plus)
    dirs = spark.createDataFrame([("P", "X")], "directorate_code string, dirdesc string")
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = apply_scope(spark.read.parquet(path), PromoScope("1998-01-01", "1998-01-31"), spark.read.parquet(plus), None, dirs)
        assert "might_contain" in plan_of(df)
        assert df.count() == 40
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
