"""Benchmark of the headline queries.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8); each query gets one warm-up and three
timed runs into a ``noop`` sink (the whole plan executes, nothing is
collected).  Prints ONE JSON line: the sum of per-query medians and the
medians themselves.

``nightly_facts`` is the nightly build (raw feed -> clean -> year-over-year
facts, month grain) written to the shared folder; the dashboard queries then
read that fact table with partition pruning, as a deployment does.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    from promolens.plans import commerce, dashboard, nightly
    from promolens.plans.common import facts_from_tables, facts_table
    from promolens.session import local_session, scratch_path
    from promolens.sources.files import write_facts

    spark = local_session(cores=CPUS, shuffle_partitions=max(8, int(CPUS) * 2), app="promolens-bench")

    def nightly_facts():
        # the nightly build: compute and write the month-partitioned fact table
        write_facts(facts_from_tables(spark, SF_DIR, dashboard.FIXTURE_GRAIN), scratch_path(spark, "bench-facts"))

    def noop(fn):
        return lambda: fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()

    headline = {
        "nightly_facts": nightly_facts,
        "q_article_growth": noop(nightly.q_article_growth),
        "q_kpi": noop(dashboard.q_kpi),
        "q_daily_during": noop(dashboard.q_daily_during),
        "q_store_best": noop(dashboard.q_store_best),
        "q_article_detail": noop(dashboard.q_article_detail),
        "q_report_sales": noop(commerce.q_report_sales),
        "q_catalog_cost": noop(commerce.q_catalog_cost),
    }
    # the dashboard reads the fact table of the nightly build: build it once
    facts_table(spark, SF_DIR, dashboard.FIXTURE_GRAIN)

    medians: dict[str, float] = {}
    for name, run in headline.items():
        run()                                   # warm-up
        times = []
        for _ in range(RUNS):
            t0 = time.perf_counter()
            run()
            times.append(time.perf_counter() - t0)
        medians[name] = round(statistics.median(times), 3)
    spark.stop()
    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(medians.values()), 3),
                      "unit": "sec", "queries": medians, "sf": sf, "cpus": int(CPUS), "runs": RUNS}))


if __name__ == "__main__":
    main()
