"""Bucketed catalog tables of the shop (SRC_TABLE).

Order headers and order lines are written once, bucketed and sorted by the order key, as
tables of the session's catalog.  Joins of headers with their lines and sums of an
order's lines then read matching buckets side by side: no exchange, however many
queries run on them.  Rows are dealt to buckets before the write, so every bucket is
one sorted file.

``BUCKETS`` fixes the parallelism of such a join; a deployment chooses it so that a
bucket fits a task (100 TB of lines in 256 MB files: about 400,000).
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from promolens.plans.common import inputs_version
from promolens.session import scratch_path, session_key
from promolens.sources import commerce as C

BUCKETS = 16
ORDER_TABLES = ("orders", "lineitem", "customer", "nation", "part")

_TABLES: dict[tuple, tuple[str, str]] = {}
_LOCK = threading.Lock()


def save_bucketed(df: DataFrame, key: str, buckets: int = BUCKETS, name: str | None = None) -> str:
    """Write ``df`` bucketed and sorted by ``key`` and register it; returns its name."""
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", scratch_path(spark, name)).saveAsTable(name))
    return name


def order_tables(spark: SparkSession, sf_dir: str, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(headers by id, lines by online_sales_id) of the online orders, written once for
    each version of the input files."""
    version = inputs_version(spark, sf_dir, ORDER_TABLES)
    key = (session_key(spark), version, buckets)
    with _LOCK:
        if version is None or key not in _TABLES:
            _TABLES[key] = (save_bucketed(C.online_sales(spark, sf_dir), "id", buckets),
                            save_bucketed(C.online_sales_details(spark, sf_dir), "online_sales_id", buckets))
        return tuple(spark.table(t) for t in _TABLES[key])
