"""SparkSession helpers.

The library never creates a session behind the caller's back; ``local_session``
is for tests, benches and examples.  ``checkpoint_dir`` reads the cluster's
shared ``spark.checkpoint.dir`` and only invents a scratch folder when the
setting is absent (local runs).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings a cluster deployment is expected to carry as well; they are what the
# plans in this package are tuned for.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # partition-overwrite of a day never wipes the rest of the fact table
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# JVM flag for driver and executors: whole-stage generated methods of wide
# cleaning projections exceed HotSpot's 8 KB JIT limit and would otherwise run
# interpreted (Spark logs "Generated method too long to be JIT compiled").
JIT_HUGE_METHODS = "-XX:-DontCompileHugeMethods"


def cluster_conf(executor_cores_total: int, target_partition_mb: int = 256) -> dict[str, str]:
    """Settings for a large cluster (e.g. 1000 executors over ~100 TB).

    Shuffle partitions start high and AQE coalesces them to the advisory size,
    so a stage fits executor memory at any scale; skewed partitions above
    ``skewedPartitionThresholdInBytes`` are split.  Scan splits are sized so
    one task reads about one row group stripe set.  Joins stay sort-merge
    unless a side *measures* under the broadcast threshold at run time.
    """
    return {
        **RECOMMENDED_CONF,
        "spark.sql.shuffle.partitions": str(max(2000, executor_cores_total * 3)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{target_partition_mb * 2}m",
        "spark.sql.files.maxPartitionBytes": "512m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.driver.extraJavaOptions": JIT_HUGE_METHODS,
        "spark.executor.extraJavaOptions": JIT_HUGE_METHODS,
    }


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "promolens") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", JIT_HUGE_METHODS)
        .config("spark.executor.extraJavaOptions", JIT_HUGE_METHODS)
        # local runs only: a cluster names its own shared folder
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="promolens-ckpt-"))
    )
    for k, v in RECOMMENDED_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def session_key(spark: SparkSession) -> str:
    """Identity of the running application (memo key for per-session tables)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect has no SparkContext
        return spark.conf.get("spark.app.id", None) or str(id(spark))


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster ``spark.checkpoint.dir`` names a folder every executor can
    reach; use it.  Only where it is unset and Spark runs in one machine
    (``local[...]``: tests, local runs) a scratch folder is made and registered;
    on a cluster every executor would write to a disk of its own, so that is
    an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server names the folder
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    if sc is None or not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="promolens-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Writes started inside drop their shuffle files when they end.  Otherwise these stay
    on the executors' disks until the driver happens to collect its garbage, on top of
    all that the next jobs write.  For frames that are executed once.

    The setting is the session's (restored after; an older Spark does not know it and
    keeps the files as before)."""
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table of ``scratch_path`` that nothing reads any more (left
    to the owner of the folder where Spark's file system cannot be reached)."""
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
