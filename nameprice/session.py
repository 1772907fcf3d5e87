"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkContext
from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "nameprice",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session for tests and the bench.

    On a cluster the submitter owns the session; library code only reads it.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or os.environ.get("SPARK_MASTER", f"local[{cpus}]")
    parts = shuffle_partitions or int(os.environ.get("SHUFFLE_PARTITIONS", cpus))
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        # wide (>100-column) projections such as the 201-feature frame skip
        # whole-stage codegen at the default maxFields; raising it makes the
        # generated processNext() exceed the JVM's 64 KB method limit
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    `spark.checkpoint.dir` is read from the session; only when it is unset
    (local tests) a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local_dir = tempfile.mkdtemp(prefix="nameprice-ckpt-")
    sc.setCheckpointDir(local_dir)
    return sc.getCheckpointDir() or local_dir


def checkpoint(df, eager: bool = True):
    """Reliable checkpoint into the shared folder (never localCheckpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def share_package() -> None:
    """Let Python workers import this package from where the driver has it.

    Enough in local mode and where machines share an installation; elsewhere the
    submitter ships the package (`--py-files`).
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = SparkContext.getOrCreate().environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
