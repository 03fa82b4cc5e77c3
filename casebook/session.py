"""Local session for tests, the bench and the cross-check."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def session(name: str = "tallyhouse") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_own_shared_folder_if_unset(spark)
    return spark


def use_own_shared_folder_if_unset(spark: SparkSession) -> None:
    """A cluster names its shared folder in spark.checkpoint.dir. Only a local session, whose tasks share one disk, may
    get its own."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyhouse-"))
