"""Session settings shared by tests, bench and applications."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, app: str = "quire", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster, use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("QUIRE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names; `fallback` is only for sessions without one."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if not named:
        if fallback is None:
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        named = fallback
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run, below the shared folder the cluster names. Only a local session, whose
    tasks all run on one machine, may do without and uses its warehouse folder."""
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder every executor can reach")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(base, f"quire-{name}-{uuid.uuid4().hex}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy row work enough tasks when the scan has fewer splits than there are cores.

    A large table already arrives in more splits than cores, and is then left alone: no shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def parts(spark: SparkSession, rows: int, each: int) -> int:
    """Partitions for a shuffle asked for by number: about `each` rows in one, and no fewer than the session's own.

    Spark joins small partitions of its own shuffles up to 64 MB of compressed rows, which can be a gigabyte in a sort
    or hash table and leaves a task's memory growing with the table. It keeps a number that was asked for, also for
    the shuffles that meet such a one in a join.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def settle(df: DataFrame) -> DataFrame:
    """Keep costly rows that are read twice in the shared checkpoint folder, if the session names one."""
    if not df.sparkSession.conf.get(CHECKPOINT_KEY, None):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
