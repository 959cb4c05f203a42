"""Session helpers: configuration the engine relies on and where it may cut lineage."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "rowan", master: str | None = None, cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC timestamps; on a cluster its own settings win."""
    builder = SparkSession.builder.appName(app)
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or f"local[{cpus or '*'}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(cpus or 8),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: spark.checkpoint.dir if the cluster names one.

    Only a local session without the setting gets a temporary folder of its own;
    a cluster without one is an error, since a machine-local folder would be lost with its executor.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    have = sc._jsc.sc().getCheckpointDir()
    local = sc.master.startswith("local[") or sc.master == "local"
    if have.isDefined() and (named is None or named.split(":")[-1].rstrip("/") in have.get()):
        return have.get()
    if named is None:
        if not local:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rowan-checkpoint-")
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint of df in the shared folder; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def spread(df: DataFrame) -> DataFrame:
    """A scan that fills at most half of the cluster's cores, over all of them; others as they are. The rows are the same, only where they are read differs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
