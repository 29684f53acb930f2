"""Session settings shared by the tests, the bench and ad-hoc use.

On a cluster the session is created by the submitter; nothing in the package
requires these settings, they only make local runs deterministic (UTC) and small.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, app: str = "lorespark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LORESPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the folder the cluster names.

    Only a session whose driver and executors are one process may go without the setting;
    anything else must name a folder that all machines share.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and re.fullmatch(r"local(\[.*\])?", sc.master):
        named = tempfile.mkdtemp(prefix="lorespark-checkpoint-")
    if named is None:
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    sc.setCheckpointDir(named)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder of the shared checkpoint folder; it goes when the driver ends."""
    ensure_checkpoint_dir(spark)
    target = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(path)
    store.deleteOnExit(path)
    return target
