"""Session helpers.

The library never creates its own cluster settings inside operators; these
helpers exist for tests, the bench and local runs.  On a cluster the session
comes from the caller and ``checkpoint_dir`` reads the shared folder it names.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "docket") -> SparkSession:
    """A local session tuned like the cluster defaults we rely on (AQE on)."""
    cpus = str(cpus)
    if shuffle_partitions is None:
        shuffle_partitions = 8 if cpus == "*" else int(cpus)
    parts = shuffle_partitions
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("DOCKET_DRIVER_MEM", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and scratch tables: ``spark.checkpoint.dir``.

    Where that is unset, a local session (tests, bench) gets a fresh folder once; on a cluster
    a machine-local folder would be wrong, so it is an error there.
    """
    global _local_dir
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local_dir = _local_dir or tempfile.mkdtemp(prefix="docket-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique sub-folder of the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_local_dir: str | None = None
