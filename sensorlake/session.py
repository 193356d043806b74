"""Session set-up and the shared scratch folder.

The session pins the zone to UTC (wire timestamps are naive UTC), turns AQE and its
skew handling on, and keeps the web UI off. Intermediate results that must outlive a
lost executor are written under the cluster's ``spark.checkpoint.dir``; a folder of our
own is set only when the session names none (local tests).
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Seconds for Spark's cleaner to delete files after a collection, and collections.
SETTLED_S = 0.5
COLLECTIONS = 4


def get_session(
    master: str | None = None,
    app_name: str = "sensorlake",
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:  # noqa: BLE001  (no SparkContext on a Spark Connect session)
        pass
    checkpoint_dir(spark)
    return spark


def parallelism(spark: SparkSession) -> int:
    """Task slots of the cluster (``defaultParallelism``), or the shuffle partition count
    where the session exposes no SparkContext (Spark Connect)."""
    try:
        return max(1, spark.sparkContext.defaultParallelism)
    except Exception:  # noqa: BLE001
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8")))


def num_partitions(df) -> int | None:
    """Partitions of a DataFrame's plan (planning only, no job), or None if unknown."""
    try:
        return df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001
        return None


def add_to_python_path(spark: SparkSession, folder: str) -> None:
    """Put ``folder`` on the Python path of the session's workers, wherever the driver was
    started: functions that run there are found by their module's name. (On a cluster whose
    workers don't see the folder, ship the package with ``--py-files``.)"""
    try:
        env = spark.sparkContext.environment
    except Exception:  # noqa: BLE001  (Spark Connect: the server's path applies)
        return
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if folder not in paths:
        env["PYTHONPATH"] = os.pathsep.join([folder, *paths])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; set one only if none is named."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001  (Spark Connect: the server's setting applies)
        return spark.conf.get("spark.checkpoint.dir", None) or ""
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="sensorlake-ckpt-")  # one process: tests
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder for one job's outputs."""
    base = checkpoint_dir(spark)
    if not base:
        raise ValueError("the session names no spark.checkpoint.dir for intermediate files")
    return f"{base.rstrip('/')}/sensorlake-scratch/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that are no longer used, and the driver give
    back the heap that their plans took. What Python has let go of is let go of in the JVM a
    moment later, and files are deleted after a collection there (on a cluster the second or
    third finds them), so a single one would leave them until the next step's are written too."""
    for _ in range(COLLECTIONS):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(SETTLED_S)
