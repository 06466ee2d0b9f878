"""Session helpers: a local session for tests/bench, and the shared folder.

On a cluster the session is built by the caller; nothing here overrides
settings that are already present.  The shared folder for checkpoints and
hand-off tables is whatever the cluster names in ``spark.checkpoint.dir``;
only when that is unset (local tests) do we create one.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "16g",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # the JVM compiles no method over 8000 bytes: stages of many generated expressions run split instead
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # reclaim checkpoint files once their DataFrames are gone
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cpus: int | str = "*", app: str = "panelsignal") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


_LOCAL_DIR: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder for checkpoints and written hand-off tables.

    Read from ``spark.checkpoint.dir``; a local temporary folder is used
    only when it is unset *and* the master is local (tests); on a cluster
    an unset setting is an error rather than a driver-local folder.
    """
    global _LOCAL_DIR
    try:
        sc = spark.sparkContext
    except Exception as e:  # Spark Connect: the client can't see the cluster's context
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path:
            return path
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster") from e
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path
    if not str(sc.master).startswith("local") or str(sc.master).startswith("local-cluster"):
        # a folder on the driver's disk is not shared with the executors
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="panelsignal-ckpt-")
        # tests and benches write hand-off tables here: they end with the process
        atexit.register(shutil.rmtree, _LOCAL_DIR, ignore_errors=True)
    sc.setCheckpointDir(_LOCAL_DIR)
    return _LOCAL_DIR


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location under the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
