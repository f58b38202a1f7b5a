"""Session settings shared by tests, the benchmark and jobs."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession

# Runtime settings every job relies on: UTC timestamps, AQE with skew handling,
# and per-partition overwrite so that a write replaces only the days it carries.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("brineframe")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # call-site capture costs several driver round trips per expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_FOLDERS: list[str] = []


def shared_dir(spark: SparkSession, name: str = "stage", base: str | None = None) -> str:
    """A fresh folder path below the shared folder of the cluster.

    The folder is ``base`` if given, else ``spark.checkpoint.dir``, else the checkpoint
    directory of the context. Where none is set, a session of one machine (tests, a laptop)
    gets a temporary folder that is removed at exit; on a cluster it is an error,
    because executors would write to their own disks. The session is not changed.
    """
    base = base or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own_folder()
    _FOLDERS.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


@lru_cache(maxsize=1)
def _own_folder() -> str:
    base = tempfile.mkdtemp(prefix="brineframe-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def release_shared_dirs(spark: SparkSession) -> int:
    """Delete all folders that ``shared_dir`` gave out, when nothing reads them any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    while _FOLDERS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        gone += bool(path.getFileSystem(hadoop).delete(path, True))
    return gone
