"""Files that a job writes for itself, in a folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or the one the context was given; on a local master without either,
    a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='seqlode-')}"
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet; what is written there is deleted when the process ends, or by ``remove``."""
    path = f"{shared_folder(spark)}/seqlode/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def remove(path: str) -> None:
    spark = _made.pop(path, None)
    if spark is None:
        return
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already; the files are temporary
        return


@atexit.register
def _clean() -> None:
    for path in list(_made):
        remove(path)
