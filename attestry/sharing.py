"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own, which goes at exit; on a
    cluster that is an error, as executors don't see each other's disks."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _own:
        _own[sc.applicationId] = folder = tempfile.mkdtemp(prefix="attestry-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{_own[sc.applicationId]}"


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Makes checkpoint() write to the shared folder, if the session has none yet."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(f"{shared_folder(spark)}/checkpoints")
    return spark
