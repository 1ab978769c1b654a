"""Tables that cut lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder of our own does in local mode, in which the driver's disk is everybody's;
    on a cluster it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(found.rstrip("/"))
        whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        return re.sub("^file:/(?!/)", "file:///", whole)
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "path" not in _own_dir:
        folder = tempfile.TemporaryDirectory(prefix="candlewick-")
        atexit.register(folder.cleanup)
        _own_dir["path"] = f"file://{folder.name}"
    return _own_dir["path"]


class Scratch:
    """Tables written into the shared folder, so that lost executors cost no recomputation of what led to them.

    ``cut`` writes a frame and reads it back; ``drop`` removes what an iteration no longer needs. Results are read
    lazily, so tables stay until ``close``, the end of a ``with`` block, or the end of the driver's process.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0
        atexit.register(self.close)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        atexit.unregister(self.close)
        with contextlib.suppress(Exception):  # the session may be gone
            delete(self.spark, self.root)

    def path(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}"

    def cut(self, df: DataFrame) -> DataFrame:
        path = self.path()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_scratch", None)
        if path:
            delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a path of any file system that Spark can reach."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
