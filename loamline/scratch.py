"""Intermediate tables in the folder that all executors share.

A lineage is cut by writing a Parquet table below ``spark.checkpoint.dir`` and reading it back.
Where that setting is absent, a temporary folder is used on a single machine (local mode) and a cluster is refused.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import bound_batches

#: Bytes of a row group of scratch tables: what a task holds of each that it writes or reads.
ROW_GROUP = 16 * 2**20

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = "file://" + tempfile.mkdtemp(prefix="loamline-")
    return _local_dirs[app]


class Scratch:
    """A private folder below the shared one; holds the tables of one operator run.

    Tables that a returned DataFrame still reads must stay, so they are removed when Python exits.
    ``drop`` removes a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/loamline/{name}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.close)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{self._n:03d}-{name}"
        self._n += 1
        df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._loamline_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._loamline_path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then the cluster's to clean
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
