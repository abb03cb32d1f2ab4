"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: such a table
survives lost executors, and the shuffle files behind it can go at once.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_ROW_GROUP = 16 << 20  # bytes that a writing task holds
_FREE_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder; a local one is set only where the session names none, and only if all executors are in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="anchorspark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def unused(name: str, taken: Iterable[str]) -> str:
    """The name, lengthened until no column has it, whatever its case."""
    taken = {x.lower() for x in taken}
    while name.lower() in taken:
        name += "_"
    return name


class Scratch:
    """One operator run's tables; they go when the JVM ends, or earlier by drop()."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        jpath, fs = self._fs(f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}")
        fs.mkdirs(jpath)
        fs.deleteOnExit(jpath)
        self.path = re.sub("^file:/+", "file:///", fs.makeQualified(jpath).toString())  # with its scheme, as any reader takes it

    def _fs(self, path: str):
        jpath = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath, jpath.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and return the table; frees the shuffles that made it."""
        path = f"{self.path}/{name}"
        conf, before = self.spark.conf, self.spark.conf.get(_FREE_SHUFFLE, "false")
        conf.set(_FREE_SHUFFLE, "true")
        try:
            df.write.option("compression", "zstd").option("parquet.block.size", _ROW_GROUP).parquet(path)
        finally:
            conf.set(_FREE_SHUFFLE, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """An empty folder for files that aren't Spark's."""
        jpath, fs = self._fs(f"{self.path}/{name}")
        fs.mkdirs(jpath)
        return f"{self.path}/{name}"

    def drop(self, *names: str) -> None:
        for name in names:
            jpath, fs = self._fs(f"{self.path}/{name}")
            fs.delete(jpath, True)
