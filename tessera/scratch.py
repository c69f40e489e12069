"""Tables in the folder that all executors share, to cut lineage between steps and rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only for a local session where it is unset (a test), a temporary one, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


class Rounds:
    """Parquet tables in the shared folder.  ``cut`` writes one and reads it back, so a lost executor costs the tasks it ran, never the whole
    plan; ``drop`` removes tables of it at once, and lets others be; what is left goes with the application."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}", 0
        self._path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def cut(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._round_path = path
        return out

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_round_path", None):
                self._fs.delete(self._path(path), True)
