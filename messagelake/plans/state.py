"""State that outlives a job: checkpoints in the shared folder, and versioned tables with a pointer written last."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def kept(df: DataFrame) -> DataFrame:
    """The rows in the folder of spark.checkpoint.dir; a folder of our own only where none is set."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(own_folder(spark, "checkpoint"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as a table in a new folder of the shared one: smaller than a checkpoint, for what several branches of a plan read."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        spark.sparkContext.setCheckpointDir(own_folder(spark, "checkpoint"))
        top = spark.sparkContext.getCheckpointDir()
    path = f"{top.rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession, name: str) -> str:
    """A temporary folder of this machine, for sessions of one process; a cluster must name one that it shares."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return tempfile.mkdtemp(prefix=f"{name}-")


class VersionedTable:
    """A parquet table whose versions are folders; the pointer to the current one is written after it is complete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        exists = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.text(f"{self.path}/current") if exists else None

    def version(self) -> str | None:
        pointer = self._pointer()
        rows = [json.loads(r.value) for r in pointer.collect()] if pointer is not None else []
        return max(rows, key=lambda r: r["n"])["version"] if rows else None

    def read(self) -> DataFrame | None:
        version = self.version()
        return self.spark.read.parquet(f"{self.path}/{version}") if version else None

    def append(self, df: DataFrame) -> None:
        """Adds rows at once or not at all, for tables that only grow."""
        df.write.mode("append").parquet(f"{self.path}/batches")

    def appended(self, schema: str) -> DataFrame:
        """The rows of all batches; filters on them skip files by their bounds."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batches")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/batches")

    def write(self, df: DataFrame) -> str:
        """Writes a new version and then points to it; a failure before that leaves the old one in place. The version before
        stays for readers, older ones go."""
        pointer = self._pointer()
        n = max((json.loads(r.value)["n"] for r in pointer.collect()), default=0) + 1 if pointer is not None else 1
        version = f"v{n:06d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{version}")
        self.spark.createDataFrame([(json.dumps({"n": n, "version": version}),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/current")
        if pointer is not None:
            old = sorted((json.loads(r.value) for r in pointer.collect()), key=lambda r: r["n"])
            for r in old[-2:-1]:
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{r['version']}")
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        return version
