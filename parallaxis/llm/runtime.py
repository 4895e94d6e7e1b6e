"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship_package

#: Rows of a batch handed to Python. Whole texts travel in batches, so few rows keep a worker small.
BATCH_ROWS = 256


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; fall back to a local one in local mode only."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(folder)


def materialise(df: DataFrame) -> DataFrame:
    """Write once to the shared checkpoint folder, so that later steps neither recompute nor depend on an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Whether Spark removes the shuffle files of a query as soon as it is done; else they stay until the driver happens to collect its garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one operator's run, written as Parquet in the shared checkpoint folder and removed as soon as nothing reads them."""

    def __init__(self, spark: SparkSession) -> None:
        ensure_checkpoint_dir(spark)
        self.spark, self.paths = spark, {}
        self.top = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid4()}"

    def keep(self, df: DataFrame) -> DataFrame:
        """The table, written and read again."""
        path = f"{self.top}/{len(self.paths)}"
        conf, before = self.spark.conf, self.spark.conf.get(TIDY, None)
        conf.set(TIDY, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if before is None:
                conf.unset(TIDY)
            else:
                conf.set(TIDY, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = table, path
        return table

    def drop(self, table: DataFrame) -> None:
        """Removes a table that nothing reads any more."""
        remove(self.spark, self.paths[id(table)][1])

    def clear(self) -> None:
        """Removes all tables; what is returned to callers must have been written elsewhere.

        Plans, broadcasts and shuffle records of the run are garbage by now. The driver's JVM collects it here, as else its heap grows from operator to operator.
        """
        remove(self.spark, self.top)
        self.spark._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there, in whatever store holds it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Bytes that a counted table may have in order to be broadcast.
BROADCAST_BYTES = 32 << 20


def bounded(df: DataFrame, row_bytes: int | Column = 64) -> DataFrame:
    """A written table, marked for broadcast if its rows, of about row_bytes each, are few; else joined by a shuffle."""
    held = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_BYTES else df


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts can hold, and make the package known to Python workers."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the input does not have, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with its columns named input_0, input_1 and so on, so that no helper column clashes, and these names by the old ones in lower case."""
    names = [f"input_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip((c.lower() for c in df.columns), names, strict=True))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
