"""Incremental ingestion: new or changed files by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressloom.operators import manifest as M
from pressloom.session import cut_lineage
from pressloom.sources import files as A


def due(spark: SparkSession, folder: str, log: DataFrame, stage: str) -> DataFrame:
    """(path, sha1, size): known files of a folder for which a stage is due."""
    found = A.discover(spark, folder).select("path", F.sha1("content").alias("sha1"), F.col("length").alias("size"))
    return M.pending(found, log, stage)


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, schema: str):
    """A stream of JSON artifacts into a table of batches. A batch costs what it holds, however
    large the table is: it is a partition of its own, replaced as a whole where the stream
    repeats it, so every artifact is there once. ``current`` reads the table, ``compact``
    shortens it."""
    rows = spark.readStream.schema(schema).json(folder)

    def add(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch", F.lit(epoch).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str, key: str = "source_file") -> DataFrame:
    """The last row of every key; of several in one batch the greatest, so that it is always
    the same one."""
    rows = spark.read.parquet(table).withColumn("batch", F.col("batch").cast("bigint"))
    cols = [c for c in rows.columns if c not in (key, "batch")]
    last = F.max_by(F.struct(*cols, F.col("batch")), F.struct("batch", *cols))
    return rows.groupBy(key).agg(last.alias("r")).select(key, "r.*")


def compact(spark: SparkSession, table: str, key: str = "source_file") -> None:
    """Put the current rows into the newest batch and drop the others. If it is cut short, what
    is left of the others is older than every row of the newest and does not count."""
    rows = cut_lineage(current(spark, table, key))
    newest = rows.agg(F.max("batch")).first()[0]
    if newest is None:
        return
    rows.withColumn("batch", F.lit(newest)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for part in fs.listStatus(path):
        name = part.getPath().getName()
        if name.startswith("batch=") and int(name[6:]) < newest:
            fs.delete(part.getPath(), True)
