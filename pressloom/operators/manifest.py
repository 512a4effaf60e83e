"""The ingestion log: what is done, what is due, and which cached results may be used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(log: DataFrame) -> DataFrame:
    """The last row of every path; a log holds several, out of order."""
    cols = [c for c in log.columns if c != "path"]
    return log.groupBy("path").agg(F.max_by(F.struct(*cols), F.struct("updated", "sha1")).alias("r")).select("path", "r.*")


def done(log: DataFrame) -> DataFrame:
    """(path, sha1, stage): stages done for the content a path has now; a changed content
    starts again with none."""
    return current(log).select("path", "sha1", F.explode("stages").alias("stage", "state")).where("state = 'done'").drop("state")


def pending(files: DataFrame, log: DataFrame, stage: str) -> DataFrame:
    """Files (path, sha1) for which a stage is not done with this content."""
    return files.join(done(log).where(F.col("stage") == stage), ["path", "sha1"], "left_anti")


def summary(log: DataFrame) -> DataFrame:
    """(stage, state, n) over current rows."""
    return current(log).select(F.explode("stages").alias("stage", "state")).groupBy("stage", "state").agg(F.count("*").alias("n"))


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A table with all rows of the keys that arrive replaced; running it twice changes nothing."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def reusable(cached: Column, wanted: Column) -> Column:
    """Whether a cached record may serve: one fingerprint (provider/model/prompt), or another
    model of paid providers under the same prompt; fixtures never serve paid runs."""
    a, b = F.split(cached, "/"), F.split(wanted, "/")
    fixture = lambda p: F.lower(F.get(p, F.lit(0))).isin("fixture", "fake")
    return (cached == wanted) | ((F.get(a, F.lit(-1) + F.size(a)) == F.get(b, F.lit(-1) + F.size(b))) & (fixture(a) == fixture(b)))


def latest(records: DataFrame, key: str, order: str) -> DataFrame:
    """One record per key, later files before earlier ones."""
    cols = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("r")).select(key, "r.*")


def inventory(files: DataFrame) -> DataFrame:
    """(path, length, sha256) of binary files."""
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(recorded: DataFrame, found: DataFrame) -> DataFrame:
    """(path, problem): files missing, unexpected or changed against a recorded inventory."""
    j = recorded.withColumnsRenamed({"length": "l0", "sha256": "s0"}).join(found, "path", "full")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("s0").isNull(), "unexpected").when(F.col("s0") != F.col("sha256"), "changed")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def rebuilt(docs: DataFrame) -> DataFrame:
    """(path, sha1, stages): the log as the extracted files show it, for when it is lost: with
    an error extraction failed, else it and normalisation are done."""
    failed = F.max(F.col("error").isNotNull().cast("int")) == 1
    none = F.create_map().cast("map<string,string>")
    stages = F.when(failed, F.create_map(F.lit("extract"), F.lit("error"))).otherwise(F.create_map(F.lit("extract"), F.lit("done"), F.lit("normalize"), F.lit("done")))
    return docs.groupBy(F.col("source_file").alias("path")).agg(F.max(F.when(F.col("file_hash") != "", F.col("file_hash"))).alias("sha1"), F.coalesce(stages, none).alias("stages"))


def set_stage(stats: DataFrame, stage: str, counters: dict[str, int]) -> DataFrame:
    """Counters (stage, name, value) with all of one stage replaced."""
    new = stats.sparkSession.createDataFrame([(stage, k, int(v)) for k, v in counters.items()], "stage string, name string, value bigint")
    return stats.where(F.col("stage") != stage).unionByName(new)
