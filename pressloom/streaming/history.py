"""Conversations and the query log as tables: appended to, renamed and removed by user.

A folder holds one partition per user, so that whatever concerns one user reads and rewrites
that partition alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = "user string, session_id string, turn int, ts timestamp, title string, question string, answer string, cited array<int>, uncited int, invalid int, refused boolean, latency_s double"
TITLE, RENAMED = 70, 120


def turns(spark: SparkSession, folder: str, user: str | None = None) -> DataFrame:
    """All turns, or those of one user."""
    rows = spark.read.schema(TURN).parquet(folder)
    return rows.where(F.col("user") == user) if user is not None else rows


def append_turns(rows: DataFrame, folder: str) -> None:
    """Add turns. The first question of a session is its title."""
    title = F.substring(F.trim(F.regexp_replace("question", r"\s+", " ")), 1, TITLE)
    rows.withColumn("title", F.when(F.col("turn") == 1, title)).select(*[c.split()[0] for c in TURN.split(", ")]).write.mode("append").partitionBy("user").parquet(folder)


def append_log(rows: DataFrame, folder: str) -> bool:
    """Add to the query log; a log that cannot be written is no reason to fail a question."""
    try:
        rows.write.mode("append").json(folder)
    except Exception:
        return False
    return True


def _rewrite(spark: SparkSession, folder: str, user: str, change) -> None:
    """A user's partition as ``change`` leaves it. The new rows are written beside it before
    the old ones go, as a table cannot be read while it is replaced."""
    own = turns(spark, folder, user)
    draft = f"{folder}.{user}.draft"
    change(own).write.mode("overwrite").parquet(draft)
    kept = spark.read.schema(own.schema).parquet(draft)
    kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("user").parquet(folder)
    if not kept.take(1):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/user={user}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    path = spark._jvm.org.apache.hadoop.fs.Path(draft)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def rename_session(spark: SparkSession, folder: str, user: str, session_id: str, title: str) -> str:
    """The title as kept: single spaces, cut; an empty one raises."""
    plain = " ".join(title.split())[:RENAMED]
    if not plain:
        raise ValueError("a title needs a character")
    here = (F.col("session_id") == session_id) & (F.col("turn") == 1)
    _rewrite(spark, folder, user, lambda own: own.withColumn("title", F.when(here, F.lit(plain)).otherwise(F.col("title"))))
    return plain


def delete_session(spark: SparkSession, folder: str, user: str, session_id: str) -> None:
    _rewrite(spark, folder, user, lambda own: own.where(F.col("session_id") != session_id))


def delete_user(spark: SparkSession, folder: str, user: str) -> None:
    _rewrite(spark, folder, user, lambda own: own.limit(0))
