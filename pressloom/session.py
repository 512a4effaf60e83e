"""Session helpers shared by every operator."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent
#: Part of the names of kept tables: raise it where their contents change.
__version__ = 3


def local_session(cores: int | str = 8, app: str = "pressloom") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("PRESSLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that their Python
    workers can import it wherever the repository lies."""
    sc = spark.sparkContext
    if getattr(sc, "_pressloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="pressloom-")) / "pressloom_src.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    sc.addPyFile(str(target))
    sc._pressloom_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder every executor can reach: the session's own setting. Only where
    driver and executors are one machine's, as in tests, a local folder stands in for it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pressloom-checkpoint-"))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that a lost executor costs no
    recomputation of what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(spark: SparkSession, name: str, sources: list[str], build: Callable[[], DataFrame]) -> DataFrame:
    """A table derived from files, written once in the shared folder and read by whoever asks
    again. Its name holds a fingerprint of the files (path, length, time), so changed files
    make another table. It is published by a rename: a reader sees all of it or nothing, and
    of two writers one wins."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marks = []
    for source in sources:
        path = jvm.org.apache.hadoop.fs.Path(source)
        status = path.getFileSystem(conf).getFileStatus(path)
        parts = path.getFileSystem(conf).listStatus(path) if status.isDirectory() else [status]
        marks += sorted((x.getPath().toString(), x.getLen(), x.getModificationTime()) for x in parts)
    key = hashlib.sha256(repr((name, __version__, marks)).encode()).hexdigest()[:24]
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kept/{name}-{key}")
    fs = target.getFileSystem(conf)
    if not fs.exists(target):
        draft = jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.{uuid.uuid4().hex}")
        build().write.parquet(draft.toString())
        if not fs.rename(draft, target) or fs.exists(jvm.org.apache.hadoop.fs.Path(target, draft.getName())):
            fs.delete(draft, True)  # somebody else was first
    return spark.read.parquet(target.toString())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized_partitions(df: DataFrame, each: int = 4 << 20) -> int:
    """Partitions for a shuffle that grows with df: one for every ``each`` bytes of the tables
    it reads, and no fewer than the session's number."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(x for x in sizes if x < 1 << 60)  # the optimizer's word for not knowing is larger
    return max(partitions(df.sparkSession), min(-(-known // each), 100_000))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where they come in few splits, as from one small file; a table in
    at least half as many splits as there are cores is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df
