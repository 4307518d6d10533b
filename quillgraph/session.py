"""Session helpers: where intermediate tables may be written, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Paths of the tables written so far.
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (tests, a
    single machine) a temporary folder is chosen, and set for later calls; with executors elsewhere that is
    an error, as each would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quillgraph-')}")
    return context.getCheckpointDir().rstrip("/")


def parts(df: DataFrame, mb: float = 0.5) -> int:
    """A number of partitions for what is made of `df`: one for each `mb` by Spark's estimate of its size, but not fewer than by default.

    Partitions that are asked for by number aren't joined to fewer, as others are by their size before a step
    that multiplies rows.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, min(20_000, -(-size // round(mb * 1e6)))) if size < 1 << 50 else least  # joins and rows in memory have no estimate


def written(df: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back.

    Unlike a local checkpoint the table outlives any executor, and unlike ``checkpoint()`` a
    later reader can prune its columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    (df.repartition(*keys) if keys else df).write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process has written for the session; returns their number.

    What was made of them can't be read any more, so the caller does it when its results are stored.
    """
    gone = 0
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
