"""Session helpers: the shared folder, tables that cut lineage, table loading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (tests, a laptop) is a folder of our own made,
    and it is removed when the process ends; on a cluster that names none this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            named = set_before.get()
        elif not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all its machines share")
        else:
            named = "file://" + tempfile.mkdtemp(prefix="tracelode-")
            _OWN_DIRS.append(named[len("file://"):])
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tracelode/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession) -> int:
    """Deletes the tables that ``written`` has left so far in this process; results that still read them must be done. Gives their number."""
    n = len(_WRITTEN)
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


def spread(df: DataFrame) -> DataFrame:
    """Rows for work that is all computation: dealt out anew where a scan comes in fewer splits than there are cores.

    A table with as many splits as cores or more, so any large one, stays as it is and isn't shuffled; so do
    a stream and a plan with shuffles of its own, whose partitions are only known when it runs.
    """
    if df.isStreaming or df._jdf.queryExecution().executedPlan().nodeName().startswith("AdaptiveSparkPlan"):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@atexit.register
def _drop_own_dirs() -> None:
    for d in _OWN_DIRS:
        shutil.rmtree(d, ignore_errors=True)
