"""Session helpers: shared scratch space, lineage cuts and narrowing by ids."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


class NoSharedFolder(RuntimeError):
    """The cluster names no folder that the driver and all executors can reach."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    A session on one machine (``local[...]``), where every folder is shared, falls back to
    one below its warehouse. A cluster must name its own.
    """
    context = spark.sparkContext
    named = context.getConf().get(CHECKPOINT_SETTING) or spark.conf.get(CHECKPOINT_SETTING, None)
    named = named or context.getCheckpointDir()
    if not named:
        if context.master != "local" and not context.master.startswith("local["):
            raise NoSharedFolder(f"set {CHECKPOINT_SETTING} to a folder that driver and executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """Where the tables of this application stand."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one table of this application below the shared folder."""
    return f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables that this application stored on its way; results that still need them must be written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Store a small, costly result as a table in the shared folder and go on from there.

    Later steps do not repeat the work before it, a lost executor does not either, and
    Spark knows the real size of the table when it chooses joins.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_of(df: DataFrame) -> int:
    """How many tasks the last stage of a plan has, without running any of it.

    Asking a plan with an exchange for its partitions would run the stages below; such plans
    end in as many tasks as the session shuffles to.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.rdd.getNumPartitions()


def spread(scan: DataFrame) -> DataFrame:
    """A scan over fewer splits than cores, dealt out to all cores; larger ones stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if tasks_of(scan) >= cores else scan.repartition(cores)


def by_key(df: DataFrame, key: str, rows: int, rows_per_task: int = 500) -> DataFrame:
    """Rows with costly expressions, grouped by key into as many tasks as their number is worth."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(most, rows // rows_per_task)), key)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session setting for the time of one action, and as it was before afterwards."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def narrow(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Keep the rows of a large table whose key is in a set of ids.

    A semi-join on distinct ids: Spark sends the ids to the table while they are small, in
    bytes as measured at run time, and otherwise meets them by key. Either way the table
    is filtered before anything is aggregated.
    """
    return df.join(ids.select(key).distinct(), key, "left_semi")
