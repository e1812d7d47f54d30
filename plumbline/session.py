"""Reading the driver's tables, and the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names.

    Where none is named, a local session gets a folder of its own; on a
    cluster that is an error, as executors don't share local folders.
    """
    found = spark.sparkContext.getCheckpointDir()
    if found is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.sparkContext.setCheckpointDir(named)
        found = spark.sparkContext.getCheckpointDir()
    return found


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it comes in fewer pieces: small files with much to do for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of an interim result (a few numbers each) that one partition may hold when its size is known.
ROWS = 250_000


def cut(df: DataFrame, rows: int | None = None, dealt: bool = False) -> DataFrame:
    """``df`` written to the shared folder now, without its lineage.

    Where the number of rows is known (or an upper bound), a small result
    comes in few partitions, so that long loops don't leave a file for each
    shuffle partition behind in every round; what is grouped or joined from
    results of one partition isn't shuffled again. ``dealt``: rows take much
    work, or come from many more, so they are worked out in as many tasks as
    otherwise and brought together after.
    """
    shared_dir(df.sparkSession)
    if rows is None:
        return _plain(df.checkpoint(eager=True))
    n = 1 + rows // ROWS
    out = _plain((df.repartition if dealt else df.coalesce)(n).checkpoint(eager=True))
    # a checkpoint doesn't tell that it has one partition
    return out.coalesce(1) if n == 1 else out


def _plain(df: DataFrame) -> DataFrame:
    """``df`` without its estimated size where that is no size any more.

    A checkpoint takes over the size that its plan was estimated at, and a
    join is estimated at the product of its sides: in loops that join a table
    with itself the number's digits double each round, until planning takes
    minutes and the driver's memory.
    """
    plan = df._jdf.queryExecution()
    if int(plan.optimizedPlan().stats().sizeInBytes()) < 1 << 63:
        return df
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), spark)
