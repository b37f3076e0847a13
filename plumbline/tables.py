"""Where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of this machine only where it is unset and all runs here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file:///tmp/plumbline-checkpoints"
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/plumbline-{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a DataFrame to the shared folder and reads it back: lineage ends at files that every executor sees, and the shuffles behind them go."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with _own_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _own_shuffles(spark: SparkSession):
    """Removes the shuffles made within, unless other jobs run beside; those are left to Spark's cleaner.

    Should a shuffle still be wanted, Spark computes it again as after the loss of an executor.
    """
    sc = spark._jsc.sc()
    idle = not spark.sparkContext.statusTracker().getActiveJobsIds()
    first = sc.newShuffleId()
    yield
    last = sc.newShuffleId()
    cleaner = sc.cleaner()
    if idle and cleaner.isDefined() and not spark.sparkContext.statusTracker().getActiveJobsIds():
        for shuffle in range(first + 1, last):
            cleaner.get().doCleanupShuffle(shuffle, False)


def drop_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes tables made by ``materialise`` that no later plan reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if "/plumbline-" in f:
                path = hadoop.Path(f)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(df: DataFrame, each: int = 128 << 20) -> int:
    """How many tasks an exchange of whole texts is dealt to: spark.sql.shuffle.partitions, more where the files read are larger than ``each`` bytes for each of them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    size = sum(x for x in sizes if x < 1 << 60)  # relations without known size say more
    return max(partitions(df.sparkSession), min(-(-size // each), 1 << 20))
