"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and everything runs on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = getattr(spark.sparkContext, "_scanlode_tables", None) or "file://" + tempfile.mkdtemp(prefix="scanlode-")
        spark.sparkContext._scanlode_tables = folder
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/scanlode-tables/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back."""
    spark = df.sparkSession
    path = new_path(spark, "cut")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, keys: list[str], order: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``_rank``: the number of rows (or the total of ``weight``) before each row of its ``keys`` in ``order``.

    Ranks come from range partitions: a total per partition and key, a prefix sum over those
    few totals, and a running total within each, so no task sorts a whole group.
    """
    size = F.lit(1) if weight is None else F.col(weight)
    # In a table: both uses below must see the same partitions.
    ranged = cut(df.repartitionByRange(*keys, order).withColumn("_part", F.spark_partition_id()))
    running = Window.partitionBy("_part", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part", *keys).agg(F.sum(size).alias("_n"))
    starts = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    rows = ranged.withColumn("_own", F.coalesce(F.sum(size).over(running), F.lit(0))).join(starts, same)
    return rows.select(*df.columns, (F.col("_own") + F.col("_start")).cast("long").alias("_rank"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where it has fewer partitions: a small file is one split, but what follows may be costly."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


#: Tasks that each core gets of a table of keys.
TASKS_A_CORE = 4


def dealt(keys: DataFrame) -> DataFrame:
    """A narrow table dealt evenly over several tasks a core, whatever its splits.

    Every key becomes a file that is costly to scan, while a million keys are a few megabytes: one split, or
    several of which those without the start of a row group are empty. Long texts are not dealt so (see ``spread``).
    """
    return keys.repartition(TASKS_A_CORE * keys.sparkSession.sparkContext.defaultParallelism)
