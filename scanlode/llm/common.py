"""Shared folders, tables cut from their lineage, and label propagation helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the data contract: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset and everything runs on this machine, as in tests, a temporary folder is made.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = getattr(sc, "_scanlode_shared", None)
        if where is None:
            where = "file://" + tempfile.mkdtemp(prefix="scanlode-")
            sc._scanlode_shared = where
            sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scanlode/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: short lineage that outlives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scanlode_path = path
    return out


def numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``docs`` in a table with a key of its own for each row, and the key's name: ids may be null or repeat."""
    key = "_row"
    while key in [c.lower() for c in docs.columns]:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_scanlode_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows and bytes of an Arrow batch: texts of several kilobytes each make Spark's 10,000 rows too large.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "32m")}


def in_batches(df: DataFrame) -> DataFrame:
    """``df`` itself, in a session whose Arrow batches are bounded by ``BATCH``; a bound that the user has set stays."""
    conf = df.sparkSession.conf
    for key, (default, own) in BATCH.items():
        if conf.get(key, default) == default:
            conf.set(key, own)
    return df


def filtered(docs: DataFrame, keep) -> DataFrame:
    """Rows of ``docs``, all columns as they are, whose text ``keep`` (texts of a slice to booleans) lets through; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                yield b.filter(pa.array(keep(b.column(at_text).to_pylist()), pa.bool_()))

    return in_batches(docs).mapInArrow(run, docs.schema)


def bucket_of(column: str, modulus: int):
    """crc32 of an id written as text, modulo: the folds that the contracts name."""
    return F.crc32(F.col(column).cast("string")) % modulus


def partial_sums(df: DataFrame, keys: list[str], order: str, size: str, before: str) -> DataFrame:
    """Running total of ``size`` before each row of a small table of totals (one row per shard or bucket)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(before, F.coalesce(F.sum(size).over(w), F.lit(0)).cast("long"))
