"""Scanning files as they arrive (an extension: the batch scan's detectors are stateless)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlode.operators import findings as fd
from scanlode.operators import one_pass
from scanlode.plans.scan import admitted, routed
from scanlode.streaming.rescan import APART

ARRIVALS = "file_path string, content string, ts timestamp"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """New rows of (file_path, content, ts) as Parquet files land in a folder."""
    return spark.readStream.schema(ARRIVALS).parquet(folder)


def stream_findings(files: DataFrame, baseline: DataFrame | None = None, late: str = "1 hour") -> DataFrame:
    """Findings of all detectors in a stream, each fingerprint once per ``late`` of event time, known ones left out.

    Detectors run row by row without an exchange; a finding carries its file's event time, and the
    watermark bounds what is remembered of fingerprints. What a file's later version opens or closes is
    the business of ``rescan``.
    """
    rows = admitted(routed(files))
    # While it is scanned a file's name carries its time.
    stamped = rows.select(F.concat_ws(APART, "file_path", F.unix_micros("ts").cast("string")).alias("file_path"), "content", "language")
    tail = F.substring_index("file_path", APART, -1)
    found = one_pass.detect(stamped, grouped=False).withColumns({"ts": F.timestamp_micros(tail.cast("long")), "file_path": F.substr("file_path", F.lit(1), F.length("file_path") - F.length(tail) - 1)})
    out = fd.with_fingerprints(fd.calibrate(found)).withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])
    return out if baseline is None else out.join(baseline.select("fingerprint"), "fingerprint", "left_anti")


def scan_batches(files: DataFrame, path: str, checkpoint: str):
    """Starts a query that runs the whole scan over each micro-batch and adds its findings to a table.

    A batch owns a folder named by its number, so one that is replayed after a failure replaces what it wrote.
    """

    def one(batch: DataFrame, number: int) -> None:
        rows = admitted(routed(batch.select("file_path", "content")))
        fd.with_fingerprints(fd.calibrate(one_pass.detect(rows))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
