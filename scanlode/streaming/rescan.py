"""Incremental rescan as a stateful stream: versions of files come in, opened and closed findings go out.

Every version is scanned by all detectors, row by row and without an exchange; what they
find and a mark of the version itself then meet the file's state by path. The state is
the hash, time and open findings of the last version, so a version with the same hash
changes nothing, one with a null text (the file is gone) closes all, and a version older
than the last one is ignored. A file's state is as large as its findings, and with a
``ttl`` it is forgotten when the file has not been seen for so long.

State lives in RocksDB, checkpointed with the stream: a stream that is started again on its
checkpoint goes on where it stopped and opens nothing twice.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from scanlode.functions import columns as C
from scanlode.operators import findings as fd
from scanlode.operators import one_pass

VERSIONS = "file_path string, content string, ts timestamp"
FINDING = "fingerprint string, rule_id string, severity string, line_number int"
STATE = f"sha256 string, ts long, open array<struct<{FINDING}>>"
CHANGES = f"file_path string, ts long, change string, {FINDING}"
#: Sets a version's time and hash apart from its path.
APART = "\x1f"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def versions(spark: SparkSession, folder: str, files_each: int | None = None) -> DataFrame:
    """New rows of (file_path, content, ts) as Parquet files land in a folder, ``files_each`` of them at a time."""
    reader = spark.readStream.schema(VERSIONS)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).parquet(folder)


def version_findings(files: DataFrame, today: datetime.date) -> DataFrame:
    """file_path, ts, sha256 and ``FINDING`` of each version; the finding's columns are null in the row that marks the version."""
    time, sha = F.coalesce(F.unix_micros("ts"), F.lit(0)), F.coalesce(F.sha2("content", 256), F.lit(""))
    # While it is scanned a version is a file of its own.
    own = files.where(C.language(F.col("file_path")).isNotNull()).select(F.concat_ws(APART, "file_path", time.cast("string"), sha).alias("file_path"), "content", C.language(F.col("file_path")).alias("language"))
    tail = F.substring_index("file_path", APART, -2)
    split = {"sha256": F.substring_index(tail, APART, -1), "ts": F.substring_index(tail, APART, 1).cast("long"), "file_path": F.substr("file_path", F.lit(1), F.length("file_path") - F.length(tail) - 1)}
    found = fd.calibrate(fd.unsuppressed(one_pass.detect(own.where("content IS NOT NULL"), grouped=False), today)).withColumns(split)
    found = fd.with_fingerprints(found).select("file_path", "ts", "sha256", "fingerprint", "rule_id", "severity", "line_number")
    marks = own.withColumns(split).select("file_path", "ts", "sha256", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in FINDING.split(", ")])
    return found.unionByName(marks)


class Rescan(StatefulProcessor):
    """A file's last version and what it opened; rows are the versions of one batch."""

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", STATE, self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (path,) = key
        arrived: dict[tuple[int, str], dict[str, tuple]] = {}
        for r in rows:
            found = arrived.setdefault((r.ts, r.sha256), {})
            if r.fingerprint is not None:
                found[r.fingerprint] = (r.fingerprint, r.rule_id, r.severity, r.line_number)
        sha, time, open_ = None, None, {}
        state = self.last.get()  # None if there is none: each question to the state is a message to the executor
        if state is not None:
            sha, time, held = state
            open_ = {x[0]: tuple(x) for x in held}
        for (ts, own), found in sorted(arrived.items()):
            if time is not None and ts < time:
                continue
            if own != sha:
                for change, these, others in (("closed", open_, found), ("opened", found, open_)):
                    for x in sorted(these.values()):
                        if x[0] not in others:
                            yield Row(file_path=path, ts=ts, change=change, fingerprint=x[0], rule_id=x[1], severity=x[2], line_number=x[3])
                open_ = found
            sha, time = own, ts
        self.last.update((sha, time, list(open_.values())))


def changes(files: DataFrame, today: datetime.date | None = None, ttl: datetime.timedelta | None = None) -> DataFrame:
    """``CHANGES`` of a stream of ``VERSIONS``, their times as timestamps."""
    ttl_ms = None if ttl is None else int(ttl.total_seconds() * 1000)
    found = version_findings(files, today or datetime.date.today()).groupBy("file_path")
    out = found.transformWithState(Rescan(ttl_ms), CHANGES, "Append", "None" if ttl_ms is None else "ProcessingTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))


@contextmanager
def _settings(spark: SparkSession, **values: str):
    """A stream takes the session's settings when it starts; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(files: DataFrame, path: str, checkpoint: str, today: datetime.date | None = None, ttl: datetime.timedelta | None = None, **trigger) -> StreamingQuery:
    """Starts a rescan that appends ``CHANGES`` to a Parquet table; by default it takes all that is there and ends."""
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER}
    if ttl is not None:  # else batches without data would follow each other for ever, to see what has expired
        settings["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    with _settings(files.sparkSession, **settings):
        out = changes(files, today, ttl).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        return out.trigger(**(trigger or {"availableNow": True})).start()


def open_findings(changes: DataFrame) -> DataFrame:
    """file_path, fingerprint, rule_id, line_number of what a table of changes leaves open."""
    last = changes.groupBy("file_path", "fingerprint").agg(F.max_by(F.struct("change", "rule_id", "line_number"), "ts").alias("x"))
    return last.where("x.change = 'opened'").select("file_path", "fingerprint", "x.rule_id", "x.line_number")
