"""The stateful rescan: replay, restart, deletions, late versions and every family of detectors."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.operators import findings as fd
from scanlode.operators import one_pass
from scanlode.sources import corpus
from scanlode.streaming import rescan

TODAY = datetime.date(2025, 1, 1)
BAD, WORSE = "import pickle\npickle.loads(b)\n", "import pickle\npickle.loads(b)\neval(x)\n"
HISTORY = [
    [("a.py", BAD, 1), ("b.sh", 'eval "$X"\n', 1), ("c.md", "text", 1), ("d.py", "x = 1\n", 1)],
    [("a.py", BAD, 2), ("b.sh", None, 2), ("d.py", WORSE, 2)],
    [("a.py", WORSE, 3), ("b.sh", 'eval "$X"\n', 1), ("d.py", BAD, 4), ("d.py", "x = 2\n", 3)],
    [("b.sh", 'eval "$X"\n', 5), ("d.py", "\n" + BAD, 5)],
]


@pytest.fixture
def few(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def write(spark, rows, path):
    at = [(p, c, datetime.datetime(2025, 1, d)) for p, c, d in rows]
    spark.createDataFrame(at, rescan.VERSIONS).coalesce(1).write.parquet(path)


def events(spark, folder):
    return sorted((r["ts"].day, r["file_path"], r["change"], r["rule_id"], r["line_number"]) for r in spark.read.parquet(f"{folder}/out").collect())


def go(spark, folder, **options):
    q = rescan.start(rescan.versions(spark, f"{folder}/in/*"), f"{folder}/out", f"{folder}/state", TODAY, **options)
    assert q.awaitTermination(300) and q.exception() is None


WANT = sorted([
    (1, "a.py", "opened", "DSER001", 2), (1, "b.sh", "opened", "SH001", 1), (2, "b.sh", "closed", "SH001", 1),
    (2, "d.py", "opened", "CMD003", 3), (2, "d.py", "opened", "DSER001", 2), (3, "a.py", "opened", "CMD003", 3),
    (3, "d.py", "closed", "CMD003", 3), (3, "d.py", "closed", "DSER001", 2), (4, "d.py", "opened", "DSER001", 2),
    (5, "b.sh", "opened", "SH001", 1), (5, "d.py", "closed", "DSER001", 2), (5, "d.py", "opened", "DSER001", 3),
])


def test_restarts_open_nothing_twice(few, tmp_path):
    provider = few.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for i, rows in enumerate(HISTORY):
        write(few, rows, f"{tmp_path}/in/{i}")
        go(few, tmp_path)
    assert events(few, tmp_path) == WANT
    go(few, tmp_path)
    assert events(few, tmp_path) == WANT and few.conf.get("spark.sql.streaming.stateStore.providerClass", None) == provider
    left = {(r["file_path"], r["rule_id"], r["line_number"]) for r in rescan.open_findings(few.read.parquet(f"{tmp_path}/out")).collect()}
    assert left == {("a.py", "DSER001", 2), ("a.py", "CMD003", 3), ("b.sh", "SH001", 1), ("d.py", "DSER001", 3)}


def test_replay_in_one_batch_gives_the_same_changes(few, tmp_path):
    for i, rows in enumerate(HISTORY):
        write(few, rows, f"{tmp_path}/in/{i}")
    go(few, tmp_path, ttl=datetime.timedelta(days=30))
    # In one batch no version is late: b.sh's first one is a repetition there.
    assert events(few, tmp_path) == WANT


def test_every_family_opens_what_a_scan_finds(few, tmp_path):
    files = corpus.source_files(few, few.range(len(corpus.TEMPLATES)))
    files.withColumn("ts", F.lit("2025-01-01").cast("timestamp")).select("file_path", "content", "ts").coalesce(2).write.parquet(f"{tmp_path}/in/0")
    go(few, tmp_path)
    routed = files.select("file_path", "content", C.language(F.col("file_path")).alias("language")).where("language IS NOT NULL")
    whole = fd.with_fingerprints(fd.calibrate(fd.unsuppressed(one_pass.detect(routed), TODAY)))
    want = sorted({(r["file_path"], r["fingerprint"]) for r in whole.select("file_path", "fingerprint").collect()})
    got = sorted((r["file_path"], r["fingerprint"]) for r in few.read.parquet(f"{tmp_path}/out").select("file_path", "fingerprint").collect())
    assert got == want and len({r["rule_id"] for r in whole.select("rule_id").distinct().collect()}) > 80
