"""Findings as rows: schema, suppression, calibration, filters, fingerprints, baselines, shards and dedup."""

from __future__ import annotations

import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions.domains import CONFIDENCES, POLICIES, SEVERITIES
from scanlode.plans.tables import placed

EVIDENCE = "struct<sink: string, sink_rule: string, taint_sources: array<string>, taint_path: string>"
SCHEMA = f"rule_id string, rule_name string, severity string, file_path string, line_number int, snippet string, description string, fix string, language string, confidence string, evidence {EVIDENCE}"
COLUMNS = [c.split()[0] for c in SCHEMA.replace(EVIDENCE, "struct").split(", ")]
#: The same columns for rows that Arrow batches emit.
ARROW = pa.schema([
    *((c, pa.int32() if c == "line_number" else pa.string()) for c in COLUMNS if c != "evidence"),
    ("evidence", pa.struct([("sink", pa.string()), ("sink_rule", pa.string()), ("taint_sources", pa.list_(pa.string())), ("taint_path", pa.string())])),
])
MARK = "scanlode: ignore"


def no_evidence() -> Column:
    return F.lit(None).cast(EVIDENCE)


def dedup(findings: DataFrame, order: str | None = None) -> DataFrame:
    """One finding per file, line and rule: the first by ``order``, or any where they are alike."""
    keys = ["file_path", "line_number", "rule_id"]
    if order is None:
        return findings.dropDuplicates(keys)
    first = Window.partitionBy(*keys).orderBy(order)
    return findings.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def suppressed(line: Column, rule_id: Column, today: datetime.date, enforce: bool = False) -> Column:
    """Whether a line's own comment silences a rule: ``scanlode: ignore[A,B] reason=... until=YYYY-MM-DD``.

    Without a list it covers every rule; past or invalid dates don't count; with
    ``enforce`` both a reason and a date are needed.
    """
    ids = F.regexp_extract(line, r"scanlode:\s*ignore\[([^\]]+)\]", 1)
    covered = (ids == "") | F.array_contains(F.transform(F.split(ids, ","), lambda x: F.trim(x)), rule_id)
    until = F.regexp_extract(line, r"\buntil\s*=\s*(\d{4}-\d{2}-\d{2})", 1)
    date = F.try_to_date(until, "yyyy-MM-dd")
    alive = (until == "") | F.coalesce(date >= F.lit(today), F.lit(False))
    told = (until != "") & (F.regexp_extract(line, r"\breason\s*=\s*([^\s]+)", 1) != "") if enforce else F.lit(True)
    return F.coalesce(line.contains(MARK) & covered & alive & told, F.lit(False))


def unsuppressed(findings: DataFrame, today: datetime.date, enforce: bool = False, disabled: tuple[str, ...] = ()) -> DataFrame:
    """Drops silenced findings (the snippet is the finding's line) and disabled rules."""
    out = findings.where(~F.col("rule_id").isin(*disabled)) if disabled else findings
    return out.where(~suppressed(F.coalesce(F.col("source_line") if "source_line" in findings.columns else F.col("snippet"), F.lit("")), F.col("rule_id"), today, enforce))


def calibrate(findings: DataFrame) -> DataFrame:
    return findings.withColumn("confidence", C.calibrated())


def thresholds(policy: str = "balanced", severity: str = "LOW", confidence: str = "LOW") -> tuple[str, str]:
    """A policy replaces a threshold that was left at LOW."""
    s, c = POLICIES[policy]
    return (s if severity == "LOW" else severity), (c if confidence == "LOW" else confidence)


def at_least(findings: DataFrame, severity: str = "LOW", confidence: str = "LOW") -> DataFrame:
    """Findings at or above both thresholds; a severity or confidence outside its domain never passes."""
    return findings.where((C.severity_rank(F.col("severity")) <= SEVERITIES[severity]) & (C.confidence_rank(F.col("confidence")) <= CONFIDENCES[confidence]))


def with_fingerprints(findings: DataFrame) -> DataFrame:
    return findings.withColumn("fingerprint", C.fingerprint())


def new_since(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose fingerprint the baseline lacks; Spark broadcasts it only while its size allows."""
    return findings.join(baseline.select("fingerprint").distinct(), "fingerprint", "left_anti")


def baseline_of(findings: DataFrame) -> DataFrame:
    return findings.select("fingerprint").distinct()


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("file_path", "line_number", "rule_id")


def shard(files: DataFrame, index: int, count: int) -> DataFrame:
    """Every ``count``-th file by path order, from ``index``; shards are disjoint and cover all."""
    if not 0 <= index < count:
        raise ValueError("a shard's index must be from 0 to count - 1")
    return placed(files, [], "file_path").where(F.col("_rank") % count == index).select(*files.columns)


def by_severity(findings: DataFrame) -> DataFrame:
    """Counts of every severity, none left out, and their total."""
    domain = findings.sparkSession.createDataFrame([(s,) for s in (*SEVERITIES, "TOTAL")], "severity string")
    counts = findings.where(F.col("severity").isNotNull()).rollup("severity").agg(F.count(F.lit(1)).alias("_n")).select(F.coalesce("severity", F.lit("TOTAL")).alias("severity"), "_n")
    return domain.join(counts, "severity", "left").select("severity", F.coalesce("_n", F.lit(0)).cast("long").alias("n"))


def top_rules(findings: DataFrame, n: int = 5) -> DataFrame:
    """The n rules with most findings; ties by name."""
    return findings.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule_name").limit(n)


def by_file(findings: DataFrame) -> DataFrame:
    """Findings of each file in line order: a file's findings are bounded by its size."""
    one = F.struct("line_number", "rule_id", "severity")
    return findings.groupBy("file_path").agg(F.array_sort(F.collect_list(one)).alias("findings"), F.count(F.lit(1)).alias("n"))


def rule_dictionary(findings: DataFrame) -> DataFrame:
    """The first finding of each rule by file and line, for reports that describe a rule once."""
    first = F.struct("file_path", "line_number", "rule_name", "severity", "description", "fix")
    return findings.groupBy("rule_id").agg(F.min(first).alias("x")).select("rule_id", "x.rule_name", "x.severity", "x.description", "x.fix")
