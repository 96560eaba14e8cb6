"""State that scans keep between runs: configuration, baselines, histories, caches, labelled cases, advisories."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlode.operators.dependencies import ADVISORY
from scanlode.operators.findings import SCHEMA

CONFIG_NAMES = ("scanlode.yaml", "scanlode.yml", "scanlode.json")
HISTORY = "timestamp string, files_scanned int, findings_total int, findings_shown int, duration_s double, severity string, min_confidence string, policy string, changed_only boolean"
CASES = "name string, detector string, extension string, code string, expect_finding boolean, expected_rule string"


@dataclass
class Config:
    severity: str = "LOW"
    confidence: str = "LOW"
    policy: str = "balanced"
    exclude: list[str] = field(default_factory=list)
    disabled_rules: list[str] = field(default_factory=list)
    custom_rules_dir: str = ""
    require_suppression_metadata: bool = False


def _load(path: Path) -> object:
    text = path.read_text()
    if path.suffix == ".json":
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def load_config(root: str) -> Config:
    """The first configuration file of a folder; defaults if there is none or it can't be read."""
    for name in CONFIG_NAMES:
        path = Path(root) / name
        if path.is_file():
            try:
                data = _load(path)
            except (ValueError, OSError, ImportError) as e:
                del e
                return Config()
            except Exception as e:  # the YAML reader's own errors
                if type(e).__module__.split(".")[0] != "yaml":
                    raise
                return Config()
            known = Config.__dataclass_fields__
            return Config(**{k: v for k, v in data.items() if k in known}) if isinstance(data, dict) else Config()
    return Config()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """fingerprint, from lines as ``write_baseline`` writes them, ``{"fingerprints": [...]}`` or a bare list; empty if missing or damaged.

    The first line that is not empty tells which. Lines are read as lines, however many there are;
    only the forms that hold one list are read in one piece.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], "fingerprint string")
    lines = spark.read.text(path)
    first = lines.where(F.trim("value") != "").head()
    if first is None or first["value"].lstrip().startswith('{"fingerprint":'):
        return lines.select(F.from_json("value", "struct<fingerprint: string>")["fingerprint"].alias("fingerprint")).where("fingerprint IS NOT NULL").distinct()
    listed = F.coalesce(F.from_json("value", "struct<fingerprints: array<string>>")["fingerprints"], F.from_json("value", "array<string>"))
    return spark.read.text(path, wholetext=True).select(F.explode(listed).alias("fingerprint")).where("fingerprint IS NOT NULL").distinct()


def write_baseline(findings: DataFrame, path: str) -> None:
    """Distinct fingerprints in order, one JSON object a line: ranges are written side by side."""
    findings.select("fingerprint").distinct().sort("fingerprint").select(F.to_json(F.struct("fingerprint")).alias("value")).write.mode("overwrite").text(path)


def read_history(spark: SparkSession, path: str, last: int = 0) -> DataFrame:
    """Rows of the history, damaged lines left out; the newest ``last`` if that is positive."""
    if not _exists(spark, path):
        return spark.createDataFrame([], HISTORY)
    rows = spark.read.schema(HISTORY).option("mode", "DROPMALFORMED").json(path).where(F.col("timestamp").isNotNull())
    return rows.orderBy(F.desc("timestamp")).limit(last) if last > 0 else rows


def append_history(spark: SparkSession, path: str, row: dict) -> None:
    spark.createDataFrame([row], HISTORY.replace("timestamp string, ", "")).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), "*").coalesce(1).write.mode("append").json(path)


def cache_path() -> str:
    """Where the cache is kept: a variable's folder, else the first of home, working and temporary folder that can be written."""
    if os.environ.get("SCANLODE_CACHE"):
        return os.environ["SCANLODE_CACHE"]
    for folder in (os.path.expanduser("~"), os.getcwd(), tempfile.gettempdir()):
        if os.path.isdir(folder) and os.access(folder, os.W_OK):
            return os.path.join(folder, ".scanlode", "cache.parquet")
    return os.path.join(tempfile.gettempdir(), ".scanlode", "cache.parquet")


_CACHE = f"file_path string, size long, mtime_ns long, sha256 string, ruleset string, findings array<struct<{SCHEMA}>>"


#: Folders that a cache's rows are dealt to by their path: a merge rewrites those it touches.
BUCKETS = 256


def _dealt(table: DataFrame, buckets: int) -> DataFrame:
    return table.withColumns({"of": F.lit(buckets), "bucket": F.pmod(F.xxhash64("file_path"), F.lit(buckets)).cast("int")})


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache; what is damaged in it is left out and scanned again. A replacement that was interrupted leaves the one before it."""
    for where in (path, path + ".old"):
        if _exists(spark, where):
            return spark.read.schema(f"{_CACHE}, of int, bucket int").option("ignoreCorruptFiles", "true").parquet(where).drop("of", "bucket")
    return spark.createDataFrame([], _CACHE)


def write_cache(table: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replaces the cache: written aside, then the old one steps aside, so one of them is whole at any time."""
    spark = table.sparkSession
    new, now, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path + ".new", path, path + ".old"))
    store = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    _dealt(table, buckets).repartition("bucket").write.mode("overwrite").partitionBy("of", "bucket").parquet(path + ".new")
    store.delete(old, True)
    if store.exists(now):
        store.rename(now, old)
    store.rename(new, now)
    store.delete(old, True)


def merge_cache(scanned: DataFrame, path: str, gone: DataFrame | None = None, buckets: int = BUCKETS) -> list[int]:
    """Rows of ``scanned``, one per file, replace their files' rows or join them; files of ``gone(file_path)`` leave. Returns the buckets that were rewritten.

    Only buckets that hold one of these files are read and written; the others keep their files. New files of a bucket
    are staged and take the old ones' place when all are written: a merge that is interrupted
    leaves a bucket as it was or, at worst, without its rows, whose files are then scanned again.
    """
    from scanlode.plans.tables import cut

    spark = scanned.sparkSession
    new = cut(_dealt(scanned, buckets))  # read three times
    keys = new.select("file_path", "of", "bucket")
    if gone is not None:
        keys = keys.unionByName(_dealt(gone.select("file_path"), buckets))
    keys = cut(keys)
    touched = sorted(r["bucket"] for r in keys.select("bucket").distinct().collect())  # BUCKETS at most
    if not touched:
        return []
    rows = new
    if _exists(spark, path):
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for other in store.listStatus(root):  # rows dealt to another number of buckets can't be found again
            if other.getPath().getName().startswith("of=") and other.getPath().getName() != f"of={buckets}":
                store.delete(other.getPath(), True)
        held = spark.read.schema(f"{_CACHE}, of int, bucket int").option("ignoreCorruptFiles", "true").parquet(path)
        kept = held.where((F.col("of") == buckets) & F.col("bucket").isin(touched)).join(keys.select("file_path"), "file_path", "left_anti")
        rows = new.unionByName(kept)
    rows = cut(rows)
    rows.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("of", "bucket").parquet(path)
    # A bucket that nothing is left of isn't written.
    empty = set(touched) - {r["bucket"] for r in rows.select("bucket").distinct().collect()}
    for bucket in empty:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/of={buckets}/bucket={bucket}")
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return touched


def read_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Labelled cases and per-rule thresholds of a corpus file (YAML or JSON with ``cases`` and ``rule_thresholds``)."""
    data = _load(Path(path))
    cases = [(c["name"], c["detector"], c.get("extension", ".txt"), c["code"], bool(c["expect_finding"]), c.get("expected_rule")) for c in data.get("cases", [])]
    rules = [(k, float(v.get("precision", 0)), float(v.get("recall", 0))) for k, v in data.get("rule_thresholds", {}).items()]
    return spark.createDataFrame(cases, CASES), spark.createDataFrame(rules, "expected_rule string, precision double, recall double")


def write_case_table(cases: DataFrame, path: str) -> None:
    """Labelled cases (columns ``CASES``), one JSON object a line."""
    cases.write.mode("overwrite").json(path)


def read_case_table(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases of JSON lines, of any number; damaged lines are left out."""
    return spark.read.schema(CASES).option("mode", "DROPMALFORMED").json(path).where(F.col("name").isNotNull() & F.col("code").isNotNull())


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisories in the public exchange schema, one JSON object a line, exploded by affected package."""
    nested = "id string, aliases array<string>, summary string, severity array<struct<type: string, score: string>>, affected array<struct<package: struct<ecosystem: string, name: string>, ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string>>>>, versions: array<string>>>"
    rows = spark.read.schema(nested).json(path).select("id", "aliases", "summary", "severity", F.explode("affected").alias("a"))
    own = rows.select("id", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), "aliases", "severity", "summary", F.array(F.struct(F.col("a.ranges").alias("ranges"), F.col("a.versions").alias("versions"))).alias("affected"))
    return own.select(*[x.split()[0] for x in ("id", "ecosystem", "name", "aliases", "severity", "summary", "affected")]).to(spark.createDataFrame([], ADVISORY).schema)
