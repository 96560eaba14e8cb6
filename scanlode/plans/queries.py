"""Registered queries over generated source files and the driver's tables."""

from __future__ import annotations

import datetime
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions import rules as R
from scanlode.operators import dependencies, impact, js_flow, line_scan, one_pass, plug_in, py_ast, quality, regex_scan, reports, secrets
from scanlode.operators import findings as fd
from scanlode.plans import scan as plan
from scanlode.plans.tables import cut, dealt, new_path, spread
from scanlode.sources import corpus, files, state, tree_source
from scanlode.sources.example_detectors import Marks, Strict
from scanlode.sources.manifests import ADVISORIES, BRANCHED, branch_files, manifest_files
from scanlode.streaming import rescan

#: Tests of dates use this day, so results do not depend on when they run.
TODAY = datetime.date(2025, 1, 1)
OWN_PATTERN = r"\b(?:db|conn)\s*\.\s*[a-z]+"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.routed(corpus.source_files(spark, dealt(_table(spark, sf_dir, "orders").select("o_orderkey"))))


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("file_path", "line_number", "rule_id", "severity", "language", "snippet")


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all detectors, silenced ones gone, calibrated, with fingerprints."""
    return fd.with_fingerprints(fd.calibrate(fd.unsuppressed(one_pass.detect(_files(spark, sf_dir)), TODAY)))


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("tier", "language").agg(F.count(F.lit(1)).alias("n"))


def _family(*languages: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _found(regex_scan.scan(_files(spark, sf_dir).where(F.col("language").isin(*languages))))

    return run


def flow_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = js_flow.gated(_files(spark, sf_dir).where(F.col("language").isin("javascript", "typescript")))
    return rows.select("file_path", "line_number", "rule_id", F.coalesce(F.array_join("evidence.taint_sources", ","), F.lit("")).alias("sources"))


def shell_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(line_scan.shell(_files(spark, sf_dir)))


def config_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _files(spark, sf_dir)
    return _found(line_scan.config_pairs(own).unionByName(line_scan.config_yaml(own)))


def config_json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(line_scan.config_json(_files(spark, sf_dir)))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(secrets.secrets(_files(spark, sf_dir)))


def _bits() -> Column:
    """Entropy of an assignment's value, else of the whole match."""
    return F.round(C.entropy(F.when(F.col("rule_id") == "SEC013", F.regexp_extract("text", secrets.VALUE, 1)).otherwise(F.col("text"))), 4).alias("bits")


def document_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every family in prose, with their entropy."""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("file_path"), F.col("text").alias("content"), F.lit("text").alias("language"))
    return secrets.secret_matches(docs).select(F.col("file_path").alias("doc_id"), "rule_id", "line_number", _bits())


def page_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every family in pages, whose quotes are written as character references of any kind."""
    plain = C.unescaped(F.col("html"))
    pages = spread(_table(spark, sf_dir, "pages").select("page_id", "html")).select(F.col("page_id").alias("file_path"), plain.alias("content"), F.lit("html").alias("language"))
    return secrets.secret_matches(pages).select(F.col("file_path").alias("page_id"), "rule_id", "line_number", _bits())


def python_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return py_ast.python_findings(_files(spark, sf_dir)).select("file_path", "line_number", "rule_id", "severity", "confidence", F.array_join("evidence.taint_sources", ",").alias("sources"))


def long_python_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python findings of files of several hundred kilobytes, each put together from thousands of templates."""
    return py_ast.python_findings(corpus.long_python_files(_files(spark, sf_dir))).select("file_path", "line_number", "rule_id", "severity", "confidence")


def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = plan.scan(_files(spark, sf_dir).select("file_path", "content"), plan.Options(today=TODAY))
    return out.select("file_path", "line_number", "rule_id", "severity", "confidence", "language", "snippet", "fingerprint")


def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Script findings whose line silences them or not, with and without the duty to give reason and date."""
    rows = regex_scan.scan(_files(spark, sf_dir).where(F.col("language") == "typescript"))
    line, rule = F.col("snippet"), F.col("rule_id")
    return rows.select("file_path", "line_number", "rule_id", fd.suppressed(line, rule, TODAY).alias("silent"), fd.suppressed(line, rule, TODAY, enforce=True).alias("silent_enforced"))


def confidence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).groupBy("rule_id", "confidence").agg(F.count(F.lit(1)).alias("n"))


def strict_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.at_least(_seen(spark, sf_dir), *fd.thresholds("strict")).select("file_path", "line_number", "rule_id", "severity", "confidence")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).select("file_path", "line_number", "rule_id", "fingerprint")


def new_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that a baseline of every finding on an even line lacks."""
    rows = cut(_seen(spark, sf_dir))  # read twice: once for the baseline
    return fd.new_since(rows, fd.baseline_of(rows.where("line_number % 2 = 0"))).select("file_path", "line_number", "rule_id")


def shard_two_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.shard(_files(spark, sf_dir).select("file_path"), 1, 3)


def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.by_severity(_seen(spark, sf_dir))


def top_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.top_rules(_seen(spark, sf_dir))


def rule_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.rule_dictionary(_seen(spark, sf_dir)).select("rule_id", "rule_name", "severity")


def findings_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fd.by_file(_seen(spark, sf_dir)).select("file_path", "n", F.array_join(F.transform("findings", lambda x: F.concat(x["line_number"].cast("string"), F.lit(":"), x["rule_id"])), " ").alias("listed"))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated modules: each imports the one at half its number."""
    keys = dealt(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")))
    half = F.floor(F.col("k") / 2).cast("string")
    py = F.concat(F.lit("import os\nfrom pkg.m"), half, F.lit(" import f\n"))
    js = F.concat(F.lit("import { f } from './m"), half, F.lit("';\n"))
    even = F.col("k") % 2 == 0
    return keys.select(F.concat(F.lit("pkg/m"), F.col("k").cast("string"), F.when(even, ".py").otherwise(".js")).alias("file_path"), F.when(even, py).otherwise(js).alias("content"))


def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.edges(_modules(spark, sf_dir))


def impacted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a change of m4.py and m3.js reaches through imports."""
    changed = spark.createDataFrame([("pkg/m4.py",), ("pkg/m3.js",)], "file_path string")
    return impact.impacted(impact.edges(_modules(spark, sf_dir)), changed)


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses when every third file has changed since the cache was written."""
    rows = _files(spark, sf_dir).select("file_path", "content", F.length("content").cast("long").alias("size"), F.col("key").alias("mtime_ns"), F.sha2("content", 256).alias("sha256"))
    none = rows.limit(0).select("file_path", F.lit(0).alias("line_number"))
    cache = impact.cache_table(rows, none, "r1")
    stale = F.col("mtime_ns") % 3 == 0
    now = rows.withColumns({"sha256": F.when(stale, F.sha2(F.concat("content", F.lit("x")), 256)).otherwise(F.col("sha256")), "size": F.when(stale, F.col("size") + 1).otherwise(F.col("size"))})
    return impact.cache_counts(now, cache, "r1")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates as labelled cases: one case per file that a scan admits."""
    cases = _files(spark, sf_dir).where(F.col("language").isNotNull()).select(F.col("file_path").alias("name"), F.col("expected").alias("expected_rule"), F.col("expected").isNotNull().alias("expect_finding"))
    return quality.predictions(cases, _seen(spark, sf_dir).select(F.col("file_path").alias("name"), "rule_id", "confidence"))


def quality_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.overall(_predicted(spark, sf_dir))


def quality_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.by_rule(_predicted(spark, sf_dir))


def quality_by_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.by_confidence(_predicted(spark, sf_dir))


def quality_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fell by more than a tenth against a baseline of perfect figures, over event types as made-up rules."""
    now = _table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("expected_rule")).agg((F.count_if(F.col("event_id") % 7 != 0) / F.count(F.lit(1))).alias("precision"), (F.count_if(F.col("event_id") % 11 != 0) / F.count(F.lit(1))).alias("recall"))
    before = now.select("expected_rule", F.lit(1.0).alias("precision"), F.lit(1.0).alias("recall"))
    out = quality.violations(now, before, {"precision": 0.1, "recall": 0.1})
    return out.select("expected_rule", "metric", "before", F.round("now", 6).alias("now"))


def quality_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of all scopes that are further from perfect ones than a budget allows."""
    predicted = cut(_predicted(spark, sf_dir))  # read by three scopes
    now = {"global": quality.overall(predicted), "rules": quality.by_rule(predicted), "confidence": quality.by_confidence(predicted)}
    best = {"precision": F.lit(1.0), "recall": F.lit(1.0), "false_positive_rate": F.lit(0.0)}
    before = {scope: rows.withColumns({m: x for m, x in best.items() if m in rows.columns}) for scope, rows in now.items()}
    budget = {"global": {"precision": 0.001, "recall": 0.001, "false_positive_rate": 0.01}, "rules": {"precision": 0.0, "recall": 0.0}, "confidence": {"precision": 0.01}}
    return quality.budget_violations(now, before, budget).select("scope", "name", "metric", "before", F.round("now", 6).alias("now"))


def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.timings(_table(spark, sf_dir, "events"), "value", ["event_type"])
    return out.select("event_type", "runs", F.round("average", 6).alias("average"), "least", F.round("median", 6).alias("median"), "p95", "most")


def manifest_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dependencies.dependencies(manifest_files(dealt(_table(spark, sf_dir, "part").select("p_partkey"))))


def vulnerable_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dependencies.vulnerable(dependencies.dependencies(manifest_files(dealt(_table(spark, sf_dir, "part").select("p_partkey")))), spark.createDataFrame(ADVISORIES, dependencies.ADVISORY))
    return rows.select("file_path", "line_number", "rule_id", "severity", "snippet", "fix")


def dependency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of vulnerable dependencies, written as JSON lines and read back."""
    path = new_path(spark, "deps")
    found = dependencies.vulnerable(dependencies.dependencies(manifest_files(dealt(_table(spark, sf_dir, "part").select("p_partkey")))), spark.createDataFrame(ADVISORIES, dependencies.ADVISORY))
    reports.write_dependencies(found, path)
    return spark.read.schema("file_path string, line_number int, rule_id string, severity string, snippet string, fix string").json(path)


def advisory_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advisories with several branches, pre-releases, last affected and listed versions, over versions of four ecosystems."""
    found = dependencies.vulnerable(dependencies.dependencies(branch_files(dealt(_table(spark, sf_dir, "part").select("p_partkey")))), spark.createDataFrame(BRANCHED, dependencies.ADVISORY))
    return found.select("file_path", "line_number", "rule_id", "severity", "snippet", "fix")


# Sources and sinks, over a tree and files in the shared folder.


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one generated file per supplier, some in folders that a scan doesn't enter."""
    root = new_path(spark, "tree")
    corpus.write_tree(corpus.source_files(spark, dealt(_table(spark, sf_dir, "supplier").select("s_suppkey")), corpus.FOLDERS), root)
    return root


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree listed, admitted and read."""
    return files.source_tree(spark, _tree(spark, sf_dir)).select("file_path", "size", "sha256")


def _tree_findings(spark: SparkSession, sf_dir: str, options: plan.Options | None = None) -> DataFrame:
    return plan.scan(files.source_tree(spark, _tree(spark, sf_dir)).select("file_path", "content"), options or plan.Options(today=TODAY))


def tree_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole scan of a tree on disk, with rules switched off, paths left out and a stricter policy."""
    options = plan.Options(policy="strict", disabled=("CRY102", "SEC002"), excluded=("src/java_*/**", "*.rake"), today=TODAY)
    return _tree_findings(spark, sf_dir, options).select("file_path", "line_number", "rule_id", "severity", "confidence", "fingerprint")


def tree_source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of a tree read as a data source: folders and files that the filters leave out are not entered or opened."""
    read = tree_source.source_tree(spark, _tree(spark, sf_dir)).where(F.col("file_path").startswith("src/") & ~F.col("file_path").startswith("src/java_") & F.col("suffix").isin(".py", ".js", ".java", ".rb", ".sh") & (F.col("size") < 160))
    return plan.scan(read.select("file_path", "content"), plan.Options(today=TODAY)).select("file_path", "line_number", "rule_id", "severity", "confidence", "fingerprint")


def manifest_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests found by name in a tree, skipped folders included, and their dependencies."""
    root = new_path(spark, "manifests")
    corpus.write_tree(spread(manifest_files(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")))).withColumn("file_path", F.concat(F.lit("node_modules/"), "file_path")), root)
    return dependencies.dependencies(files.manifests(spark, root).select("file_path", "content"))


def baseline_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of a baseline, written and read back."""
    path = new_path(spark, "baseline")
    state.write_baseline(_tree_findings(spark, sf_dir), path)
    return state.read_baseline(spark, path)


def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report, written, read back and parsed."""
    path = new_path(spark, "json")
    found = _tree_findings(spark, sf_dir)
    reports.write_json(found, path)
    return spark.read.schema(found.schema).json(path).select("file_path", "line_number", "rule_id", "rule_name", "severity", "confidence", "language", "snippet", "fingerprint")


def sarif_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The results of a SARIF report, parsed."""
    shape = "ruleId string, level string, locations array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, snippet: struct<text: string>>>>>, partialFingerprints map<string,string>"
    rows = reports.sarif_results(_tree_findings(spark, sf_dir)).select(F.from_json("value", shape).alias("r"))
    place = F.element_at("r.locations", 1)["physicalLocation"]
    return rows.select(F.col("r.ruleId").alias("rule_id"), "r.level", place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("line"), place["region"]["snippet"]["text"].alias("snippet"), F.element_at(F.map_values("r.partialFingerprints"), 1).alias("fingerprint"))


def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of a SARIF report, parsed."""
    rows = reports.sarif_rules(_tree_findings(spark, sf_dir)).select(F.from_json("value", "id string, name string, properties map<string,string>").alias("r"))
    return rows.select(F.col("r.id").alias("rule_id"), F.col("r.name").alias("rule_name"), F.col("r.properties")["security-severity"].alias("score"))


def cache_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings from a cache that was written and read back, for files that have not changed since: those with an even key."""
    path = new_path(spark, "cache")
    read = cut(plan.admitted(plan.routed(files.source_tree(spark, _tree(spark, sf_dir)))))
    state.write_cache(impact.cache_table(read, _calibrated(read), "r1"), path)
    odd = F.regexp_extract("file_path", r"(\d)\.\w+$", 1).cast("int") % 2 == 1
    now = read.withColumns({"sha256": F.when(odd, "changed").otherwise(F.col("sha256")), "mtime_ns": F.col("mtime_ns") + 1})
    hits, _ = impact.cache_lookup(now, state.read_cache(spark, path), "r1")
    return hits.select("file_path", "line_number", "rule_id", "severity", "confidence")


def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in a cache into which a second scan was merged: files with an odd key have a line more on top, and those whose key five divides are gone."""
    path = new_path(spark, "cache")
    read = cut(plan.admitted(plan.routed(files.source_tree(spark, _tree(spark, sf_dir)))))
    state.write_cache(impact.cache_table(read, _calibrated(read), "r1"), path)
    key = F.regexp_extract("file_path", r"(\d+)\.\w+$", 1).cast("long")
    later = read.where((key % 2 == 1) & (key % 5 != 0)).withColumns({"content": F.concat(F.lit("\n"), "content"), "size": F.col("size") + 1, "sha256": F.sha2(F.concat(F.lit("\n"), "content"), 256)})
    state.merge_cache(impact.cache_table(later, _calibrated(later), "r1"), path, read.where(key % 5 == 0))
    return state.read_cache(spark, path).select("size", F.inline("findings")).select("file_path", "size", "line_number", "rule_id", "confidence")


def _calibrated(read: DataFrame) -> DataFrame:
    return fd.calibrate(fd.unsuppressed(one_pass.detect(read), TODAY))


def history_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two of three rows appended to a history."""
    path = new_path(spark, "history")
    for name in ("region", "nation", "supplier"):
        n = _table(spark, sf_dir, name).count()
        state.append_history(spark, path, {"files_scanned": n, "findings_total": 2 * n, "findings_shown": n, "duration_s": 0.5, "severity": "LOW", "min_confidence": "LOW", "policy": "balanced", "changed_only": False})
    return state.read_history(spark, path, 2).select("files_scanned", "findings_total", "findings_shown", "policy")


def rescan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings opened and closed by two runs of one stream: of the files' first versions, and of what changed since (a third has a line on top, a third is gone)."""
    folder, out, checkpoint = (new_path(spark, x) for x in ("versions", "changes", "rescan"))
    first = corpus.source_files(spark, dealt(_table(spark, sf_dir, "customer").select("c_custkey"))).withColumn("ts", F.lit("2025-01-01").cast("timestamp"))
    later = F.when(F.col("key") % 3 == 0, F.concat(F.lit("\n"), "content"))
    second = first.where("key % 3 < 2").select("file_path", later.alias("content"), F.lit("2025-01-02").cast("timestamp").alias("ts"))
    for i, files in enumerate((first.select("file_path", "content", "ts"), second)):
        files.write.parquet(f"{folder}/{i}")
        rescan.start(rescan.versions(spark, f"{folder}/*"), out, checkpoint, TODAY).awaitTermination()
    return spark.read.parquet(out).select("file_path", "change", "rule_id", "line_number", "severity")


def own_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of rules from a folder, over the generated files."""
    with tempfile.TemporaryDirectory() as folder:
        with open(f"{folder}/own.json", "w") as f:
            json.dump({"rules": [{"id": "OWN1", "name": "Use of a database handle", "severity": "low", "languages": ["javascript", "go"], "pattern": {"regex": OWN_PATTERN}}, {"id": "BAD", "pattern": "("}]}, f)
        own = R.from_folder(folder)
    return _found(regex_scan.scan(_files(spark, sf_dir), own))


def own_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two detectors of a user's own report as table functions, one of which fails on some files."""
    own = _files(spark, sf_dir)
    rows = plug_in.detect(own, Marks, word="SELECT", least_line=2).unionByName(plug_in.detect(own, Strict))
    return rows.select("file_path", "line_number", "rule_id", "severity", "error")


def labelled_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of each rule over a table of labelled cases, one per part, written and read back, and whether they reach its thresholds."""
    made = corpus.source_files(spark, dealt(_table(spark, sf_dir, "part").select("p_partkey")))
    path = new_path(spark, "cases")
    case = made.select(F.concat_ws("_", "template", "key").alias("name"), F.lit("any").alias("detector"), F.concat(F.lit("."), F.substring_index("file_path", ".", -1)).alias("extension"), F.col("content").alias("code"), F.col("expected").isNotNull().alias("expect_finding"), F.col("expected").alias("expected_rule"))
    state.write_case_table(case, path)
    rows = state.read_case_table(spark, path)
    thresholds = spark.createDataFrame([(x, 1.0, 1.0) for x in sorted({x for _, _, x, _ in corpus.TEMPLATES if x})], "expected_rule string, precision double, recall double")
    code = rows.select(F.concat(F.lit("cases/"), "name", "extension").alias("file_path"), F.col("code").alias("content"), "name")
    found = plan.scan(code.select("file_path", "content"), plan.Options(today=TODAY)).join(code.select("file_path", "name"), "file_path")
    predicted = quality.predictions(rows.select("name", "expected_rule", "expect_finding"), found.select("name", "rule_id", "confidence"))
    return quality.against_thresholds(quality.by_rule(predicted), thresholds).select("expected_rule", "tp", "fp", "fn", "passed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        route_counts, flow_gate, shell_scan, config_scan, config_json_scan, secret_scan, document_secrets, page_secrets, python_scan, long_python_scan, full_scan, suppression, confidence_counts, strict_policy, fingerprints, new_findings,
        shard_two_of_three, severity_summary, top_rules, rule_dictionary, findings_by_file, import_edges, impacted_files, cache_hits, quality_overall, quality_by_rule, quality_by_confidence, quality_violations, quality_budgets, timing_summary,
        manifest_dependencies, vulnerable_dependencies, dependency_report, advisory_ranges, tree_files, tree_scan, tree_source_scan, manifest_tree, baseline_file, json_report, sarif_report, sarif_rules, cache_file, cache_merge, history_file, rescan_changes, own_rules, own_detectors, labelled_cases,
    )
    families = {"script_rules": ("javascript", "typescript"), "java_rules": ("java", "kotlin"), "php_rules": ("php",), "ruby_rules": ("ruby",), "go_rules": ("go",)}
    return {name: _family(*langs) for name, langs in families.items()} | {f.__name__: f for f in own}
