"""Command line: scan, metrics, benchmark, quality-report and deps.

    python -m scanlode.cli scan PATH [--severity HIGH] [--json OUT] [--sarif OUT] ...
"""

from __future__ import annotations

import argparse
import datetime
import hashlib
import json
import os
import shutil
import sys
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlode.functions import rules as R
from scanlode.operators import dependencies, impact, quality, reports
from scanlode.operators import findings as fd
from scanlode.plans import scan as plan
from scanlode.plans.tables import cut
from scanlode.sources import files as src
from scanlode.sources import online, state


def session() -> SparkSession:
    return SparkSession.builder.appName("scanlode").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _ruleset(o: plan.Options) -> str:
    """Name of everything besides a file that decides its findings."""
    told = json.dumps([[r.rule_id, r.severity, r.pattern, r.unless] for r in o.rules] + [o.disabled, o.enforce, str(o.today)], default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:16]


def _chosen(spark: SparkSession, a: argparse.Namespace, o: plan.Options) -> DataFrame:
    listed = src.scannable(spark, a.path)
    if a.changed_only or a.impacted_only:
        changed = src.changed_paths(spark, a.path)
        if a.impacted_only:
            changed = impact.impacted(impact.edges(src.read(listed, a.path).select("file_path", "content")), changed)
        listed = listed.join(changed, "file_path", "left_semi")
    if a.shard_count > 1:
        listed = fd.shard(listed, a.shard_index, a.shard_count)
    return plan.admitted(plan.routed(src.read(listed, a.path)), o.excluded)


def _told(shown: DataFrame, a: argparse.Namespace) -> Iterator[str]:
    """The report on the terminal: for people where one is watching, else plain lines."""
    form = a.format or ("rich" if sys.stdout.isatty() else "plain")
    if form == "rich":
        yield from reports.terminal(shown, a.verbose, color=not os.environ.get("NO_COLOR"), width=shutil.get_terminal_size((100, 24)).columns)
    else:
        yield from reports.plain(shown, a.verbose)
        yield from reports.summary(shown)


def scan(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.changed_only and a.impacted_only:
        raise SystemExit("choose one of --changed-only and --impacted-only")
    if a.shard_count < 1 or not 0 <= a.shard_index < a.shard_count:
        raise SystemExit("--shard-index must be from 0 to --shard-count - 1")
    began, cfg = time.time(), state.load_config(a.path)
    policy = a.policy or cfg.policy
    severity, confidence = fd.thresholds(policy, a.severity or cfg.severity, a.min_confidence or cfg.confidence)
    own = R.from_folder(cfg.custom_rules_dir) if cfg.custom_rules_dir else []
    o = plan.Options(disabled=tuple(cfg.disabled_rules), excluded=tuple(cfg.exclude) + tuple(a.exclude), enforce=a.require_suppression_metadata or cfg.require_suppression_metadata, today=a.today, rules=R.BUILTIN + own)
    files = cut(_chosen(spark, a, o))
    n_files, ruleset = files.count(), _ruleset(o)
    if not n_files:
        print("No files to scan.")
        return 0
    if a.no_cache:
        found = cut(fd.calibrate(fd.unsuppressed(plan.detect(files, o.rules), o.today, o.enforce, o.disabled)))
    else:
        where = a.cache or state.cache_path()
        cache = state.read_cache(spark, where)
        known, fresh = impact.cache_lookup(files, cache, ruleset)
        fresh = cut(fresh)
        new = fd.calibrate(fd.unsuppressed(plan.detect(fresh, o.rules), o.today, o.enforce, o.disabled))
        new = cut(new)
        found = cut(known.unionByName(new))
        # A scan of a part says nothing of the rest.
        gone = None if a.changed_only or a.impacted_only or a.shard_count > 1 else cache.select("file_path").join(files.select("file_path"), "file_path", "left_anti")
        state.merge_cache(impact.cache_table(fresh, new, ruleset), where, gone)
    shown = fd.with_fingerprints(fd.at_least(found, severity, confidence))
    if a.baseline:
        shown = fd.new_since(shown, state.read_baseline(spark, a.baseline))
    shown = cut(shown)
    if a.write_baseline:
        state.write_baseline(shown, a.write_baseline)
    if a.sarif:
        reports.write_sarif(shown, a.sarif)
    if a.json:
        if a.json == "-":
            for r in reports.json_rows(shown).toLocalIterator():
                print(r["value"])
        else:
            reports.write_json(shown, a.json)
    if not (a.sarif or a.json):
        for line in _told(shown, a):
            print(line)
    n = shown.count()
    if a.history:
        row = {"files_scanned": n_files, "findings_total": found.count(), "findings_shown": n, "duration_s": time.time() - began, "severity": severity, "min_confidence": confidence, "policy": policy, "changed_only": a.changed_only}
        state.append_history(spark, a.history, row)
    return 1 if n else 0


def _report(spark: SparkSession, corpus: str, today: datetime.date) -> dict:
    """Quality figures over the labelled cases of a file."""
    cases, thresholds = state.read_cases(spark, corpus)
    files = cases.select(F.concat(F.lit("cases/"), F.sha1("name"), "extension").alias("file_path"), F.col("code").alias("content"), "name")
    found = plan.scan(files.select("file_path", "content"), plan.Options(today=today))
    named = found.join(files.select("file_path", "name"), "file_path").select("name", "rule_id", "confidence")
    predicted = cut(quality.predictions(cases.select("name", "expected_rule", "expect_finding"), named))
    rules = quality.against_thresholds(quality.by_rule(predicted), thresholds)
    return reports.quality_report(quality.overall(predicted).first().asDict(), [r.asDict() for r in rules.collect()], [r.asDict() for r in quality.by_confidence(predicted).collect()])


def metrics(spark: SparkSession, a: argparse.Namespace) -> int:
    """The newest scans of a history, or with ``--rules`` the figures of each rule over labelled cases."""
    if a.rules:
        if not a.corpus:
            raise SystemExit("--rules needs --corpus")
        report = _report(spark, a.corpus, datetime.date.today())
        if a.json:
            print(json.dumps(report, indent=2, sort_keys=True))
        else:
            for rule, x in sorted(report["rules"].items()):
                print(f"{rule}: precision {x['precision']:.3f}, recall {x['recall']:.3f}, F1 {x['f1']:.3f}, reached: {'yes' if x.get('passed', True) else 'no'}")
        return 0
    if not a.history:
        raise SystemExit("name a history, or --rules with --corpus")
    rows = state.read_history(spark, a.history, a.limit)
    shown = reversed([r.asDict() for r in rows.collect()]) if a.limit > 0 else (r.asDict() for r in rows.orderBy("timestamp").toLocalIterator())
    n = 0
    for r in shown:
        n += 1
        print(json.dumps(r) if a.json else f"{r['timestamp']}  files {r['files_scanned']}, findings {r['findings_shown']}, seconds {r['duration_s']}, policy {r['policy'] or 'balanced'}")
    if not n and not a.json:
        print("No scans yet.")
    return 0


def benchmark(spark: SparkSession, a: argparse.Namespace) -> int:
    runs = []
    for i in range(a.warmup + a.runs):
        began = time.time()
        plan.scan(src.source_tree(spark, a.path)).write.format("noop").mode("overwrite").save()
        if i >= a.warmup:
            runs.append((time.time() - began,))
    print(json.dumps(quality.timings(spark.createDataFrame(runs, "seconds double"), "seconds").first().asDict()))
    return 0


def quality_report(spark: SparkSession, a: argparse.Namespace) -> int:
    try:
        before, budget = (json.load(open(a.baseline)), json.load(open(a.budget))) if a.baseline and a.budget else (None, None)
        report = _report(spark, a.corpus, a.today)
    except FileNotFoundError as e:
        print(f"missing file: {e.filename}", file=sys.stderr)
        return 2
    reports.write_quality(report, a.json, a.markdown)
    print(reports.quality_markdown(report))
    bad = [k for k, v in report["rules"].items() if v.get("passed") is False]
    if before is not None:
        bad += budget_violations(report, before, budget)
    for x in bad:
        print(f"violation: {x}", file=sys.stderr)
    return 1 if bad else 0


def budget_violations(now: dict, before: dict, budget: dict) -> list[str]:
    """Global, per-rule and per-confidence figures beyond the budget; what the baseline lacks is skipped."""
    out = []
    for m, sign in (("precision", -1), ("recall", -1), ("false_positive_rate", 1)):
        if m in before.get("global", {}) and sign * (now["global"][m] - before["global"][m]) > budget.get("global", {}).get(m, 0):
            out.append(f"global {m}")
    for rule, old in before.get("rules", {}).items():
        out += [f"{rule} {m}" for m in ("precision", "recall") if rule in now["rules"] and m in old and old[m] - now["rules"][rule][m] > budget.get("rules", {}).get(m, 0)]
    least = budget.get("confidence", {}).get("precision", 0)
    for level, old in before.get("confidence", {}).items():
        if least > 0 and level in now["confidence"] and old["precision"] - now["confidence"][level]["precision"] > least:
            out.append(f"confidence {level}")
    return out


def deps(spark: SparkSession, a: argparse.Namespace) -> int:
    rows = dependencies.dependencies(src.manifests(spark, a.path).select("file_path", "content"))
    failed = 0
    if a.online:
        found, failed = online.vulnerable(rows, online.Service(a.online, a.details or "", timeout=a.timeout))
    else:
        found = dependencies.vulnerable(rows, state.read_advisories(spark, a.advisories))
    found = fd.ordered(fd.at_least(found, a.severity, "LOW"))
    n = 0
    for r in found.select("rule_id", "rule_name", "severity", "file_path", "line_number", "snippet", "fix").toLocalIterator():
        n += 1
        print(json.dumps(r.asDict()) if a.json else f"{r['severity']:<8} {r['file_path']}:{r['line_number']} {r['snippet']} {r['rule_id']} {r['fix']}")
    if failed:
        print(f"warning: the service gave nothing for {failed} packages or advisories", file=sys.stderr)
    return 1 if n else 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scanlode")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("path")
    for flag, more in {
        "--severity": {"choices": ["CRITICAL", "HIGH", "MEDIUM", "LOW"]}, "--min-confidence": {"choices": ["HIGH", "MEDIUM", "LOW"]}, "--policy": {"choices": ["balanced", "strict"]}, "--json": {}, "--sarif": {}, "--baseline": {}, "--write-baseline": {}, "--history": {}, "--cache": {},
        "--exclude": {"action": "append", "default": []}, "--no-cache": {"action": "store_true"}, "--changed-only": {"action": "store_true"}, "--impacted-only": {"action": "store_true"}, "--require-suppression-metadata": {"action": "store_true"}, "--verbose": {"action": "store_true"}, "--format": {"choices": ["rich", "plain"]},
        "--shard-index": {"type": int, "default": 0}, "--shard-count": {"type": int, "default": 1}, "--today": {"type": datetime.date.fromisoformat, "default": datetime.date.today()},
    }.items():
        s.add_argument(flag, **more)
    m = sub.add_parser("metrics")
    m.add_argument("history", nargs="?")
    m.add_argument("--limit", type=int, default=20)
    m.add_argument("--rules", action="store_true")
    m.add_argument("--corpus")
    m.add_argument("--json", action="store_true")
    b = sub.add_parser("benchmark")
    b.add_argument("path")
    b.add_argument("--runs", type=int, default=5)
    b.add_argument("--warmup", type=int, default=1)
    q = sub.add_parser("quality-report")
    q.add_argument("corpus")
    for flag in ("--json", "--markdown", "--baseline", "--budget"):
        q.add_argument(flag)
    q.add_argument("--today", type=datetime.date.fromisoformat, default=datetime.date.today())
    d = sub.add_parser("deps")
    d.add_argument("path")
    where = d.add_mutually_exclusive_group(required=True)
    where.add_argument("--advisories")
    where.add_argument("--online", help="address that packages are posted to")
    d.add_argument("--details", help="address below which an advisory's text is fetched by its id")
    d.add_argument("--timeout", type=float, default=10.0)
    d.add_argument("--severity", default="LOW", choices=["CRITICAL", "HIGH", "MEDIUM", "LOW"])
    d.add_argument("--json", action="store_true")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    run = {"scan": scan, "metrics": metrics, "benchmark": benchmark, "quality-report": quality_report, "deps": deps}[a.command]
    return run(spark or session(), a)


if __name__ == "__main__":
    sys.exit(main())
