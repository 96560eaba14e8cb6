"""Sinks: JSON, SARIF, terminal text and quality reports."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.operators import findings as fd

SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
#: Level and security severity of a finding's severity: fixed values.
LEVELS = {"CRITICAL": ("error", "9.5"), "HIGH": ("error", "9.0"), "MEDIUM": ("warning", "6.0"), "LOW": ("note", "3.0")}


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object per finding, in order of file, line and rule."""
    return fd.ordered(findings).select(F.to_json(F.struct(*findings.columns), {"ignoreNullFields": "false"}).alias("value"))


DEPENDENCY = ("rule_id", "rule_name", "severity", "file_path", "line_number", "snippet", "fix")


def write_dependencies(findings: DataFrame, path: str) -> None:
    """Findings of dependencies as JSON lines of the columns ``DEPENDENCY``."""
    fd.ordered(findings).select(F.to_json(F.struct(*DEPENDENCY), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_json(findings: DataFrame, path: str) -> None:
    """JSON lines: a list needs all findings in one place, lines do not."""
    json_rows(findings).write.mode("overwrite").text(path)


def sarif_results(findings: DataFrame) -> DataFrame:
    """One SARIF result object per finding."""
    level = F.lit("warning")
    for s, (name, _) in LEVELS.items():
        level = F.when(F.col("severity") == s, name).otherwise(level)
    place = F.struct(F.struct(F.struct(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("uri")).alias("artifactLocation"), F.struct(F.col("line_number").alias("startLine"), F.struct(F.col("snippet").alias("text")).alias("snippet")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("scanlode/v1")).alias("partialFingerprints"))
    return fd.ordered(findings).select(F.to_json(result).alias("value"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """One SARIF rule object per rule, described by its first finding."""
    score = F.lit("6.0")
    for s, (_, x) in LEVELS.items():
        score = F.when(F.col("severity") == s, x).otherwise(score)
    rules = fd.rule_dictionary(findings).orderBy("rule_id")
    text = lambda c: F.struct(c.alias("text"))
    rule = F.struct(F.col("rule_id").alias("id"), F.col("rule_name").alias("name"), text(C.first_sentence(F.col("description"))).alias("shortDescription"), text(F.col("description")).alias("fullDescription"), text(C.first_line(F.col("fix"))).alias("help"), F.struct(score.alias("security-severity")).alias("properties"))
    return rules.select(F.to_json(rule).alias("value"))


def write_sarif(findings: DataFrame, path: str) -> None:
    """One SARIF file, streamed: rules are few, results come to the driver a partition at a time."""
    with open(path, "w", encoding="utf-8") as out:
        rules = [r["value"] for r in sarif_rules(findings).collect()]  # one per rule
        out.write(f'{{"$schema": "{SARIF_SCHEMA}", "version": "2.1.0", "runs": [{{"tool": {{"driver": {{"name": "scanlode", "rules": [{", ".join(rules)}]}}}}, "results": [')
        for i, r in enumerate(sarif_results(findings).toLocalIterator()):
            out.write((", " if i else "") + r["value"])
        out.write("]}]}\n")


def plain(findings: DataFrame, verbose: bool = False) -> Iterator[str]:
    """Lines of a terminal report, grouped by file."""
    last = None
    for r in fd.ordered(findings).toLocalIterator():
        if r["file_path"] != last:
            last = r["file_path"]
            yield f"\n{last}"
        yield f"  {r['line_number']}: [{r['severity']}/{r['confidence']}] {r['rule_id']} {r['rule_name']}"
        yield f"      {r['snippet'].strip()}"
        if verbose:
            yield f"      {r['description']} {r['fix']}"
            if r["evidence"] is not None and r["evidence"]["taint_path"]:
                yield f"      flow: {r['evidence']['taint_path']}"


#: Terminal styles: of severities, and of the parts of a report.
SIGNS = {"CRITICAL": "1;97;41", "HIGH": "1;91", "MEDIUM": "1;93", "LOW": "1;94", "path": "1;96", "title": "1", "dim": "2", "code": "33", "fix": "32", "flow": "35", "good": "1;92"}


def terminal(findings: DataFrame, verbose: bool = False, color: bool = True, width: int = 100) -> Iterator[str]:
    """Lines of a report for people, file by file as findings come in order, a partition at a time; then severities and commonest rules."""

    def say(style: str, text: str) -> str:
        return f"\x1b[{SIGNS[style]}m{text}\x1b[0m" if color else text

    def folded(text: str, first: str = "", style: str = "dim") -> Iterator[str]:
        label = say(style, first)
        for i, line in enumerate(textwrap.wrap(first + " ".join(text.split()), width - 8) or [first]):
            yield "    " + (label + line[len(first) :] if i == 0 and first else say("dim", line) if not first else line)

    last = None
    for r in fd.ordered(findings).toLocalIterator(prefetchPartitions=True):
        if r["file_path"] != last:
            last = r["file_path"]
            yield ""
            yield say("path", last) + " " + say("dim", "─" * max(3, width - len(last) - 1))
        severity = r["severity"] if r["severity"] in SIGNS else "dim"
        yield f"  {say(severity, f' {r['severity']} ')} {say('title', r['rule_name'])} {say('dim', r['rule_id'])}"
        yield "    " + say("dim", f"line {r['line_number']}, confidence {r['confidence']}, {(r['fingerprint'] or '')[:12]}")
        if (code := r["snippet"].strip()) != "":
            yield "    " + say("dim", "│ ") + say("code", code if len(code) <= width - 8 else code[: width - 9] + "…")
        if verbose:
            yield from folded(r["description"] or "")
            if r["evidence"] is not None and r["evidence"]["taint_path"]:
                yield from folded(r["evidence"]["taint_path"], "flow: ", "flow")
            yield from folded(r["fix"] or "", "fix: ", "fix")
        else:
            yield from folded(textwrap.shorten(r["description"] or "No description.", width - 8, placeholder="…"))
            yield from folded((r["fix"] or "").split("\n")[0], "fix: ", "fix")
    yield ""
    if last is None:
        yield say("good", "No findings.")
        return
    counts = [r for r in fd.by_severity(findings).collect() if r["n"]]  # one row per severity
    yield "  ".join(f"{say(r['severity'] if r['severity'] in SIGNS else 'title', r['severity'])} {r['n']}" for r in sorted(counts, key=lambda r: list(fd.SEVERITIES).index(r["severity"]) if r["severity"] in fd.SEVERITIES else 9))
    for r in fd.top_rules(findings).collect():
        yield f"  {r['n']:>6}  {r['rule_name']}"


def summary(findings: DataFrame) -> Iterator[str]:
    yield "Findings: " + ", ".join(f"{r['severity']} {r['n']}" for r in fd.by_severity(findings).collect())
    for r in fd.top_rules(findings).collect():
        yield f"  {r['n']:>6}  {r['rule_name']}"


def quality_report(overall: dict, rules: list[dict], confidence: list[dict]) -> dict:
    return {"global": overall, "rules": {r["expected_rule"]: {k: r[k] for k in ("precision", "recall", "f1", "passed") if k in r} for r in rules}, "confidence": {r["strongest"]: {"precision": r["precision"]} for r in confidence}}


def quality_markdown(report: dict) -> str:
    g = report["global"]
    out = ["# Detection quality", "", "| figure | value |", "|---|---|", *[f"| {k} | {g[k]:.3f} |" for k in ("precision", "recall", "f1", "accuracy", "false_positive_rate")], "", "| rule | precision | recall | reached |", "|---|---|---|---|"]
    out += [f"| {k} | {v['precision']:.3f} | {v['recall']:.3f} | {'yes' if v.get('passed', True) else 'no'} |" for k, v in sorted(report["rules"].items())]
    out += ["", "| confidence | precision |", "|---|---|", *[f"| {k} | {v['precision']:.3f} |" for k, v in sorted(report["confidence"].items())]]
    return "\n".join(out) + "\n"


def write_quality(report: dict, json_path: str | None, markdown_path: str | None) -> None:
    for path, text in ((json_path, json.dumps(report, indent=2, sort_keys=True) + "\n"), (markdown_path, quality_markdown(report))):
        if path:
            with open(path, "w", encoding="utf-8") as f:
                f.write(text)
