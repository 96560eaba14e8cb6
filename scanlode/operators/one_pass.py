"""All detectors in two passes over the files, whatever their number: one in the JVM, one in Arrow batches.

The native pass puts what every detector finds in a row's text into one array
(rule number, number of the match, line, text), filters it there, and explodes it
once, so a file is read and split once and not once per detector. The Arrow pass
does the same for what needs an interpreter: Python syntax trees and JSON.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions.rules import BUILTIN, FAMILY, FLAGS, Rule, for_language
from scanlode.operators import js_flow, line_scan, py_ast, regex_scan, secrets
from scanlode.operators.findings import SCHEMA

PAIR_LANGUAGES = ("env", "ini", "toml", "conf")
ITEM = "array<struct<rule: int, at: int, line: int, text: string>>"
CUT = "array<struct<rule: int, matches: array<string>, gaps: array<string>>>"
CONFIG = (("CFG001", "Credential in a configuration file"), ("CFG003", "Credential in a YAML file"))


def _catalogue(rules: list[Rule]) -> list[tuple]:
    """number, kind, and a finding's fixed columns, of every native rule."""
    out = [("regex", r.rule_id, r.rule_name, r.severity, r.description, r.fix, r.confidence, r.unless, r.gated) for r in rules]
    secret = ("A secret is stored in the text.", "Revoke it and read it from the environment or a secret store.", "HIGH", "", False)
    out += [("secret", i, n, "HIGH", *secret) for i, n, _, _ in secrets.TOKENS]
    out += [("secret", "SEC013", "Credential assigned in source", "HIGH", *secret), ("secret", "SEC014", "High-entropy text", "MEDIUM", *secret)]
    out += [("shell", i, n, s, "Text from a variable is run or split by the shell.", "Quote the variable and avoid evaluating text.", "HIGH", "", False) for i, n, s, _ in line_scan.SHELL]
    out += [("config", i, n, "HIGH", "", "Read it from the environment or a secret store.", "MEDIUM", "", False) for i, n in CONFIG]
    return [(i, *x) for i, x in enumerate(out)]


def _cut(number: int, pattern: str, cheap: Column | None = None) -> Column:
    cell = F.struct(F.lit(number).alias("rule"), F.regexp_extract_all("content", F.lit(pattern), F.lit(0)).alias("matches"), F.split("content", pattern, -1).alias("gaps"))
    found = F.col("content").rlike(pattern)
    return F.when(found if cheap is None else cheap & found, cell)


def _holds(texts: tuple[str, ...]) -> Column:
    """Whether a file holds one of these texts, whatever its case; ``lower`` is its text in lower case."""
    return reduce(or_, (F.col("lower").contains(x) for x in texts))


def _placed(cuts: Column) -> Column:
    """Matches of each rule with their lines; ``cuts``, a column with nulls for rules that don't match, is used twice and so stays a step of its own."""
    one = lambda h: F.transform(F.arrays_zip(h["matches"].alias("text"), C.lines_of(h["gaps"], h["matches"]).alias("line")), lambda x, i: F.struct(h["rule"].alias("rule"), i.alias("at"), x["line"].alias("line"), x["text"].alias("text")))
    return F.when(F.size(cuts) > 0, F.flatten(F.transform(F.array_compact(cuts), one))).otherwise(F.array().cast(ITEM))


def _regex(rules: list[Rule]) -> Column:
    numbers, cuts = {id(r): i for i, r in enumerate(rules)}, F.array().cast(CUT)
    for family in dict.fromkeys(FAMILY.values()):
        cells = [_cut(numbers[id(r)], FLAGS + r.pattern, _holds(r.holds) if r.holds else None) for r in for_language(rules, family)]
        if cells:
            cuts = F.when(F.col("language").isin(*[k for k, v in FAMILY.items() if v == family]), F.array(*cells)).otherwise(cuts)
    return cuts


def _secret_cuts(first: int) -> Column:
    quoted = F.col("content").contains('"') | F.col("content").contains("'")
    named = _holds(secrets.KEY_PARTS)
    rules = [(p, F.col("content").contains(h) if h else named) for _, _, h, p in secrets.TOKENS] + [(secrets.ASSIGNMENT, quoted & named), (secrets.LITERAL, quoted)]
    return F.array(*[_cut(first + i, p, cheap) for i, (p, cheap) in enumerate(rules)])


def _assigned(placed: Column, assignment: int) -> Column:
    return F.filter(placed, lambda x: F.when(x["rule"] == assignment, secrets.is_assigned(x["text"])).otherwise(True))


def _preferred(found: Column, literal: int) -> Column:
    """Secrets of a file; entropy stands back where the line has another, and is worked out elsewhere only."""
    others = F.transform(F.filter(found, lambda y: y["rule"] != literal), lambda y: y["line"])
    return F.filter(found, lambda x: (x["rule"] != literal) | (~F.array_contains(others, x["line"]) & secrets.is_random(x["text"])))


def _by_line(first_shell: int, first_config: int) -> Column:
    """Shell and key-value findings: one rule a line at most."""

    def shell(x: Column) -> Column:
        out = F.lit(None).cast("int")
        for i, (_, _, _, pattern) in reversed(list(enumerate(line_scan.SHELL))):
            out = F.when(x.rlike(pattern), first_shell + i).otherwise(out)
        return F.when(~x.rlike(r"^\s*#"), out)

    def config(number: int):
        return lambda x: F.when(line_scan.holds_credential(C.stripped(x)), number)

    def items(rule) -> Column:
        made = F.transform(C.lines(F.col("content")), lambda x, i: F.struct(rule(x).alias("rule"), F.lit(0).alias("at"), (i + 1).alias("line"), C.stripped(x).alias("text")))
        return F.filter(made, lambda s: s["rule"].isNotNull())

    lang = F.col("language")
    return F.when(lang == "bash", items(shell)).when(lang.isin(*PAIR_LANGUAGES), items(config(first_config))).when(lang == "yaml", items(config(first_config + 1))).otherwise(F.array().cast(ITEM))


def native(files: DataFrame, rules: list[Rule] = BUILTIN, grouped: bool = True) -> DataFrame:
    """Findings of regular-expression rules (gated ones with a flow), secrets, shell and key-value files; one per line and rule if ``grouped``."""
    table = _catalogue(rules)
    at = {k: next(i for i, kind, *_ in table if kind == k) for k in ("secret", "shell", "config")}
    literal = at["shell"] - 1
    # A column that the next step uses twice stays a step of its own, so nothing is matched twice, and rules are tested
    # outside of lambda functions, whose insides are not compiled; empty arrays explode to nothing.
    rows = files.where(F.col("language").isNotNull()).select("file_path", "content", "language", F.lower("content").alias("lower"))
    rows = rows.select("file_path", "content", "language", _regex(rules).alias("regex"), _secret_cuts(at["secret"]).alias("secret"), _by_line(at["shell"], at["config"]).alias("by_line"))
    rows = rows.select("file_path", "content", "language", _placed(F.col("regex")).alias("regex"), _assigned(_placed(F.col("secret")), literal - 1).alias("secret"), "by_line")
    items = F.concat("regex", _preferred(F.col("secret"), literal), "by_line")
    rows = rows.select("file_path", "content", "language", F.explode(items).alias("x")).select("file_path", "content", "language", F.col("x.rule").alias("_rule"), "x.at", F.col("x.line").alias("line_number"), "x.text")
    meta = files.sparkSession.createDataFrame(table, "_number int, kind string, rule_id string, rule_name string, severity string, description string, fix string, confidence string, unless string, gated boolean")
    # One row per rule of the catalogue.
    rows = rows.join(F.broadcast(meta), F.col("_rule") == F.col("_number")).drop("_rule", "_number")
    rows = rows.where((F.col("unless") == "") | ~F.rlike(F.col("text"), F.concat(F.lit(FLAGS), "unless")))
    key = F.concat(F.lit("The key "), F.regexp_extract("text", line_scan.PAIR, 1), F.lit(" holds a credential in plain text."))
    rows = rows.withColumn("description", F.when(F.col("kind") == "config", key).otherwise(F.col("description")))
    return js_flow.with_flows(rows, lambda out, evidence: regex_scan.as_findings(out, evidence, F.when(F.col("kind").isin("shell", "config"), F.col("text")), F.col("kind") == "regex", grouped))


def interpreted(files: DataFrame) -> DataFrame:
    """Findings of Python syntax trees and of JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content, language in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                rows += py_ast.analyse(path, content) if language == "python" else line_scan.json_findings(path, content)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, py_ast.ARROW)

    return files.where(F.col("language").isin("python", "json")).select("file_path", "content", "language").mapInArrow(run, SCHEMA)


def detect(files: DataFrame, rules: list[Rule] = BUILTIN, grouped: bool = True) -> DataFrame:
    """Raw findings of every detector over ``files(file_path, content, language)``; nothing is exchanged without ``grouped``, as a stream needs it."""
    return native(files, rules, grouped).unionByName(interpreted(files))
