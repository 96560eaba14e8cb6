"""Regular-expression rules over whole files, matches across lines included.

One pass over the files: a file's language picks its rules, each rule that occurs at
all splits the text at its matches, and a match's line is one more than the line
feeds before it. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions.rules import BUILTIN, FAMILY, FLAGS, REPEATING, Rule, for_language
from scanlode.operators.findings import COLUMNS, no_evidence

HIT = "array<struct<rule: int, matches: array<string>, gaps: array<string>>>"


def _hits(rules: list[tuple[int, Rule]]) -> Column:
    """Rules of one language that match: the catalogue number, all matches and the text between them."""
    cells = []
    for i, r in rules:
        p = F.lit(FLAGS + r.pattern)
        cell = F.struct(F.lit(i).alias("rule"), F.regexp_extract_all("content", p, F.lit(0)).alias("matches"), F.split("content", FLAGS + r.pattern, -1).alias("gaps"))
        cells.append(F.when(F.col("content").rlike(FLAGS + r.pattern), cell))
    return F.array_compact(F.array(*cells)) if cells else F.lit(None).cast(HIT)


def matches(files: DataFrame, rules: list[Rule] = BUILTIN) -> DataFrame:
    """``files(file_path, content, language)`` to a row per match, with its rule's columns, ``at`` (its number) and ``text``."""
    numbered = list(enumerate(rules))
    hits = F.lit(None)
    for family in dict.fromkeys(FAMILY.values()):
        own = {id(r) for r in for_language(rules, family)}
        hits = F.when(F.col("language").isin(*[k for k, v in FAMILY.items() if v == family]), _hits([(i, r) for i, r in numbered if id(r) in own])).otherwise(hits)
    # Exploded where it is made, so that no test of it is pushed down and everything matched twice; no rules, no rows.
    rows = files.where(F.col("language").isin(*FAMILY)).select("file_path", "content", "language", F.explode(F.coalesce(hits, F.lit(None).cast(HIT))).alias("hit"))
    rows = rows.select("file_path", "content", "language", F.col("hit.rule").alias("_rule"), F.posexplode(F.arrays_zip(F.col("hit.matches").alias("text"), C.lines_of(F.col("hit.gaps"), F.col("hit.matches")).alias("line"))).alias("at", "x"))
    rows = rows.select("file_path", "content", "language", "at", "x.text", F.col("x.line").alias("line_number"), "_rule")
    meta = files.sparkSession.createDataFrame([(i, r.rule_id, r.rule_name, r.severity, r.description, r.fix, r.confidence, r.unless, r.gated) for i, r in numbered], "_number int, rule_id string, rule_name string, severity string, description string, fix string, confidence string, unless string, gated boolean")
    # One row per rule of the catalogue.
    rows = rows.join(F.broadcast(meta), F.col("_rule") == F.col("_number")).drop("_rule", "_number")
    return rows.where((F.col("unless") == "") | ~F.rlike(F.col("text"), F.concat(F.lit(FLAGS), "unless")))


def as_findings(rows: DataFrame, evidence: Column | None = None, snippet: Column | None = None, repeats: Column | None = None, grouped: bool = True) -> DataFrame:
    """Rows of ``matches`` as findings; one per line and rule, but for languages that report every match.

    ``snippet`` replaces the match's line where it is not null; ``repeats`` says which rows such languages may report again.

    A file's rows leave one task together, so the aggregate only exchanges what is found. Without ``grouped`` there
    is none, and a line may report a rule several times, each time alike.
    """
    label = F.when((F.col("language") == "kotlin") & (F.lit(True) if repeats is None else repeats), "java").otherwise(F.col("language"))
    again = F.col("language").isin(*REPEATING) & (F.lit(True) if repeats is None else repeats)
    line = F.col("line") if "line" in rows.columns else C.snippet(F.col("content"), F.col("line_number"))
    out = rows.withColumn("turn", F.when(again, F.col("at")).otherwise(-1)).withColumn("snippet", line if snippet is None else F.coalesce(snippet, line)).withColumn("evidence", no_evidence() if evidence is None else evidence)
    out = out.withColumn("language", label)
    if not grouped:
        return out.select(*COLUMNS)
    keys = ["file_path", "line_number", "rule_id"]
    rest = [c for c in COLUMNS if c not in keys]
    return out.groupBy(*keys, "turn").agg(F.min_by(F.struct(*rest), "at").alias("x")).select(*keys, *[f"x.{c}" for c in rest]).select(*COLUMNS)


def scan(files: DataFrame, rules: list[Rule] = BUILTIN) -> DataFrame:
    """Findings of every rule without its flow gate (see ``js_flow`` for the gate)."""
    return as_findings(matches(files, rules))
