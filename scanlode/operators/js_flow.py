"""Flow gate of script rules: names that hold request data, and whether a match uses one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions.domains import SCRIPT_CLEANERS, SCRIPT_NAMES, SCRIPT_OBJECTS
from scanlode.functions.rules import BUILTIN, Rule
from scanlode.operators import regex_scan
from scanlode.operators.findings import EVIDENCE

NAME = r"[A-Za-z_$][\w$]*"


def _dotted(name: str) -> str:
    """A dotted name, with white space around its dots."""
    return r"\s*\.\s*".join(name.split("."))


#: Where request data enters: a member of an object that holds it, or a name that stands for it.
SOURCES = rf"\b(?:{'|'.join(SCRIPT_OBJECTS)})\s*\.\s*[A-Za-z_$]|\b(?:{'|'.join(map(_dotted, SCRIPT_NAMES))})\b"
#: Calls that clean what goes through them.
CLEANERS = rf"(?i)\b(?:{'|'.join(map(_dotted, SCRIPT_CLEANERS))})\s*\("
#: A name, its type where one is given, and what it is set to or extended by; no comparison and no arrow.
ASSIGNMENT = rf"^\s*(?:(?:const|let|var)\s+)?({NAME})\s*(?::\s*[\w<>\[\]| ]+?)?\s*\+?=\s*([^\s=>].*)$"


def _names(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NAME), F.lit(0))


def _steps(content: Column) -> Column:
    """Assignments in line order: (name, dirty: its right side reads a source, uses: names on the right side, clean)."""
    parts = F.transform(C.lines(content), lambda x: F.struct(F.regexp_extract(x, ASSIGNMENT, 1).alias("name"), F.regexp_extract(x, ASSIGNMENT, 2).alias("right")))
    return F.transform(
        F.filter(parts, lambda p: p["name"] != ""),
        lambda p: F.struct(p["name"].alias("name"), p["right"].rlike("(?i)" + SOURCES).alias("dirty"), _names(p["right"]).alias("uses"), p["right"].rlike(CLEANERS).alias("clean")),
    )


def tainted(steps: Column) -> Column:
    """Names that hold request data, one pass from the top; names are only ever added."""
    none = F.array().cast("array<string>")
    return F.aggregate(steps, none, lambda acc, s: F.when(s["dirty"] | F.arrays_overlap(s["uses"], acc), F.array_union(acc, F.array(s["name"]))).otherwise(acc))


def cleaned(steps: Column) -> Column:
    return F.transform(F.filter(steps, lambda s: s["clean"]), lambda s: s["name"])


def with_flows(rows: DataFrame, finish: Callable[[DataFrame, Column], DataFrame]) -> DataFrame:
    """Drops gated matches without evidence of a flow; ``finish`` gets the rest and its evidence column."""
    rows = rows.withColumn("line", C.snippet(F.col("content"), F.col("line_number")))
    rows = rows.withColumn("steps", F.when(F.col("gated"), _steps(F.col("content"))))
    source = "(?i)" + SOURCES
    used = F.array_intersect(F.array_union(_names(F.col("text")), _names(F.col("line"))), tainted(F.col("steps")))
    flow = F.struct((F.col("line").rlike(source) | F.col("text").rlike(source)).alias("direct"), used.alias("used"), cleaned(F.col("steps")).alias("cleaned"))
    tested = lambda f: ~F.col("gated") | f["direct"] | ((F.size(f["used"]) > 0) & (F.size(F.array_except(f["used"], f["cleaned"])) > 0))
    # A filter on a column of flows would be pushed down and work out each flow again.
    rows = rows.select("*", F.explode(F.filter(F.array(F.when(F.col("gated"), flow)), tested)).alias("flow"))
    proof = F.when(F.col("flow.direct"), F.array(F.lit("direct_source"))).otherwise(F.array_sort("flow.used"))
    evidence = F.struct(F.lit(None).cast("string").alias("sink"), F.col("rule_id").alias("sink_rule"), proof.alias("taint_sources"), F.concat(F.array_join(proof, ", "), F.lit(" -> "), "rule_id").alias("taint_path")).cast(EVIDENCE)
    return finish(rows, F.when(F.col("gated"), evidence))


def gated(files: DataFrame, rules: list[Rule] = BUILTIN) -> DataFrame:
    """Findings of all rules; gated ones only with evidence of a flow, which they carry."""
    return with_flows(regex_scan.matches(files, rules), regex_scan.as_findings)
