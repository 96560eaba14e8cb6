"""Cheap tests before patterns leave nothing out, and patterns are tested where Spark compiles them."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions.rules import BUILTIN, FLAGS
from scanlode.operators import one_pass
from scanlode.plans import scan as plan

GAP = "\0"


def skeletons(tree) -> set[str]:
    """Texts like which every match reads, with a NUL for what is not fixed."""
    out = {""}
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            own = {chr(arg).lower()}
        elif name == "AT":
            own = {""}
        elif name == "SUBPATTERN":
            own = skeletons(arg[-1])
        elif name == "BRANCH":
            own = set().union(*map(skeletons, arg[1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] == 1:
            own = {"", *skeletons(arg[2])}
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            own = {x + GAP for x in skeletons(arg[2])}
        else:
            own = {GAP}
        out = {a + b for a, b in product(out, own)}
    return out


def test_every_match_of_a_rule_holds_one_of_its_texts():
    for r in BUILTIN:
        assert r.holds and all(x == x.lower() for x in r.holds), r.rule_id
        assert not [x for x in skeletons(re._parser.parse(FLAGS + r.pattern)) if not any(t in x for t in r.holds)], r.rule_id


def test_texts_are_found_in_any_case(spark):
    files = plan.routed(spark.createDataFrame([("a.java", "x = NEW java.util.RANDOM(1);\n\nMessagedigest.GETINSTANCE(\"md5\")"), ("\u0130.java", "\u0130\u212a new Random(1)"), ("b.java", None)], "file_path string, content string"))
    found = one_pass.native(files).select("file_path", "rule_id", "line_number").collect()
    assert sorted(map(tuple, found)) == [("a.java", "CRY201", 3), ("a.java", "CRY202", 1), ("\u0130.java", "CRY202", 1)]


def test_patterns_are_tested_outside_of_lambda_functions(spark):
    files = plan.routed(spark.createDataFrame([("a.js", "x")], "file_path string, content string"))
    steps = one_pass.native(files)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [s for s in steps if "filter(array(CASE WHEN" in s and "AKIA" in s] and sum(s.count("AKIA[") for s in steps) == 3


def test_lines_of_one_and_of_several_matches(spark):
    rows = spark.createDataFrame([(["a\n\nb", "\n"], ["x"]), (["", "\n\n", "c\n"], ["m\n", "n"]), ([], []), (None, None), (["q"], ["x", "y\n", "z"])], "g array<string>, m array<string>")
    lines = [r[0] for r in rows.select(C.lines_of(F.col("g"), F.col("m"))).collect()]
    assert lines[:4] == [[3], [1, 4], [], None]
