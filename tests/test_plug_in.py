"""Own detectors as table functions: options checked when a query is analysed, errors as rows."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scanlode.operators import plug_in
from scanlode.plans import scan as plan
from scanlode.sources.example_detectors import Marks, Strict


class Broken(plug_in.Detector):
    name = "broken"

    def __init__(self, **options):
        raise OSError("no model")

    def detect(self, path, text):
        return []


class Odd(plug_in.Detector):
    name = "odd"

    def detect(self, path, text):
        return [plug_in.Found("O1", 1, severity="AWFUL")]


@pytest.fixture
def files(spark):
    rows = [("a.py", "x = 1\n# TODO a\n# TODO b", "python"), ("b.rb", "puts 1", "ruby"), ("c.sh", "ls\n", "bash"), ("d.md", "TODO", None), ("e.py", None, "python"), ("f.py", "", "python")]
    return spark.createDataFrame(rows, "file_path string, content string, language string")


def test_sql_with_options(spark, files):
    plug_in.register(spark, Marks)
    files.createOrReplaceTempView("own_files")
    got = spark.sql("SELECT f.file_path, d.line_number, d.rule_id FROM own_files f, LATERAL marks(f.file_path, f.content, f.language, word => 'TODO', least_line => 3) d WHERE f.language IS NOT NULL")
    assert [tuple(r) for r in got.collect()] == [("a.py", 3, "OWN2")]


@pytest.mark.parametrize("given", ["wird => 'x'", "word => 1", "least_line => 'x'", "least_line => true", "word => f.content"])
def test_wrong_options_are_errors_of_the_analysis(spark, files, given):
    plug_in.register(spark, Marks)
    files.createOrReplaceTempView("own_files")
    with pytest.raises(AnalysisException, match="marks"):
        spark.sql(f"SELECT d.* FROM own_files f, LATERAL marks(f.file_path, f.content, f.language, {given}) d").schema


def test_errors_are_rows_and_other_files_go_on(files):
    told = plug_in.detect(files, Strict)
    assert [tuple(r) for r in plug_in.errors(told).collect()] == [("b.rb", "RuntimeError: no Ruby here")]
    assert [(r["file_path"], r["rule_id"], r["snippet"]) for r in plug_in.findings(told).collect()] == [("c.sh", "OWN3", "ls")]
    assert sorted(plug_in.errors(plug_in.detect(files, Broken)).select("error").distinct().collect()) == [("OSError: no model",)]
    assert plug_in.errors(plug_in.detect(files, Odd)).count() == 4


def test_quotes_in_options(files):
    assert plug_in.detect(files.withColumn("content", F.lit("it's \\n \"so\"")), Marks, word="it's \\n \"").count() == 5


def test_scan_with_own_detectors(files):
    options = plan.Options(detectors=((Marks, {"word": "TODO"}), (Strict, {})))
    got = plan.scan(files.drop("language"), options).select("file_path", "rule_id", "line_number", "severity", "confidence", F.length("fingerprint")).collect()
    assert sorted(tuple(r) for r in got if r["rule_id"].startswith("OWN")) == [("a.py", "OWN2", 2, "LOW", "MEDIUM", 40), ("a.py", "OWN2", 3, "LOW", "MEDIUM", 40), ("c.sh", "OWN3", 1, "HIGH", "HIGH", 40)]


def test_own_detectors_only_get_their_languages_and_no_batch_a_row(spark):
    files = spark.createDataFrame([("a.sh", "x", "bash"), ("a.go", "x", "go"), ("a.rb", "x", "ruby"), ("a", "x", None)], "file_path string, content string, language string")
    found = plug_in.detect(files, Strict)
    plan = found._jdf.queryExecution().toString()
    assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan
    assert "IN (bash,ruby)" in plan or "IN (ruby,bash)" in plan
    assert sorted((r.file_path, r.rule_id, r.error is None) for r in found.collect()) == [("a.rb", None, False), ("a.sh", "OWN3", True)]
