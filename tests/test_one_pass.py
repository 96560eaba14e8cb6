"""The two-pass plan finds what the single detectors find."""

from __future__ import annotations

from scanlode.operators import js_flow, line_scan, one_pass, py_ast, secrets
from scanlode.operators.findings import COLUMNS
from scanlode.plans import scan as plan
from scanlode.sources import corpus


def test_same_findings_as_single_detectors(spark):
    rows = [(f"src/{n}/f{k}{e}", c.replace("@K@", str(k))) for n, e, _, c in corpus.TEMPLATES for k in (7, 1234567)]
    rows += [("a.js", None), ("b.env", ""), ("c.sh", "\n\n"), ("d.go", 'password := "SuperSecretPass1"; key := "q8Zr2Lx9Wv4Kt7Yp1Nb6Hc3Jd5Mf0Gs"\n'), (None, "x")]
    files = plan.admitted(plan.routed(spark.createDataFrame(rows, "file_path string, content string"))).cache()
    parts = (js_flow.gated(files), line_scan.shell(files), line_scan.config(files), secrets.secrets(files), py_ast.python_findings(files))
    key = lambda df: sorted(map(repr, df.select(*COLUMNS).collect()))
    assert key(one_pass.detect(files)) == sorted(x for p in parts for x in key(p))


def test_the_plan_reads_files_twice_and_exchanges_only_findings(spark, tmp_path):
    spark.createDataFrame([("a.js", "x")], "file_path string, content string").write.parquet(str(tmp_path / "f"))
    files = plan.admitted(plan.routed(spark.read.parquet(str(tmp_path / "f"))))
    text = one_pass.detect(files)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 2 and text.count("Exchange hashpartitioning") == 1
