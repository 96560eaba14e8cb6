"""Finding rows, impact, cache, dependencies, quality, sources, reports, streaming and the command line."""

from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from scanlode import cli
from scanlode.operators import dependencies, impact, quality, regex_scan, reports
from scanlode.operators import findings as fd
from scanlode.plans import scan as plan
from scanlode.sources import files as src
from scanlode.sources import state
from scanlode.streaming import scan_stream


def rows_of(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_entry_has_rows_and_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["file_path", "line_number", "rule_id"] and df.limit(1).count() == 1


def test_shards_are_disjoint_and_cover_all(spark):
    files = spark.range(101).select(F.concat(F.lit("f"), "id").alias("file_path"))
    got = [{r[0] for r in fd.shard(files, i, 4).collect()} for i in range(4)]
    assert sum(map(len, got)) == 101 and len(set().union(*got)) == 101 and max(map(len, got)) - min(map(len, got)) <= 1


def test_import_graph_and_impact_with_a_cycle(spark):
    files = spark.createDataFrame(
        [("pkg/a.py", "from pkg.b import x\nimport os, pkg.c"), ("pkg/b.py", "from .c import y"), ("pkg/c.py", "import pkg.a"), ("pkg/d.py", ""), ("web/x.js", "import y from './y'\nconst z = require('../lib');"), ("web/y.ts", ""), ("lib/index.js", "")],
        "file_path string, content string",
    )
    graph = impact.edges(files)
    assert rows_of(graph, "src", "dst") == [("pkg/a.py", "pkg/b.py"), ("pkg/a.py", "pkg/c.py"), ("pkg/b.py", "pkg/c.py"), ("pkg/c.py", "pkg/a.py"), ("web/x.js", "lib/index.js"), ("web/x.js", "web/y.ts")]
    changed = spark.createDataFrame([("pkg/b.py",), ("web/y.ts",)], "file_path string")
    assert rows_of(impact.impacted(graph, changed), "file_path") == [("pkg/a.py",), ("pkg/b.py",), ("pkg/c.py",), ("web/x.js",), ("web/y.ts",)]


def test_impact_finds_the_edges_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        seen.add(1)
        yield from batches

    graph = spark.createDataFrame([(f"m{i + 1}", f"m{i}") for i in range(4)], "src string, dst string").coalesce(1).mapInArrow(count, "src string, dst string")
    reached = impact.impacted(graph, spark.createDataFrame([("m1",)], "file_path string"))
    assert rows_of(reached, "file_path") == [("m1",), ("m2",), ("m3",), ("m4",)] and reached.columns == ["file_path"]
    assert seen.value == 1
    with pytest.raises(RuntimeError, match="deeper"):
        impact.impacted(graph, spark.createDataFrame([("m0",)], "file_path string"), most_rounds=3)


def test_manifests(spark):
    files = spark.createDataFrame(
        [("requirements.txt", "a==1.2\nb>=2.0,<3\n# c\n-r x\nd\nE[x]==1\n"), ("w/package.json", '{"dependencies": {"q": "^1.2.3"}, "peerDependencies": {"r": ">=4 <5"}}'), ("bad/package.json", "{"), ("go.mod", "require (\n\tx/y v1.0.0\n)\nrequire z/w v2.1.0\n"), ("Gemfile.lock", "GEM\n  specs:\n    rake (13.0)\n      dep (1.0)\nPLATFORMS\n    no (1)\n"), ("other.txt", "a==1")],
        "file_path string, content string",
    )
    got = rows_of(dependencies.dependencies(files), "ecosystem", "name", "version", "line")
    assert got == [("Go", "x/y", "1.0.0", 2), ("Go", "z/w", "2.1.0", 4), ("PyPI", "a", "1.2", 1), ("PyPI", "b", "2.0", 2), ("PyPI", "d", "", 5), ("RubyGems", "rake", "13.0", 3), ("npm", "q", "1.2.3", 1), ("npm", "r", "=4", 1)]


def test_large_manifests(spark):
    gems = "GEM\n  specs:\n" + "".join(f"    gem{i:05} (1.{i}.0)\n      dep (>= 1)\n" for i in range(20_000)) + "\nPLATFORMS\n  ruby\n"
    mods = "module m\nrequire (\n" + "".join(f"\tx.y/m{i:05} v1.{i}.0 // indirect\n\t// note here\n" for i in range(5000)) + ")\nrequire z/w v2.0.0\n"
    pins = "".join(f"pkg{i:05}==1.{i}\n" for i in range(5000))
    files = spark.createDataFrame([("Gemfile.lock", gems), ("go.mod", mods), ("requirements.txt", pins), ("a/Gemfile.lock", "PATH\n  x\n\nGEM\n\n  specs:\n    a-b (2)\nGEM\n    c (3)\n"), ("b/go.mod", None), ("b/package.json", "[]")], "file_path string, content string")
    got = dependencies.dependencies(files)
    assert {r["file_path"]: r["n"] for r in got.groupBy("file_path").agg(F.count("*").alias("n")).collect()} == {"Gemfile.lock": 20_000, "go.mod": 5001, "requirements.txt": 5000, "a/Gemfile.lock": 2}
    assert rows_of(got.where("name IN ('gem19999', 'x.y/m04999', 'pkg04999')"), "version", "line") == [("1.19999.0", 40_001), ("1.4999", 5000), ("1.4999.0", 10_001)]


def test_imports_without_end(spark):
    files = spark.createDataFrame([("a.py", "import " + ", ".join(["b"] * 50_000) + "\nimport c as d, e # f\n"), ("b.py", ""), ("c.py", ""), ("e.py", ""), ("f.py", "")], "file_path string, content string")
    assert rows_of(impact.edges(files), "src", "dst") == [("a.py", "b.py"), ("a.py", "c.py"), ("a.py", "e.py")]


def test_lines_of_many_matches(spark):
    text = "Math.random()\n" * 20_000
    got = [r["line_number"] for r in regex_scan.matches(spark.createDataFrame([("a.js", text, "javascript")], "file_path string, content string, language string")).collect()]
    assert got == list(range(1, 20_001))


def test_quality_figures(spark):
    cases = spark.createDataFrame([("a", "R1", True), ("b", "R1", False), ("c", None, False), ("d", "R2", True), ("e", None, True)], "name string, expected_rule string, expect_finding boolean")
    found = spark.createDataFrame([("a", "R1", "LOW"), ("a", "R1", "HIGH"), ("b", "R1", "MEDIUM"), ("d", "R9", "HIGH"), ("e", "R7", "HIGH")], "name string, rule_id string, confidence string")
    p = quality.predictions(cases, found)
    r = quality.overall(p).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (2, 1, 1, 1) and abs(r["f1"] - 2 / 3) < 1e-9 and r["accuracy"] == 3 / 5 and r["false_positive_rate"] == 1 / 2
    assert rows_of(quality.by_confidence(p), "strongest", "tp", "fp") == [("HIGH", 2, 0), ("MEDIUM", 0, 1)]
    assert quality.overall(p.limit(0)).first()["precision"] == 0


def test_timings_of_even_and_odd_counts(spark):
    for values in ([5.0], [1.0, 2.0, 3.0, 4.0], list(map(float, range(21)))):
        r = quality.timings(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
        s = sorted(values)
        assert r["p95"] == s[round((len(s) - 1) * 0.95)] and r["median"] == (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2


def test_timings_by_group_with_ties_and_nulls(spark):
    rows = [("a", float(i % 7)) for i in range(500)] + [("b", 2.0)] * 300 + [("c", None), (None, 1.0), (None, 3.0)]
    got = {r["g"]: r for r in quality.timings(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g in got:
        s = sorted(v for k, v in rows if k == g)
        assert (got[g]["runs"], got[g]["p95"], got[g]["median"], got[g]["least"], got[g]["most"]) == (len(s), s[round((len(s) - 1) * 0.95)], (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2, s[0], s[-1])


def test_listing_by_tasks_and_by_address(spark, tmp_path, monkeypatch):
    for i in range(30):
        (tmp_path / f"d{i % 5}/e{i}").mkdir(parents=True)
        (tmp_path / f"d{i % 5}/e{i}/f.py").write_text("x = 1\n")
    want = rows_of(src.source_tree(spark, str(tmp_path)), "file_path", "size")
    assert len(want) == 30
    monkeypatch.setattr(src, "SPREAD", 4)
    assert rows_of(src.source_tree(spark, str(tmp_path)), "file_path", "size") == want == rows_of(src.source_tree(spark, tmp_path.as_uri()), "file_path", "size")
    assert rows_of(src.source_tree(spark, str(tmp_path / "d0/e0/f.py")), "file_path", "size") == [("f.py", 6)]


def test_manifests_of_any_size(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/requirements.txt").write_text("# " + "x" * (9 << 20) + "\na==1\n")
    assert rows_of(dependencies.dependencies(src.manifests(spark, str(tmp_path)).select("file_path", "content")), "name", "line") == [("a", 2)]


def test_source_tree(spark, tmp_path):
    for name, text in {"a.py": b"x=1", ".env": b"K=v", "pkg/__init__.py": b"", "node_modules/b.js": b"x", ".hidden/c.js": b"x", "big.js": b"x" * (513 * 1024), "Dockerfile": b"FROM x", "d.md": b"x", "bad.js": b"\xff\xfe"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text)
    (tmp_path / ".envrc").write_bytes(b"a\0b")
    assert rows_of(src.source_tree(spark, str(tmp_path)), "file_path") == [(".env",), ("Dockerfile",), ("a.py",), ("bad.js",), ("pkg/__init__.py",)]


def test_command_line_scan_baseline_cache_and_sarif(spark, tmp_path):
    tree = tmp_path / "t"
    tree.mkdir()
    (tree / "a.js").write_text("const n = Math.random();\ncrypto.createHash('md5');\n")
    cache, base, sarif = str(tmp_path / "cache"), str(tmp_path / "base"), str(tmp_path / "o.sarif")
    assert cli.main(["scan", str(tree), "--cache", cache, "--write-baseline", base, "--sarif", sarif], spark) == 1
    report = json.load(open(sarif))
    run = report["runs"][0]
    assert {r["id"] for r in run["tool"]["driver"]["rules"]} == {"CRY101", "CRY102"} and len(run["results"]) == 2
    assert all(len(r["partialFingerprints"]["scanlode/v1"]) == 40 for r in run["results"])
    assert cli.main(["scan", str(tree), "--cache", cache, "--baseline", base], spark) == 0
    (tree / "b.rb").write_text("User.create(params)\n")
    assert cli.main(["scan", str(tree), "--cache", cache, "--baseline", base], spark) == 1
    assert cli.main(["scan", str(tmp_path / "none"), "--no-cache"], spark) == 0


def test_changed_and_impacted_files(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init")
    for n, t in {"a.py": "import b\n", "b.py": "x = 1\n", "c.py": "y = 1\n"}.items():
        (tmp_path / n).write_text(t)
    git("add", "-A")
    git("commit", "-m", "x")
    (tmp_path / "b.py").write_text("x = 2\n")
    (tmp_path / "new.js").write_text("1")
    changed = src.changed_paths(spark, str(tmp_path))
    assert rows_of(changed, "file_path") == [("b.py",), ("new.js",)]
    assert rows_of(impact.impacted(impact.edges(src.source_tree(spark, str(tmp_path))), changed), "file_path") == [("a.py",), ("b.py",), ("new.js",)]
    assert src.changed_paths(spark, str(tmp_path / "nowhere")).count() == 0


def test_cache_survives_damage_and_interruption(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    files = spark.createDataFrame([("a.rb", "x.send(params[:m])\n", 1, 1, "s")], "file_path string, content string, size long, mtime_ns long, sha256 string")
    found = fd.calibrate(plan.detect(plan.routed(files)))
    for _ in range(2):
        state.write_cache(impact.cache_table(files, found, "r"), path)
    assert state.read_cache(spark, path).count() == 1
    (tmp_path / "cache").rename(tmp_path / "cache.old")
    assert state.read_cache(spark, path).count() == 1
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache/part-0.parquet").write_bytes(b"PAR1 nonsense")
    hits, misses = impact.cache_lookup(files, state.read_cache(spark, path), "r")
    assert (hits.count(), misses.count()) == (0, 1)
    monkeypatch.setenv("HOME", str(tmp_path / "nowhere"))
    monkeypatch.chdir(tmp_path)
    assert state.cache_path() == str(tmp_path / ".scanlode/cache.parquet")


def test_metrics_command(spark, tmp_path, capsys):
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.json").write_text("".join(json.dumps({"timestamp": f"2024-01-{d:02}", "files_scanned": d, "findings_shown": 1, "duration_s": 0.5}) + "\n" for d in range(1, 29)))
    assert cli.main(["metrics", str(tmp_path / "h")], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 20 and out[0].startswith("2024-01-09") and out[-1].startswith("2024-01-28")
    cli.main(["metrics", str(tmp_path / "h"), "--limit", "1", "--json"], spark)
    assert json.loads(capsys.readouterr().out)["files_scanned"] == 28
    (tmp_path / "c.json").write_text(json.dumps({"rule_thresholds": {"CRY102": {"precision": 1.0, "recall": 1.0}}, "cases": [{"name": "p", "detector": "javascript", "extension": ".js", "code": "Math.random()", "expect_finding": True, "expected_rule": "CRY102"}]}))
    cli.main(["metrics", "--rules", "--corpus", str(tmp_path / "c.json")], spark)
    assert capsys.readouterr().out.startswith("CRY102: precision 1.000")


def test_replayed_batches_do_not_repeat_findings(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("a.sh", 'eval "$X"\n')], "file_path string, content string").withColumn("ts", F.lit("2025-01-01").cast("timestamp")).write.parquet(folder)
    for k in range(2):  # a fresh checkpoint replays batch 0
        scan_stream.scan_batches(scan_stream.arrivals(spark, folder), out, str(tmp_path / f"c{k}")).awaitTermination(60)
    assert rows_of(spark.read.parquet(out), "file_path", "rule_id") == [("a.sh", "SH001")]


def test_state_survives_damage(spark, tmp_path):
    assert state.read_baseline(spark, str(tmp_path / "no")).count() == 0
    (tmp_path / "bare.json").write_text('["x", "y", "x"]')
    (tmp_path / "bad.json").write_text("{")
    assert rows_of(state.read_baseline(spark, str(tmp_path / "bare.json")), "fingerprint") == [("x",), ("y",)]
    assert state.read_baseline(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.json").write_text('{"timestamp": "2024-01-01", "files_scanned": 1}\nnonsense\n{"timestamp": "2024-01-02"}\n')
    assert rows_of(state.read_history(spark, str(tmp_path / "h"), 1), "timestamp") == [("2024-01-02",)]
    (tmp_path / "scanlode.json").write_text("{")
    assert state.load_config(str(tmp_path)) == state.Config()


def test_quality_report_command(spark, tmp_path):
    corpus = {"rule_thresholds": {"CRY102": {"precision": 1.0, "recall": 1.0}}, "cases": [{"name": "p", "detector": "javascript", "extension": ".js", "code": "Math.random()", "expect_finding": True, "expected_rule": "CRY102"}, {"name": "n", "detector": "javascript", "extension": ".js", "code": "1", "expect_finding": False, "expected_rule": "CRY102"}]}
    (tmp_path / "c.json").write_text(json.dumps(corpus))
    assert cli.main(["quality-report", str(tmp_path / "c.json"), "--json", str(tmp_path / "q.json")], spark) == 0
    now = json.load(open(tmp_path / "q.json"))
    assert now["global"]["precision"] == 1 and now["rules"]["CRY102"]["passed"]
    worse = json.loads(json.dumps(now))
    worse["global"]["recall"] = 0.5
    assert cli.budget_violations(worse, now, {}) == ["global recall"]
    assert cli.main(["quality-report", str(tmp_path / "none.json")], spark) == 2


def test_deps_command(spark, tmp_path):
    (tmp_path / "requirements.txt").write_text("requests==2.0.0\n")
    adv = {"id": "G-1", "summary": "s", "aliases": ["CVE-1"], "severity": [{"type": "S", "score": "9.8"}], "affected": [{"package": {"ecosystem": "PyPI", "name": "requests"}, "ranges": [{"events": [{"introduced": "0"}, {"fixed": "2.20.0"}]}]}]}
    (tmp_path / "adv.json").write_text(json.dumps(adv))
    assert cli.main(["deps", str(tmp_path), "--advisories", str(tmp_path / "adv.json"), "--severity", "CRITICAL"], spark) == 1
    (tmp_path / "requirements.txt").write_text("requests==2.31.0\n")
    assert cli.main(["deps", str(tmp_path), "--advisories", str(tmp_path / "adv.json")], spark) == 0


def test_stream_reports_a_finding_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a.sh", 'eval "$X"\n'), ("a.sh", 'eval "$X"\n'), ("b.sh", "echo 1\n"), ("c.py", "import pickle\npickle.loads(b)\n"), ("d.js", "Math.random(); Math.random();\n"), ("e.json", '{"password": "hunter2hunter2"}\n'), ("f.env", "DB_PASSWORD=s3cr3tvalue\n")]
    spark.createDataFrame(rows, "file_path string, content string").withColumn("ts", F.lit("2025-01-01").cast("timestamp")).write.parquet(folder)
    q = scan_stream.stream_findings(scan_stream.arrivals(spark, folder)).writeStream.format("memory").queryName("stream_found").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = rows_of(spark.table("stream_found"), "file_path", "rule_id")
    assert [x for x in got if x[0] < "e"] == [("a.sh", "SH001"), ("c.py", "DSER001"), ("d.js", "CRY102")] and {("e.json", "CFG002"), ("f.env", "CFG001")} <= set(got)


def test_json_sink_and_text(spark, tmp_path):
    df = plan.scan(spark.createDataFrame([("a.rb", "x.send(params[:m])\n")], "file_path string, content string"))
    reports.write_json(df, str(tmp_path / "j"))
    (r,) = [json.loads(x["value"]) for x in spark.read.text(str(tmp_path / "j")).collect()]
    assert r["rule_id"] == "DYN401" and len(r["fingerprint"]) == 40 and set(fd.COLUMNS) <= set(r)
    assert any("DYN401" in x for x in reports.plain(df, verbose=True)) and "HIGH 1" in next(reports.summary(df))


def test_json_keys_are_found_in_one_walk():
    import time

    from scanlode.operators import line_scan

    text = json.dumps({f"k{i}": {f"token_{i}": "valuevalue"} for i in range(8000)}, indent=1)
    began = time.time()
    got = line_scan.json_findings("a.json", text)
    lines = text.split("\n")
    assert time.time() - began < 5 and len(got) == 8000 and all(f'"token_{i}"' in lines[r["line_number"] - 1] for i, r in enumerate(got))


def test_budgets_of_all_scopes(spark):
    row = lambda p, r, f, **k: spark.createDataFrame([(*k.values(), p, r, f)], [*k, "precision", "recall", "false_positive_rate"])
    now = {"global": row(0.9, 0.5, 0.3), "rules": row(0.5, 1.0, 0.0, expected_rule="A"), "confidence": row(0.7, 0.0, 0.0, strongest="LOW")}
    before = {"global": row(0.95, 0.9, 0.1), "rules": row(0.9, 1.0, 0.0, expected_rule="A"), "confidence": row(0.9, 0.0, 0.0, strongest="LOW")}
    told = lambda budget: rows_of(quality.budget_violations(now, before, budget), "scope", "name", "metric")
    assert told({"global": {"precision": 0.1, "recall": 0.1, "false_positive_rate": 0.1}}) == [("global", "all", "false_positive_rate"), ("global", "all", "recall")]
    assert told({"rules": {"precision": 0.1, "recall": 0.0}, "confidence": {"precision": 0.1}}) == [("confidence", "LOW", "precision"), ("rules", "A", "precision")]
    with pytest.raises(ValueError):
        quality.budget_violations(now, before, {"confidence": {"precision": 0.0}})
