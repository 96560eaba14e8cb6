"""Version orders, spans of advisories and names in manifests, against answers by hand."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions import texts, versions
from scanlode.operators import dependencies
from scanlode.sources import manifests, state

#: Each list ascends; versions of a tuple are equal.
ORDERS = {
    "PyPI": ["1.dev0", ("1.0.dev456", "1.dev456"), "1.0a1", ("1.0a2.dev456", "1.0alpha2.dev456"), "1.0a12.dev456", ("1.0a12", "1.0-ALPHA-12", "v1.0a12"), "1.0b1.dev456", ("1.0b2", "1.0.beta2"), "1.0b2.post345.dev456", ("1.0b2.post345", "1.0b2-345"), ("1.0rc1.dev456", "1.0c1.dev456"), ("1.0rc1", "1.0pre1", "1.0-preview.1"), ("1.0", "1", "1.0.0"), "1.0+abc.5", "1.0+abc.7", "1.0+5", "1.0.post456.dev34", ("1.0.post456", "1.0-456", "1.0r456"), "1.0.15", "1.1.dev1", "1.10", "2.0", "1!0.1"],
    "npm": ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-alpha-b", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", ("1.0.0", "v1.0.0", "=1.0.0", "1.0", "1.0.0+build.1"), "1.0.1", "1.2.0", "1.10.0", "2.0.0-0", "2.0.0", "99999999999999999999.0.0"],
    "Go": ["0.0.0-20190101000000-abcdefabcdef", "0.0.0-20200101000000-0123456789ab", "0.1.0", "1.2.3", "1.2.4-0.20200101000000-0123456789ab", "1.2.4-pre.0.20200101000000-0123456789ab", ("1.2.4", "1.2.4+incompatible")],
    "RubyGems": ["1.0.a", "1.0.a.2", "1.0.b1", "1.0.b10", "1.0.rc1", ("1.0", "1", "1.0.0", "1.0.0-java"), "1.0.0.1", "1.0.1.pre", "1.0.1", "1.2.0.a.3", "1.2", "1.10", "2.0.0.rc2", "2"],
}


@pytest.mark.parametrize("ecosystem", ORDERS)
def test_versions_sort_as_their_ecosystem_orders_them(spark, ecosystem):
    ranked = [(v, i) for i, x in enumerate(ORDERS[ecosystem]) for v in ((x,) if isinstance(x, str) else x)]
    random.Random(2).shuffle(ranked)
    rows = spark.createDataFrame(ranked, "v string, i int").select("v", "i", versions.sort_key(F.lit(ecosystem), F.col("v")).alias("k")).collect()
    assert all(r["k"] for r in rows)
    for a in rows:
        for b in rows:
            assert (a["k"] < b["k"]) == (a["i"] < b["i"]) and (a["k"] == b["k"]) == (a["i"] == b["i"]), (a, b)
            assert not (a["k"] <= b["k"]) or b["k"] + versions.BEHIND > a["k"]


def test_what_is_no_version_has_no_key(spark):
    rows = [("PyPI", "latest"), ("npm", "1.x"), ("npm", "*"), ("Go", ""), ("RubyGems", "beta"), ("PyPI", None), ("PyPI", "1.0.*"), ("npm", "git+https://x")]
    got = spark.createDataFrame(rows, "e string, v string").select(versions.sort_key(F.col("e"), F.col("v")).alias("k")).collect()
    assert {r["k"] for r in got} == {None}


def found(spark, rows, advisories):
    deps = spark.createDataFrame([("f", e, n, v, 1) for e, n, v in rows], "file_path string, ecosystem string, name string, version string, line int")
    out = dependencies.vulnerable(deps, spark.createDataFrame(advisories, dependencies.ADVISORY)).collect()
    return sorted((r["snippet"], r["rule_id"].removeprefix("SCA-"), r["fix"]) for r in out)


def test_cases_by_hand(spark):
    rows = [(e, n, v) for e, n, v, _ in manifests.BRANCH_CASES]
    want = sorted((f"{n} {v}", a, f"Upgrade to {fix} or later." if fix else "No fixed version is known.") for _, n, v, answers in manifests.BRANCH_CASES for a, fix in answers)
    assert found(spark, rows, manifests.BRANCHED) == want


def advisory(*ranges, versions=()):
    return ("A", "npm", "p", [], [], "s", [([(kind, [tuple(e) for e in events]) for kind, events in ranges], list(versions))])


def test_sweep_over_events(spark):
    i, f, la = (lambda v: (v, None, None)), (lambda v: (None, v, None)), (lambda v: (None, None, v))
    rows = [("npm", "p", v) for v in ("0.1.0", "1.0.0", "1.5.0", "2.0.0", "2.5.0", "3.0.0", "4.0.0", "nonsense", "")]
    hit = lambda *r, **k: [x[0][2:] for x in found(spark, rows, [advisory(*r, **k)])]
    unknown = ["", "nonsense"]
    assert hit(("SEMVER", [f("2.0.0"), i("1.0.0"), i("2.5.0"), f("4.0.0")])) == sorted([*unknown, "1.0.0", "1.5.0", "2.5.0", "3.0.0"])
    assert hit(("SEMVER", [i("0"), la("1.0.0"), i("3.0.0")])) == sorted([*unknown, "0.1.0", "1.0.0", "3.0.0", "4.0.0"])
    assert hit(("GIT", [i("0")])) == [] and hit() == [] and hit(("SEMVER", []), versions=["2.5.0"]) == sorted([*unknown, "2.5.0"])
    assert hit(("SEMVER", [i("1.0.0"), f("1.0.0")])) == unknown
    both = found(spark, [("npm", "p", "1.5.0")], [advisory(("SEMVER", [i("1.0.0"), f("3.0.0")]), ("ECOSYSTEM", [i("0"), f("2.0.0")]), versions=["1.5.0"])])
    assert both == [("p 1.5.0", "A", "Upgrade to 2.0.0 or later.")]
    assert found(spark, rows, []) == [] and found(spark, [("PyPI", "p", "1.5.0")], [advisory(("SEMVER", [i("0")]))]) == []


def test_advisories_are_read_with_all_their_events(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "A", "affected": [{"package": {"ecosystem": "npm", "name": "p"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"last_affected": "1.0.0"}]}], "versions": ["2.0.0"]}]}\n')
    deps = spark.createDataFrame([("f", "npm", "p", v, 1) for v in ("1.0.0", "1.0.1", "2.0.0")], "file_path string, ecosystem string, name string, version string, line int")
    assert sorted(r["snippet"] for r in dependencies.vulnerable(deps, state.read_advisories(spark, str(tmp_path / "a.json"))).collect()) == ["p 1.0.0", "p 2.0.0"]


def test_lock_file_entries(spark):
    text = "PATH\n  specs:\n    own (1)\nGEM\n  remote: x\n  specs:\n    net.http (1.2)\n      rack (>= 2)\n    rails (6.1.7)\n    odd (>= 3)\n\nPLATFORMS\n  ruby\n    no (1)\n"
    rows = dependencies.dependencies(spark.createDataFrame([("Gemfile.lock", text)], "file_path string, content string")).collect()
    assert [(r["name"], r["version"], r["line"]) for r in rows] == [("net.http", "1.2", 7), ("rails", "6.1.7", 9)]


def test_names_of_long_manifests_are_found_in_one_walk():
    names = {f"package-{i}" for i in range(100_000)}
    text = "\n".join(f"package-{i}==1" for i in range(100_000))
    began = time.time()
    first = texts.first_places(text, names)
    assert time.time() - began < 20 and all(text.startswith(n, first[n]) for n in ("package-1", "package-99999")) and first["package-1"] == text.find("package-1")
    assert texts.first_places("ab abc b", {"b", "abc", "missing"}) == {"b": 1, "abc": 3}


def test_character_references(spark):
    html = "a &quot;b&quot; &#39;c&#x27; &#34;&amp;quot; &lt;&#128512; &#xD800;&#9999999; &#; x &nbsp;"
    (r,) = spark.createDataFrame([(html,)], "h string").select(C.unescaped(F.col("h")).alias("t"), C.unescaped(F.lit(None).cast("string")).alias("n")).collect()
    assert r["t"] == "a \"b\" 'c' \"&quot; <\U0001f600  &#; x \u00a0" and r["n"] is None


def test_baselines_of_each_form(spark, tmp_path):
    read = lambda text: (tmp_path / "b").write_text(text) and sorted(r[0] for r in state.read_baseline(spark, str(tmp_path / "b")).collect())
    assert read('\n{"fingerprint":"x"}\nbroken\n{"fingerprint":"y"}\n') == ["x", "y"]
    assert read('{\n "fingerprints": [\n  "x", "y"]}\n') == ["x", "y"] and read('["x",\n"x"]') == ["x"] and read("nonsense") == []
