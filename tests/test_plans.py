"""What plans may not do: parse or match texts before they are dealt over the cores, or twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.plans import queries


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_manifests_are_parsed_once_and_after_they_are_dealt(spark, sf):
    for query in (queries.manifest_dependencies, queries.vulnerable_dependencies, queries.advisory_ranges):
        above, _, below = optimised(query(spark, sf)).partition("Repartition ")
        # A manifest's three sections; the source's own text holds none of these words.
        assert above.count("from_json(") == 3 and "from_json(" not in below


def test_manifests_without_entries_or_ecosystem_give_nothing(spark):
    from scanlode.operators.dependencies import dependencies

    files = spark.createDataFrame([("a/go.mod", "module m\n"), ("a/package.json", "{"), ("a/requirements-x.txt", "a==1"), ("a/other.txt", "a==1"), ("a/go.mod", None), ("b/requirements.txt", "# x\na==1\nb\n")], "file_path string, content string")
    assert sorted(map(tuple, dependencies(files).collect())) == [("b/requirements.txt", "PyPI", "a", "1", 2), ("b/requirements.txt", "PyPI", "b", "", 3)]


def test_pages_are_matched_once_and_after_they_are_dealt(spark, sf):
    above, _, below = optimised(queries.page_secrets(spark, sf)).partition("Repartition ")
    # A cheap test, and a pattern to match, to extract and to split at.
    assert above.count("AKIA") == 4 and below and "AKIA" not in below


def test_entropy_works_its_text_out_once(spark):
    plan = optimised(spark.range(1).select(C.entropy(F.regexp_replace(F.col("id").cast("string"), "MARK", "")).alias("bits")))
    assert plan.count("MARK") == 1
    texts = spark.createDataFrame([("aabb",), ("",), (None,), ("abcd",)], "t string")
    assert [r[0] for r in texts.select(C.entropy(F.col("t"))).collect()] == [1.0, 0.0, None, 2.0]
