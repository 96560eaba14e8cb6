"""Merging a scan into the cache: what is touched is rewritten, the rest keeps its files."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scanlode.operators import findings as fd
from scanlode.operators import impact
from scanlode.sources import state

OF = 8


def table(spark, rows):
    files = spark.createDataFrame([(p, len(t), 1, t) for p, t in rows], "file_path string, size long, mtime_ns long, sha256 string")
    found = spark.createDataFrame([(p, 1) for p, t in rows if t != "clean"], "file_path string, line_number int")
    whole = found.select("file_path", "line_number", *[F.lit(None).cast("string").alias(c) for c in fd.COLUMNS if c not in ("file_path", "line_number", "evidence")], fd.no_evidence().alias("evidence")).select(*fd.COLUMNS)
    return impact.cache_table(files, whole, "r")


def held(spark, path):
    return sorted((r["file_path"], r["sha256"], r["n"]) for r in state.read_cache(spark, path).select("file_path", "sha256", F.size("findings").alias("n")).collect())


def stored(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("part-*.parquet")}


@pytest.fixture
def cache(spark, tmp_path):
    path = str(tmp_path / "cache.parquet")
    state.write_cache(table(spark, [(f"f{i}.py", "old") for i in range(40)]), path, OF)
    return path


def bucket_of(spark, name):
    return state._dealt(spark.createDataFrame([(name,)], "file_path string"), OF).first()["bucket"]


def test_untouched_buckets_keep_their_files(spark, cache):
    before = stored(cache)
    touched = state.merge_cache(table(spark, [("f3.py", "new"), ("g.py", "clean")]), cache, buckets=OF)
    after = stored(cache)
    assert touched == sorted({bucket_of(spark, "f3.py"), bucket_of(spark, "g.py")}) and 0 < len(touched) < OF
    same = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert same and all(after[f] == before[f] for f in same) and not (set(before) - same) & set(after)
    assert held(spark, cache) == sorted([(f"f{i}.py", "new" if i == 3 else "old", 1) for i in range(40)] + [("g.py", "clean", 0)])


def test_files_that_are_gone_leave_and_empty_buckets_go(spark, cache):
    own = bucket_of(spark, "f5.py")
    names = [f"f{i}.py" for i in range(40) if bucket_of(spark, f"f{i}.py") == own]
    state.merge_cache(table(spark, []), cache, spark.createDataFrame([(n,) for n in [*names, "never.py"]], "file_path string"), OF)
    assert held(spark, cache) == sorted((f"f{i}.py", "old", 1) for i in range(40) if f"f{i}.py" not in names)
    assert not any(f"bucket={own}/" in f for f in stored(cache))


def test_first_merge_makes_the_cache_and_nothing_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "none.parquet")
    assert state.merge_cache(table(spark, []), path, buckets=OF) == [] and held(spark, path) == []
    state.merge_cache(table(spark, [("a.py", "x")]), path, buckets=OF)
    before = stored(path)
    assert state.merge_cache(table(spark, []), path, spark.createDataFrame([], "file_path string"), OF) == [] and stored(path) == before and held(spark, path) == [("a.py", "x", 1)]


def test_damaged_and_staged_files_are_left_out(spark, cache):
    own = bucket_of(spark, "f7.py")
    (broken,) = Path(cache).glob(f"of={OF}/bucket={own}/part-*.parquet")
    broken.write_bytes(b"no parquet")
    (staged := Path(cache) / ".spark-staging-1" / f"of={OF}" / f"bucket={own}").mkdir(parents=True)
    (staged / "part-0.parquet").write_bytes(b"half")
    for crc in Path(cache).rglob(".*.crc"):
        crc.unlink()
    left = [f"f{i}.py" for i in range(40) if bucket_of(spark, f"f{i}.py") != own]
    assert [r[0] for r in held(spark, cache)] == sorted(left)
    state.merge_cache(table(spark, [("f7.py", "again")]), cache, buckets=OF)
    assert [r[0] for r in held(spark, cache)] == sorted([*left, "f7.py"])


def test_another_number_of_buckets_starts_anew(spark, cache):
    state.merge_cache(table(spark, [("f3.py", "new")]), cache, buckets=2 * OF)
    assert held(spark, cache) == [("f3.py", "new", 1)]
