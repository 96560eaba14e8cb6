"""The source tree as a data source: same files as the listing, filters pushed, excluded files never opened."""

from __future__ import annotations

import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from scanlode.sources import files, tree_source
from scanlode.sources.tree_source import SourceTreeReader


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    made = {"a.py": b"x = 1\n", "src/b.py": b"eval(x)\n", "src/deep/er/c.js": b"f()\n", "src/deep/d.sh": b"echo\n", "docs/e.md": b"no", "node_modules/p/f.js": b"g()", ".git/h.py": b"y", ".env": b"K=1", "src/big.py": b"#" * 600_000, "src/bad.py": b"\xff\xfe", "Dockerfile": b"FROM x", "many/requirements.txt": b"a==1\n", "node_modules/p/package.json": b"{}"}
    made |= {f"many/f{i}.py": b"z" for i in range(1_100)}
    for path, raw in made.items():
        (top / path).parent.mkdir(parents=True, exist_ok=True)
        (top / path).write_bytes(raw)
    return str(top)


def pushed(root, *filters, **options):
    """What a reader keeps and opens, and the filters it hands back."""
    reader = SourceTreeReader({"path": root, **options})
    back, opened, read = list(reader.pushFilters(list(filters))), [], SourceTreeReader._bytes

    def note(store, path):
        opened.append(path[len(root) + 1 :])
        return read(reader, store, path)

    reader._bytes = note
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    return sorted(r["file_path"] for r in rows), sorted(opened), back


def test_same_files_as_the_listing(spark, root):
    columns = ["file_path", "content", "size", "mtime_ns", "sha256"]
    rows = lambda df: sorted(map(tuple, df.select(columns).collect()))
    got = rows(tree_source.source_tree(spark, root))
    assert got == rows(files.source_tree(spark, root)) and len(got) > 1_100
    assert sorted(r[0] for r in tree_source.source_tree(spark, root, kind="manifests").select("file_path").collect()) == sorted(r[0] for r in files.manifests(spark, root).select("file_path").collect())


def test_files_that_filters_leave_out_are_never_opened(root):
    starts = ds.StringStartsWith(("file_path",), "src/")
    kept, opened, back = pushed(root, starts, ds.In(("suffix",), (".py", ".js")), ds.LessThan(("size",), 100), ds.Not(ds.EqualTo(("name",), "bad.py")), ds.IsNotNull(("size",)))
    assert kept == opened == ["src/b.py", "src/deep/er/c.js"] and back == []
    kept, opened, back = pushed(root, ds.EqualTo(("file_path",), "src/deep/d.sh"))
    assert kept == opened == ["src/deep/d.sh"]
    held = [ds.StringContains(("content",), "x"), ds.EqualTo(("sha256",), "1"), ds.EqualTo(("size",), None)]
    kept, opened, back = pushed(root, *held, ds.StringEndsWith(("file_path",), "b.py"))
    assert back == held and kept == ["src/b.py"]
    assert pushed(root, starts, content="false")[:2] == (["src/b.py", "src/bad.py", "src/deep/d.sh", "src/deep/er/c.js"], [])


def test_folders_that_no_path_can_match_are_not_entered(root):
    reader = SourceTreeReader({"path": root})
    assert list(reader.pushFilters([ds.StringStartsWith(("file_path",), "src/de")])) == []
    assert {f[0][len(root) :] for p in reader.partitions() for f in p.folders} <= {"", "/src", "/src/deep", "/src/deep/er"}
    assert reader.tests.folder("src") and not reader.tests.folder("docs") and reader.tests.folder("src/deep/er") and not reader.tests.folder("src/other")


def test_large_folders_are_dealt_in_stripes(root):
    parts = SourceTreeReader({"path": root}).partitions()
    stripes = [f for p in parts for f in p.folders if f[3] > 1]
    assert len(stripes) == 3 and {s[2] for s in stripes} == {0, 1, 2} and {s[0] for s in stripes} == {f"{root}/many"}


def test_plan_has_the_filters_and_the_callers_settings(spark, root, capsys):
    df = tree_source.source_tree(spark, root).where((F.col("suffix") == ".py") & (F.col("size") <= 10) & F.col("content").contains("eval"))
    df.explain("formatted")
    (line,) = [x for x in capsys.readouterr().out.split("\n") if x.startswith("PushedFilters")]
    assert "EqualTo(suffix,.py)" in line and "LessThanOrEqual(size,10)" in line and "content" not in line
    assert [r["file_path"] for r in df.collect()] == ["src/b.py"]
    assert df.sparkSession.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions") and spark.conf.get(tree_source.PUSHDOWN, "false") == "false"


def test_odd_roots(spark, root, tmp_path):
    paths = lambda where, **o: [r[0] for r in tree_source.source_tree(spark, where, **o).select("file_path").collect()]
    assert paths(f"{root}/src/b.py") == ["b.py"] and paths(str(tmp_path)) == [] and paths(f"{root}/none") == []
    with pytest.raises(ValueError):
        SourceTreeReader({"path": root, "kind": "odd"})
    with pytest.raises(ValueError):
        SourceTreeReader({})
