"""Import graphs and what a change reaches; cache lookups of earlier findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanlode.functions import columns as C

PY_IMPORT = r"(?m)^[ \t]*import[ \t]+([^#;\n]+)"
PY_FROM = r"(?m)^[ \t]*from[ \t]+(\.*[A-Za-z_][\w.]*)[ \t]+import\b"
JS_IMPORT = r"(?:from|import|require\s*\()\s*['\"](\.{1,2}/[^'\"]+)['\"]"
JS_ENDS = ("", ".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs", "/index.js", "/index.ts", "/index.jsx", "/index.tsx", "/index.mjs", "/index.cjs")


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _normal(path: Column) -> Column:
    """Resolves ``.`` and ``..`` parts."""
    none = F.array().cast("array<string>")
    parts = F.aggregate(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")), none, lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(parts, "/")


def _up(folder: Column, n: Column) -> Column:
    """The folder n levels up."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - n, F.lit(0))), "/")


def _join(a: Column, b: Column) -> Column:
    return F.when(a == "", b).otherwise(F.concat(a, F.lit("/"), b))


def edges(files: DataFrame) -> DataFrame:
    """src, dst of every import that resolves to a file of ``files(file_path, content)``; paths are relative to the root."""
    ext = C.suffix(F.col("file_path"))
    py = files.where(ext == ".py")
    plain = F.flatten(F.transform(F.regexp_extract_all("content", F.lit(PY_IMPORT), F.lit(1)), lambda m: F.transform(F.split(m, ","), lambda x: F.regexp_extract(x, r"^\s*([A-Za-z_][\w.]*)", 1))))
    names = F.array_distinct(F.concat(F.filter(plain, lambda x: x != ""), F.regexp_extract_all("content", F.lit(PY_FROM), F.lit(1))))
    py = py.select("file_path", F.explode(names).alias("m"))
    dots = F.length(F.regexp_extract("m", r"^(\.*)", 1))
    tail = F.replace(F.regexp_replace("m", r"^\.+", ""), F.lit("."), F.lit("/"))
    base = F.when(dots > 0, _join(_up(_folder(F.col("file_path")), dots - 1), tail)).otherwise(tail)
    py = py.select("file_path", F.explode(F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))).alias("dst"))
    js = files.where(ext.isin(*JS_ENDS[1:7])).select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(JS_IMPORT), F.lit(1)))).alias("m"))
    base = _normal(_join(_folder(F.col("file_path")), F.col("m")))
    js = js.select("file_path", F.explode(F.array(*[F.concat(base, F.lit(e)) for e in JS_ENDS])).alias("dst"))
    known = files.select(F.col("file_path").alias("dst"))
    return py.unionByName(js).join(known, "dst", "left_semi").select(F.col("file_path").alias("src"), "dst").where("src != dst").distinct()


def impacted(graph: DataFrame, changed: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Changed files and all that import them, directly or not.

    The edges are found once and kept in a table. Each round reads them and only follows what
    the round before found; the rounds are partitions of one table in the shared folder, so each
    writes no more than it found, lineage stays short and cycles end.
    """
    from scanlode.plans.tables import cut, new_path

    spark = changed.sparkSession
    graph = cut(graph.select("src", "dst"))
    path = new_path(spark, "reached")
    rounds = spark.read.schema("file_path string, round int").option("basePath", path)
    found = changed.select("file_path").distinct()
    for i in range(most_rounds + 1):
        found.write.parquet(f"{path}/round={i}")
        frontier = rounds.parquet(f"{path}/round={i}").select("file_path")
        reached = rounds.parquet(path).select("file_path")
        if frontier.isEmpty():
            return reached
        found = graph.join(frontier, graph["dst"] == frontier["file_path"], "left_semi").select(F.col("src").alias("file_path")).distinct().join(reached, "file_path", "left_anti")
    raise RuntimeError("the import graph is deeper than most_rounds")


def _looked_up(files: DataFrame, cache: DataFrame, ruleset: str) -> DataFrame:
    """``files`` with the cache's ``_path`` and ``findings`` where it has them: same size and time, or else same hash, and same rule set."""
    c = cache.where(F.col("ruleset") == ruleset).select(F.col("file_path").alias("_path"), F.col("size").alias("_size"), F.col("mtime_ns").alias("_mtime"), F.col("sha256").alias("_sha"), "findings")
    same = ((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime"))) | (F.col("sha256") == F.col("_sha"))
    return files.join(c, (F.col("file_path") == F.col("_path")) & same, "left")


def cache_lookup(files: DataFrame, cache: DataFrame, ruleset: str) -> tuple[DataFrame, DataFrame]:
    """(findings of unchanged files, files to scan)."""
    joined = _looked_up(files, cache, ruleset)
    hits = joined.where(F.col("_path").isNotNull()).select(F.inline("findings"))
    return hits, joined.where(F.col("_path").isNull()).select(*files.columns)


def cache_table(files: DataFrame, findings: DataFrame, ruleset: str) -> DataFrame:
    """The cache's next content: a row per scanned file with its findings, which the file's size bounds."""
    own = findings.groupBy(F.col("file_path").alias("_path")).agg(F.collect_list(F.struct(*findings.columns)).alias("findings"))
    none = F.array().cast(own.schema["findings"].dataType)
    return files.join(own, F.col("file_path") == F.col("_path"), "left").select("file_path", "size", "mtime_ns", "sha256", F.lit(ruleset).alias("ruleset"), F.coalesce("findings", none).alias("findings"))


def cache_counts(files: DataFrame, cache: DataFrame, ruleset: str) -> DataFrame:
    """hits and misses, from one lookup."""
    joined = _looked_up(files, cache.drop("findings").withColumn("findings", F.lit(None)), ruleset)
    return joined.agg(F.count_if(F.col("_path").isNotNull()).alias("hits"), F.count_if(F.col("_path").isNull()).alias("misses"))
