"""Software composition: dependencies of manifests, advisories and their findings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlode.functions import columns as C
from scanlode.functions.domains import MANIFESTS
from scanlode.functions.texts import first_lines
from scanlode.functions.versions import after, package_name, sort_key
from scanlode.operators.findings import COLUMNS, no_evidence

ADVISORY = "id string, ecosystem string, name string, aliases array<string>, severity array<struct<type: string, score: string>>, summary string, affected array<struct<ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string, last_affected: string>>>>, versions: array<string>>>"
#: A requirement's name, comparison and version, and one of nothing but a name.
PINNED = r"^([\w.-]+)\s*(?:={1,3}|[~!<>^]=?)\s*(\d[^\s,;]*)"
BARE = r"^[\w.-]+$"
SECTIONS = ("dependencies", "devDependencies", "peerDependencies")


def ecosystem(path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, eco in MANIFESTS.items():
        out = F.when(C.file_name(path) == name, eco).otherwise(out)
    return out


def _entry(name: Column, version: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"))


# Each parser turns a manifest's text into an array of (name, version); an empty name is no entry.


def requirements(content: Column) -> Column:
    own = F.filter(F.transform(C.lines(content), C.stripped), lambda t: ~t.rlike(r"^(#|-|git\+|http)"))
    return F.transform(own, lambda t: _entry(F.when(t.rlike(BARE), t).otherwise(F.regexp_extract(t, PINNED, 1)), F.regexp_extract(t, PINNED, 2)))


def package_json(content: Column) -> Column:
    parsed = F.from_json(content, ", ".join(f"{s} map<string,string>" for s in SECTIONS))
    pairs = F.flatten(F.array(*[F.coalesce(F.map_entries(parsed[s]), F.array().cast("array<struct<key:string,value:string>>")) for s in SECTIONS]))
    return F.transform(pairs, lambda e: _entry(e["key"], F.substring_index(F.regexp_replace(e["value"], r"^[\^~>=<v]", ""), " ", 1)))


def go_mod(content: Column) -> Column:
    """Lines of require blocks and single requires: the text is cut at the blocks' heads, and a block ends at its bracket."""
    parts = F.split(content, r"(?m)^[ \t]*require[ \t]*\(")
    inside = F.flatten(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: C.lines(F.element_at(F.split(x, r"(?m)^[ \t]*\)", 2), 1))))
    single = F.transform(F.filter(C.lines(content), lambda x: x.rlike(r"^\s*require\s+[^\s(]")), lambda x: F.regexp_replace(x, r"^\s*require\s+", ""))
    words = F.filter(F.transform(F.concat(inside, single), lambda x: F.split(C.stripped(x), r"\s+")), lambda p: (F.size(p) >= 2) & ~F.get(p, 0).startswith("//"))
    return F.transform(words, lambda p: _entry(F.get(p, 0), F.regexp_replace(F.get(p, 1), "^v+", "")))


def gemfile_lock(content: Column) -> Column:
    """Entries of the GEM section: the text is cut where a line is not indented, and each part begins with its heading.

    An entry is indented by four and has its version in brackets; what is indented deeper is only required by it.
    """
    own = F.filter(F.split(F.concat(F.lit("\n"), content), r"\n(?=\S)"), lambda x: x.rlike(r"^GEM[ \t]*(?:\r?\n|$)"))
    entries = F.filter(F.flatten(F.transform(own, C.lines)), lambda t: t.startswith(" " * 4) & ~t.startswith(" " * 5) & t.contains("("))
    version = lambda t: F.substring_index(F.substring_index(t, "(", -1), ")", 1)
    return F.transform(F.filter(entries, lambda t: version(t).rlike(r"^\d")), lambda t: _entry(C.stripped(F.substring_index(t, "(", 1)), version(t)))


def dependencies(files: DataFrame) -> DataFrame:
    """file_path, ecosystem, name, version, line (first that holds the name, else 1) of all manifests."""
    name, content = C.file_name(F.col("file_path")), F.col("content")
    parts = ((name.startswith("requirements"), requirements), (name == "package.json", package_json), (name == "go.mod", go_mod), (name == "Gemfile.lock", gemfile_lock))
    entries = F.lit(None)
    for test, parse in parts:
        entries = F.when(test, parse(content)).otherwise(entries)
    # What has no entries is left out in the same pass: a filter on them would be pushed down, below an exchange too, and parse everything twice.
    rows = files.select("file_path", ecosystem(F.col("file_path")).alias("ecosystem"), "content", F.filter(entries, lambda e: e["name"] != "").alias("entries"))
    return rows.mapInArrow(_located, "file_path string, ecosystem string, name string, version string, line int")


#: Rows of a batch that goes back to Spark, but for the last file's.
ROWS_OUT = 10_000
LOCATED = pa.schema([("file_path", pa.string()), ("ecosystem", pa.string()), ("name", pa.string()), ("version", pa.string()), ("line", pa.int32())])


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per entry with its line: one walk over a text finds all its names."""
    for b in batches:
        out: list[tuple] = []
        for path, eco, content, entries in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if eco is None or not entries:
                continue
            first = first_lines(content, {e["name"] for e in entries})
            out += ((path, eco, e["name"], e["version"], first.get(e["name"], 1)) for e in entries)
            if len(out) >= ROWS_OUT:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), LOCATED, strict=True)], schema=LOCATED)


def severity_of(scores: Column) -> Column:
    """From the first numeric score of 4 or more; MEDIUM if there is none (score vectors count as none)."""
    numbers = F.filter(F.transform(F.coalesce(scores, F.array().cast("array<struct<type:string,score:string>>")), lambda s: s["score"].try_cast("double")), lambda x: x >= 4)
    top = F.try_element_at(numbers, F.lit(1))
    return F.when(top >= 9, "CRITICAL").when(top >= 7, "HIGH").otherwise("MEDIUM")


def alias_of(advisory_id: Column, aliases: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(aliases, lambda a: a.startswith("CVE-")), F.lit(1)), advisory_id)


def affected_spans(advisories: DataFrame) -> DataFrame:
    """Rows of advisories as spans of sorted version keys: id, ecosystem, name, low (included), high (excluded; null: open), fixed.

    A range's events are swept in version order: a version is affected from an introduction on
    to the next fix, or to just behind the next version that is named as the last affected.
    Versions that are listed by name are spans of their own. Ranges of commits are left out.
    """
    own = advisories.select("id", "ecosystem", package_name(F.col("ecosystem"), F.col("name")).alias("name"), F.explode("affected").alias("a"), F.monotonically_increasing_id().alias("_a"))
    key = lambda v: sort_key(F.col("ecosystem"), v)
    ranges = own.select("id", "ecosystem", "name", "_a", F.posexplode("a.ranges").alias("_r", "r")).where(F.coalesce("r.type", F.lit("")) != "GIT")
    events = ranges.select("id", "ecosystem", "name", "_a", "_r", F.posexplode("r.events").alias("_e", "e"))
    opens, closes = F.col("e.introduced"), F.coalesce("e.fixed", "e.last_affected")
    place = F.when(opens == "0", "").when(opens.isNotNull(), key(opens)).when(F.col("e.fixed").isNotNull(), key(F.col("e.fixed"))).otherwise(after(key(F.col("e.last_affected"))))
    swept = events.where(opens.isNotNull() | closes.isNotNull()).withColumn("low", place).where("low IS NOT NULL")
    # An introduction stands before a fix of the same version.
    order = Window.partitionBy("_a", "_r", "id").orderBy("low", opens.isNull(), "_e").rowsBetween(1, Window.unboundedFollowing)
    close = F.first(F.when(opens.isNull(), F.struct(F.col("low").alias("high"), F.col("e.fixed").alias("fixed"))), ignorenulls=True).over(order)
    spans = swept.withColumn("close", close).where(opens.isNotNull()).select("id", "ecosystem", "name", "low", F.col("close.high").alias("high"), F.col("close.fixed").alias("fixed"))
    named = own.select("id", "ecosystem", "name", F.explode("a.versions").alias("v")).select("id", "ecosystem", "name", key(F.col("v")).alias("low")).where("low IS NOT NULL")
    return spans.unionByName(named.select("id", "ecosystem", "name", "low", after(F.col("low")).alias("high"), F.lit(None).cast("string").alias("fixed")))


def vulnerable(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    """Findings of dependencies in an advisory's spans; a version that is unknown or no version counts as affected.

    The fix is that of the branch the version is on; for an unknown version, or one that is only
    listed by name, the newest that is named.
    """
    spans = affected_spans(advisories)
    newest = F.max(F.when(F.col("fixed").isNotNull(), F.struct(F.col("high"), F.col("fixed")))).over(Window.partitionBy("_id", "_eco", "_name"))
    spans = spans.select(F.col("id").alias("_id"), F.col("ecosystem").alias("_eco"), F.col("name").alias("_name"), "low", "high", "fixed").withColumn("newest", newest)
    spans = spans.withColumns({"newest": F.col("newest.fixed")})
    told = advisories.select(F.col("id").alias("_id"), F.col("ecosystem").alias("_eco"), package_name(F.col("ecosystem"), F.col("name")).alias("_name"), alias_of(F.col("id"), F.col("aliases")).alias("alias"), severity_of(F.col("severity")).alias("severity"), "summary")
    rows = deps.withColumns({"_key": sort_key(F.col("ecosystem"), F.col("version")), "_pkg": package_name(F.col("ecosystem"), F.col("name"))})
    inside = F.col("_key").isNull() | ((F.col("low") <= F.col("_key")) & (F.col("high").isNull() | (F.col("_key") < F.col("high"))))
    hit = rows.join(spans, (F.col("ecosystem") == F.col("_eco")) & (F.col("_pkg") == F.col("_name")) & inside)
    # An advisory may cover a version by several ranges.
    known = F.when(F.col("_key").isNotNull() & F.col("fixed").isNotNull(), F.struct("high", "fixed"))
    hit = hit.groupBy(*deps.columns, "_id", "_eco", "_name").agg(F.coalesce(F.min(known)["fixed"], F.max("newest")).alias("fixed"))
    own = {
        "rule_id": F.concat(F.lit("SCA-"), "alias"), "rule_name": F.concat(F.lit("Vulnerable dependency: "), "name"), "line_number": F.col("line"), "snippet": F.concat_ws(" ", "name", "version"),
        "description": F.coalesce("summary", F.lit("")), "fix": F.coalesce(F.concat(F.lit("Upgrade to "), "fixed", F.lit(" or later.")), F.lit("No fixed version is known.")), "language": F.lower("ecosystem"), "confidence": F.lit("HIGH"), "evidence": no_evidence(),
    }
    return hit.join(told, ["_id", "_eco", "_name"]).withColumns(own).select(*COLUMNS)
