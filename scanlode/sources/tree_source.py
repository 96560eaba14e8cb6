"""A source tree as a Spark data source: ``spark.read.format("sourcetree").load(root)``.

Planning opens folders from the root on until it knows ``SPREAD`` of them; a folder whose own
files are many is dealt out in stripes of ``PER_TASK`` names, and what lies below the rest is walked
by the tasks. Filters on path, name, suffix, size and time are pushed down: folders that no
path can match are not entered, and files that are filtered out are never opened. A task lists
and reads as it goes and sends batches bounded in rows and bytes.

Options: ``kind`` is ``sources`` (default: what a scan admits) or ``manifests`` (dependency
manifests by exact name, of any size, skipped folders included); ``content`` ``false`` lists
without opening a file (content and sha256 are null).

Spark hands filters to a Python source only where ``spark.sql.python.filterPushdown.enabled`` is
set, and refuses a source that takes filters where it is not; ``source_tree`` reads in a
session of its own that has it set.
"""

from __future__ import annotations

import hashlib
import operator
import os
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from scanlode.functions.domains import MANIFESTS, PROBE_BYTES
from scanlode.sources.files import PER_TASK, SPREAD, _children, _storage, _walk, admissible, skipped

SCHEMA = "file_path string, name string, suffix string, size long, mtime_ns long, sha256 string, content string"
COLUMNS = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in SCHEMA.split(", "))])
#: Rows and bytes of text of a batch.
MOST_ROWS, MOST_TEXT = 1_000, 8 << 20
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

#: What a pushed filter tests, by its class.
TESTS: dict[type, Callable] = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt, ds.LessThanOrEqual: operator.le, ds.In: lambda x, values: x in values,
    ds.StringStartsWith: lambda x, v: x.startswith(v), ds.StringEndsWith: lambda x, v: x.endswith(v), ds.StringContains: lambda x, v: v in x,
}
#: Columns that a listing knows; none is ever null.
LISTED = ("file_path", "name", "suffix", "size", "mtime_ns")


@dataclass
class Part(ds.InputPartition):
    """Folders of one task: path, whether to walk what is below, and the stripe of its own files (of how many)."""

    folders: list[tuple[str, bool, int, int]]


def suffix_of(name: str) -> str:
    """Lower-case extension with its dot; empty for names like ``.env``."""
    return os.path.splitext(name)[1].lower()


class Tests:
    """Pushed filters as one test on what a listing knows of a file, and one on a folder's path."""

    def __init__(self) -> None:
        self.tests: list[tuple[str, type, object, bool]] = []

    def take(self, f: ds.Filter) -> bool:
        """Whether a filter is taken over."""
        wanted = not isinstance(f, ds.Not)
        inner = f if wanted else f.child
        if isinstance(inner, ds.IsNotNull) and wanted:
            return inner.attribute[0] in LISTED
        value = getattr(inner, "value", None)
        value = value if value is not None else getattr(inner, "values", None)
        if type(inner) not in TESTS or inner.attribute[0] not in LISTED or len(inner.attribute) > 1 or value is None or (isinstance(value, (tuple, list)) and None in value):
            return False
        self.tests.append((inner.attribute[0], type(inner), value, wanted))
        return True

    def file(self, path: str, size: int, mtime_ns: int) -> bool:
        name = path.rpartition("/")[2]
        known = {"file_path": path, "name": name, "suffix": suffix_of(name), "size": size, "mtime_ns": mtime_ns}
        return all(TESTS[kind](known[column], value) == wanted for column, kind, value, wanted in self.tests)

    def folder(self, path: str) -> bool:
        """Whether a path below this folder (relative, empty for the root) can begin or be as is asked."""
        prefix = f"{path}/" if path else ""
        for column, kind, value, wanted in self.tests:
            if column == "file_path" and wanted:
                if kind is ds.StringStartsWith and not (value.startswith(prefix) or prefix.startswith(value)):
                    return False
                if kind is ds.EqualTo and not value.startswith(prefix) or kind is ds.In and not any(v.startswith(prefix) for v in value):
                    return False
        return True


class SourceTree(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(dict(self.options))


class SourceTreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options.get("path", "")
        if not self.root:
            raise ValueError("a source tree needs a path")
        self.kind = options.get("kind", "sources")
        if self.kind not in ("sources", "manifests"):
            raise ValueError(f"a source tree's kind is sources or manifests, not {self.kind}")
        self.content = options.get("content", "true").lower() != "false"
        self.tests = Tests()

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            if not self.tests.take(f):
                yield f

    def _enters(self, base: str, folder: str) -> bool:
        name = folder.rpartition("/")[2]
        return not (self.kind == "sources" and skipped(name)) and self.tests.folder(folder[len(base) :].lstrip("/"))

    def _admits(self, path: str, size: int, mtime_ns: int) -> bool:
        name = path.rpartition("/")[2]
        return (name in MANIFESTS if self.kind == "manifests" else admissible(name, size)) and self.tests.file(path, size, mtime_ns)

    def partitions(self) -> list[Part]:
        store, base = _storage(self.root)
        info = store.get_file_info(base)
        if info.type != fs.FileType.Directory:
            return [Part([(base, False, 0, 1)])] if info.type == fs.FileType.File else [Part([])]
        parts, small, todo, opened = [], [], deque([base]), 0
        while todo and opened + len(todo) < SPREAD:
            folder = todo.popleft()
            inside = _children(store, folder)
            opened += 1
            todo.extend(x.path for x in inside if x.type == fs.FileType.Directory and self._enters(base, x.path))
            stripes = -(-sum(x.type == fs.FileType.File for x in inside) // PER_TASK)
            if stripes == 1:
                small.append((folder, False, 0, 1))
            parts.extend(Part([(folder, False, i, stripes)]) for i in range(stripes) if stripes > 1)
        parts.extend(Part([(folder, True, 0, 1)]) for folder in todo)
        # Folders of few files share tasks.
        parts.extend(Part(small[i : i + 8]) for i in range(0, len(small), 8))
        return parts or [Part([])]

    def _listed(self, store: fs.FileSystem, base: str, part: Part) -> Iterator[tuple[str, fs.FileInfo]]:
        for folder, deep, stripe, stripes in part.folders:
            if folder == base and store.get_file_info(base).type == fs.FileType.File:
                found = iter([store.get_file_info(base)])
            else:
                found = self._below(store, base, folder, deep)
            for x in found:
                if stripes == 1 or zlib.crc32(x.base_name.encode()) % stripes == stripe:
                    path = x.path[len(base) :].lstrip("/") or x.base_name
                    if self._admits(path, x.size, x.mtime_ns):
                        yield path, x

    def _below(self, store: fs.FileSystem, base: str, folder: str, deep: bool) -> Iterator[fs.FileInfo]:
        if not deep:
            yield from _walk(store, folder, False, False)
            return
        todo = [folder]
        while todo:
            for x in _children(store, todo.pop()):
                if x.type == fs.FileType.File:
                    yield x
                elif x.type == fs.FileType.Directory and self._enters(base, x.path):
                    todo.append(x.path)

    def _bytes(self, store: fs.FileSystem, path: str) -> bytes | None:
        try:
            with store.open_input_stream(path) as f:
                return f.read()
        except OSError:
            return None

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store, base = _storage(self.root)
        rows, held = [], 0
        for path, x in self._listed(store, base, partition):
            name = path.rpartition("/")[2]
            sha = text = None
            if self.content:
                raw = self._bytes(store, x.path)
                # A file without an extension that holds a NUL byte in its head is no text.
                if raw is None or (not suffix_of(name) and b"\0" in raw[:PROBE_BYTES]):
                    continue
                sha, text = hashlib.sha256(raw).hexdigest(), raw.decode("utf-8", "replace")
                held += len(raw)
            rows.append((path, name, suffix_of(name), x.size, x.mtime_ns, sha, text))
            if len(rows) >= MOST_ROWS or held >= MOST_TEXT:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), COLUMNS, strict=True)], schema=COLUMNS)


def source_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    """``SCHEMA`` of a tree, in a session of its own with the caller's settings and pushed filters."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(PUSHDOWN, "true")
    own.dataSource.register(SourceTree)
    return own.read.format("sourcetree").options(**options).load(root)
