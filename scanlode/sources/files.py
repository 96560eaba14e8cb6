"""Source trees as DataFrames: listing, admission, reading, git's view of changes, manifests.

Spark's own file readers leave out names that begin with a dot or underscore, which
a scan needs, so tasks list folders themselves (pruned on the way down) and read
bytes, on local disks or through an address's own file system.
"""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections import deque
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlode.functions.domains import EXTENSIONS, MANIFESTS, MOST_BYTES, NAMES, PROBE_BYTES, SKIPPED_FOLDERS
from scanlode.plans.tables import cut

LISTING = "file_path string, absolute string, size long, mtime_ns long"
FILES = "file_path string, content string, size long, mtime_ns long, sha256 string"
#: Files that one task reads.
PER_TASK = 512
#: Folders that the driver opens before tasks take over.
SPREAD = 256


def skipped(folder: str) -> bool:
    return folder.startswith(".") or folder in SKIPPED_FOLDERS


def admissible(name: str, size: int) -> bool:
    """By name and size alone; a file without extension is looked into when it is read."""
    low = name.lower()
    return size <= MOST_BYTES and (os.path.splitext(low)[1] in EXTENSIONS or low in NAMES or low.startswith(".env"))


def _storage(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address (s3, hdfs, gs, file) or of a plain path, and the path within it."""
    if "://" in root:
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def _children(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What a folder holds, in name order; nothing if it can't be read."""
    try:
        return sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.base_name)
    except OSError:
        return []


def _walk(store: fs.FileSystem, folder: str, deep: bool, prune: bool) -> Iterator[fs.FileInfo]:
    """Files of a folder, and with ``deep`` of all below it."""
    todo = [folder]
    while todo:
        for x in _children(store, todo.pop()):
            if x.type == fs.FileType.File:
                yield x
            elif deep and x.type == fs.FileType.Directory and not (prune and skipped(x.base_name)):
                todo.append(x.path)


def listing(spark: SparkSession, root: str, keep: Callable[[str, int], bool], prune: bool = True) -> DataFrame:
    """``LISTING`` of the files below ``root`` that ``keep`` (name, size) lets through; a file is its own tree.

    The driver only spreads the work: it opens folders until it knows ``SPREAD`` of them; tasks
    list what these hold, walk what is below the rest, and send out no more than is kept.
    """
    store, base = _storage(root)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        rows = [(info.base_name, info.path, info.size, info.mtime_ns)] if keep(info.base_name, info.size) else []
        return spark.createDataFrame(rows, LISTING)
    known, todo = [], deque([base] if info.type == fs.FileType.Directory else [])
    while todo and len(known) + len(todo) < SPREAD:
        folder = todo.popleft()
        known.append((folder, False))
        todo.extend(x.path for x in _children(store, folder) if x.type == fs.FileType.Directory and not (prune and skipped(x.base_name)))
    folders = spark.createDataFrame([*known, *((f, True) for f in todo)], "folder string, deep boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = _storage(root)
        for b in batches:
            for folder, deep in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = (x for x in _walk(own, folder, deep, prune) if keep(x.base_name, x.size))
                while some := list(islice(found, 5000)):
                    yield pa.record_batch([pa.array([x.path[len(base) :].lstrip("/") for x in some]), pa.array([x.path for x in some]), pa.array([x.size for x in some], pa.int64()), pa.array([x.mtime_ns for x in some], pa.int64())], names=[c.split()[0] for c in LISTING.split(", ")])

    return folders.repartition(max(1, min(len(known) + len(todo), SPREAD)), "folder").mapInArrow(run, LISTING)


def scannable(spark: SparkSession, root: str) -> DataFrame:
    return listing(spark, root, admissible)


def read(paths: DataFrame, root: str) -> DataFrame:
    """Reads listed files: UTF-8 with replacement; a file without extension that holds a NUL byte in its head is left out.

    ``root`` names the storage, which every executor must reach.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _storage(root)
        for b in batches:
            rows = []
            for path, absolute, size, mtime in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                try:
                    with store.open_input_stream(absolute) as f:
                        raw = f.read()
                except OSError:
                    continue
                if os.path.splitext(path)[1] or b"\0" not in raw[:PROBE_BYTES]:
                    rows.append((path, raw.decode("utf-8", "replace"), size, mtime, hashlib.sha256(raw).hexdigest()))
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["file_path", "content", "size", "mtime_ns", "sha256"])

    paths = cut(paths.select("file_path", "absolute", "size", "mtime_ns"))  # listed once, counted and read from a table
    n = max(1, -(-paths.count() // PER_TASK))
    return paths.repartition(n, "file_path").mapInArrow(run, FILES)


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """``FILES`` of every scannable file below ``root``."""
    return read(scannable(spark, root), root)


def _git(root: str, *args: str) -> list[str]:
    try:
        out = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return []
    return [line for line in out.split("\n") if line]


def changed_paths(spark: SparkSession, root: str) -> DataFrame:
    """file_path of files that differ from HEAD or are untracked; empty without git."""
    names = {*_git(root, "diff", "--relative", "--name-only", "--diff-filter=ACMRTUXB", "HEAD"), *_git(root, "ls-files", "--others", "--exclude-standard")}
    kept = sorted(n for n in names if os.path.isfile(p := os.path.join(root, n)) and admissible(os.path.basename(n), os.path.getsize(p)))
    return spark.createDataFrame([(n,) for n in kept], "file_path string")


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """``FILES`` of dependency manifests by exact name, of any size, skipped folders included."""
    return read(listing(spark, root, lambda name, _: name in MANIFESTS, prune=False), root)


def within(files: DataFrame, root: str) -> DataFrame:
    """Files at or below a folder of the tree."""
    root = root.strip("/")
    return files if root in ("", ".") else files.where(F.col("file_path").startswith(root + "/") | (F.col("file_path") == root))
