"""Token ids in Arrow stream files: fixed-size-list batches of equal-length sequences and masks.

A shard is one file in the Arrow IPC stream format. Its record batches hold
``BATCH`` sequences each (the last may hold fewer): ``ids`` is a
``fixed_size_list<uint16>[LENGTH]`` and ``mask`` a ``fixed_size_list<uint8>[LENGTH]``
that is 1, and 0 on the padding of a shard's last sequence. Every sequence has the
same length, so sequence ``k`` is element ``k % BATCH`` of batch ``k // BATCH``, and a
memory map serves it without a copy. Documents run on across sequences, each
closed by the end id; an index row gives each document's place.

Files get their name by shard, are written under another name and then moved,
so a task that runs again replaces its own file with the same bytes.

Defined cases: a null or empty text is the end id alone; repeated rows are
separate documents; an empty table gives no files and no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame

from scanlode.llm.common import in_batches, materialize, new_path
from scanlode.llm.ordered import by_doc_id, encoded, shard, with_starts

LENGTH, BATCH, END = 2048, 64, 1
INDEX = "shard int, doc_id long, at long, n_tokens long"
SCHEMA = pa.schema([("ids", pa.list_(pa.uint16(), LENGTH)), ("mask", pa.list_(pa.uint8(), LENGTH))])


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class ShardWriter:
    """Appends ids to one stream file; ``close`` pads the last sequence."""

    def __init__(self, sink):
        self.sink, self.writer, self.held, self.size = sink, pa.ipc.new_stream(sink, SCHEMA), [], 0

    def append(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= 2 * LENGTH * BATCH:
            raw, step = b"".join(self.held), 2 * LENGTH * BATCH
            whole = len(raw) // step * step
            for at in range(0, whole, step):
                self._batch(np.frombuffer(raw, "<u2", LENGTH * BATCH, at), LENGTH * BATCH)
            self.held, self.size = [raw[whole:]], len(raw) - whole

    def _batch(self, ids: np.ndarray, n: int) -> None:
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(np.uint16, copy=False)), LENGTH), pa.FixedSizeListArray.from_arrays(pa.array((np.arange(len(ids)) < n).astype(np.uint8)), LENGTH)]
        self.writer.write_batch(pa.record_batch(lists, schema=SCHEMA))

    def close(self) -> None:
        rest = np.frombuffer(b"".join(self.held), "<u2")
        if len(rest):
            padded = np.zeros(-(-len(rest) // LENGTH) * LENGTH, dtype=np.uint16)
            padded[: len(rest)] = rest
            self._batch(padded, len(rest))
        self.writer.close()
        self.sink.close()


class ShardReader:
    """Random access to one stream file; on a local or mounted folder without copying."""

    def __init__(self, uri: str):
        where, path = open_folder(uri)
        source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.source = source
        self.batches = [tuple(b.column(i).flatten().to_numpy() for i in range(2)) for b in pa.ipc.open_stream(source)]

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Views of the file's own ids and mask."""
        ids, mask = self.batches[k // BATCH]
        own = slice(k % BATCH * LENGTH, (k % BATCH + 1) * LENGTH)
        return ids[own], mask[own]

    def span(self, start: int, n: int) -> np.ndarray:
        step, parts = LENGTH * BATCH, []
        while n > 0:
            ids = self.batches[start // step][0][start % step : start % step + n]
            parts.append(ids)
            start, n = start + len(ids), n - len(ids)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end: int = END) -> DataFrame:
    """Writes one file per shard to ``folder`` and returns the index (columns ``INDEX``), itself in a table."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, out, at = shard(), None, 0
        for doc_ids, ids in encoded(batches, vocabulary, end):
            if out is None:
                where, path = open_folder(folder)
                where.create_dir(path, recursive=True)
                own = f"{path}/.{k}.{TaskContext.get().taskAttemptId()}"
                out = ShardWriter(where.open_output_stream(own))
            sizes = [len(x) // 2 for x in ids]
            for x in ids:
                out.append(x)
            ends = np.cumsum(sizes) + at
            yield pa.record_batch([pa.array([k] * len(ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64())], names=["shard", "doc_id", "at", "n_tokens"])
            at = int(ends[-1])
        if out is not None:
            out.close()
            where.move(own, f"{path}/{k}.arrows")

    return materialize(in_batches(by_doc_id(docs)).mapInArrow(write, INDEX), "token-index")


def token_digests(index: DataFrame, folder: str) -> DataFrame:
    """Reads every document back from the files: doc_id, shard, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, ShardReader | None] = (-1, None)
        for b in batches:
            crc = []
            for k, at, n in zip(*(b.column(c).to_pylist() for c in ("shard", "at", "n_tokens")), strict=True):
                if opened[0] != k:
                    opened = (k, ShardReader(f"{folder}/{k}.arrows"))
                crc.append(zlib.crc32(opened[1].span(at, n).astype("<u4").tobytes()))
            start = pc.add(b.column("at"), b.column("shard_start"))
            yield pa.record_batch([b.column("doc_id"), b.column("shard"), start, b.column("n_tokens"), pa.array(crc, pa.int64())], names=["doc_id", "shard", "start", "n_tokens", "ids_crc32"])

    return in_batches(with_starts(index, "n_tokens")).mapInArrow(read, "doc_id long, shard int, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Writes token files to the shared folder, reads them back and returns the digests."""
    folder = new_path(docs.sparkSession, "token-files")
    return token_digests(write_token_files(docs, folder, vocabulary), folder)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


