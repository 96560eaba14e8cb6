"""Packing: concatenate all documents and cut at fixed windows.

Pass one encodes the documents in doc_id order and notes each shard's total;
prefix sums over the totals give every document its offset in the one long
stream. Pass two cuts the stream at multiples of ``WINDOW``: a document that
crosses a cut yields a boundary record on either side. Only the last sequence is
padded.

Defined cases: a null or empty text is the end id alone; repeated rows are
separate documents; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from scanlode.llm.common import in_batches, materialize
from scanlode.llm.ordered import by_doc_id, encoded, shard, with_starts

WINDOW, END = 4096, 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded_documents(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """shard, doc_id, at (ids before it in its shard), n_tokens, ids (unsigned 16-bit, with the end id), in a table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, at = shard(), 0
        for doc_ids, ids in encoded(batches, vocabulary, end):
            sizes = [len(x) // 2 for x in ids]
            ends = np.cumsum(sizes) + at
            yield pa.record_batch([pa.array([k] * len(ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["shard", "doc_id", "at", "n_tokens", "ids"])
            at = int(ends[-1])

    return materialize(in_batches(by_doc_id(docs)).mapInArrow(encode, "shard int, doc_id long, at long, n_tokens long, ids binary"), "packing-ids")


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces of each document (columns ``PIECES``; ``with_ids`` adds the 16-bit ids of the piece)."""
    placed = with_starts(encoded_documents(docs, vocabulary, end), "n_tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, n, base, at, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_tokens", "shard_start", "at", "ids")), strict=True):
                place, done = base + at, 0
                while done < n:
                    length = min(n - done, window - (place + done) % window)
                    raw = ids[2 * done : 2 * (done + length)]
                    crc = zlib.crc32(np.frombuffer(raw, "<u2").astype("<u4").tobytes())
                    rows.append((doc_id, done, length, crc, n, (place + done) // window, (place + done) % window) + ((raw,) if with_ids else ()))
                    done += length
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
                yield pa.record_batch([pa.array(x, pa.binary() if c == "ids" else pa.int64()) for c, x in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return in_batches(placed).mapInArrow(cut, PIECES + ", ids binary" * with_ids)
