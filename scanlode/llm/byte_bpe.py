"""Byte-level BPE of whole texts by overlapping chunks, and back.

A text of up to ``CHUNK + OVERLAP`` characters is one chunk and goes through the tokenizers'
library in place, without a shuffle. A longer one is cut into chunks that reach
``OVERLAP`` characters into the next, dealt to tasks one by one, so that a text of any
length keeps many tasks busy:

1. each chunk is pre-tokenised by itself from its first character on, wherever that falls;
2. where a chunk and the one before both end a pre-token at the same place of their
   overlap, they have resynchronised: what a pattern matches from there on depends on
   the text from there on only. Places after white space and those so near to a
   chunk's end that the text behind it could change them don't count;
3. chunks that find no such place (a run of letters or white space longer than the
   overlap) are joined to the chunk before and pre-tokenised again, until all fit;
4. the pieces between these places are encoded; a text's ids are its pieces' ids in order.

The pattern is matched as the library would: characters that its Unicode tables and
those of ``regex`` class differently are shown to ``regex`` as others of the library's
class. Decoding looks up each id's bytes and concatenates them.

Defined cases: a null or empty text has no ids; repeated rows and rows with equal or
null doc_id are rows of their own (a key of their own holds a long text's pieces
together); an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.llm.common import in_batches, materialize

#: Characters of a chunk, of its reach into the next, and how near to an end a match may still change.
CHUNK, OVERLAP, MARGIN = 16_384, 512, 4
SLICES = "row long, doc_id long, k long, next long, text string"
MARKED = f"{SLICES}, head array<int>, tail array<int>"
IDS = "row long, doc_id long, part long, ids binary"
BYTES = "row long, doc_id long, part long, bytes binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def ranks_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    """Place of a public rank file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _encoding(pattern: str, ranks: dict[bytes, int]):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _stand_ins() -> dict[int, str]:
    """Characters that the library's tables and ``regex``'s put in different classes, and one of the library's class that both agree on."""
    import regex

    points = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    theirs, ours = {}, {}
    for cls, sign in ((r"\p{L}", "a"), (r"\p{N}", "0"), (r"\s", " ")):
        own = _encoding(cls, {bytes([b]): b for b in range(256)})
        theirs |= dict.fromkeys(own.decode_bytes(own.encode_ordinary(points)).decode(), sign)
        ours |= dict.fromkeys(regex.findall(cls, points), sign)
    return {ord(c): theirs.get(c, "!") for c in {*theirs, *ours} if theirs.get(c) != ours.get(c)}


# What a worker process needs is made when it first needs it, and kept.


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def whole_encoder(path: str):
    import public_tokenizers

    return _encoding(public_tokenizers.PATTERN, ranks(path))


@cache
def piece_encoder(path: str):
    """Encodes its text as one pre-token."""
    return _encoding("(?s).+", ranks(path))


@cache
def splitter():
    """The pattern for ``regex``, the characters that it must be shown as others, and the same as a set."""
    import public_tokenizers
    import regex

    shown = _stand_ins()
    return regex.compile(public_tokenizers.PATTERN), shown, frozenset(map(chr, shown))


@cache
def id_bytes(path: str) -> list[bytes]:
    """Bytes of each id."""
    out = [b""] * (1 + max(ranks(path).values()))
    for token, i in ranks(path).items():
        out[i] = token
    return out


@cache
def id_signs(path: str) -> list[str]:
    """Decimal spelling of each id."""
    return [str(i) for i in range(len(id_bytes(path)))]


def text_bytes(path: str, ids: list[int]) -> bytes:
    known = id_bytes(path)
    return b"".join([known[i] for i in ids])


def pre_token_ends(text: str) -> list[int]:
    """Where the pre-tokens of a text end."""
    pattern, shown, odd = splitter()
    if not text.isascii() and not odd.isdisjoint(text):
        text = text.translate(shown)
    return [m.end() for m in pattern.finditer(text)]


def encode_apart(path: str, text: str) -> list[int]:
    """Ids of a text with runs too long for the library's pattern, pre-token by pre-token."""
    encode = piece_encoder(path).encode_ordinary
    return [i for a, b in pairwise((0, *pre_token_ends(text))) for i in encode(text[a:b])]


def encode_text(path: str, text: str) -> list[int]:
    """A piece of a chunk's length goes through the library's own pattern, a longer one (it holds a long run) pre-token by pre-token."""
    return whole_encoder(path).encode_ordinary(text) if len(text) <= CHUNK + OVERLAP else encode_apart(path, text)


def _numbered(docs: DataFrame, long: bool) -> DataFrame:
    """The short or the long texts with a key for each row; both kinds have their own keys."""
    beyond = F.coalesce(F.char_length("text"), F.lit(0)) > CHUNK + OVERLAP
    rows = docs.where(beyond if long else ~beyond)
    return rows.select((2 * F.monotonically_increasing_id() + int(long)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks that are handled at once: as Python numbers, ids take ten times the room of their text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            yield batch.slice(at, 64)


def _packed(ids: list[list[int]]) -> pa.Array:
    return pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary())


def encode_short(docs: DataFrame, path: str) -> DataFrame:
    """``IDS`` of the texts that are one chunk: one part each, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            yield pa.record_batch([b.column(0), b.column(1), pa.array([0] * b.num_rows, pa.int64()), _packed([encode_text(path, t) for t in b.column(2).to_pylist()])], names=["row", "doc_id", "part", "ids"])

    return in_batches(_numbered(docs, long=False)).mapInArrow(run, IDS)


def slices(docs: DataFrame) -> DataFrame:
    """``SLICES``: the chunks of the longer texts, each with its overlap and the number of the next (null: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n = -(-(len(text) - OVERLAP) // CHUNK)  # the last chunk is longer than the overlap
                for at in range(0, n, 64):
                    ks = range(at, min(n, at + 64))
                    cut = [text[k * CHUNK : (k + 1) * CHUNK + OVERLAP] for k in ks]
                    columns = [[row] * len(ks), [doc_id] * len(ks), list(ks), [k + 1 if k + 1 < n else None for k in ks]]
                    yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array(cut, pa.string())], names=["row", "doc_id", "k", "next", "text"])

    return in_batches(_numbered(docs, long=True)).mapInArrow(run, SLICES)


def _candidates(text: str, ends: list[int], last: bool) -> tuple[list[int], list[int]]:
    """Places in the first and the last ``OVERLAP`` characters where a resynchronised cut may be, from the first of these on."""
    sure = [e for e in ends if not text[e - 1].isspace() and (last or e <= len(text) - MARGIN)]
    at = len(text) - OVERLAP
    return [e for e in sure if e < OVERLAP], [] if last else [e - at for e in sure if e >= at]


def marked(parts: DataFrame) -> DataFrame:
    """``MARKED``: chunks pre-tokenised each by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            texts, following = b.column("text").to_pylist(), b.column("next").to_pylist()
            both = [_candidates(t, pre_token_ends(t), n is None) for t, n in zip(texts, following, strict=True)]
            yield pa.record_batch([*b.columns, *(pa.array([x[i] for x in both], pa.list_(pa.int32())) for i in range(2))], names=[*b.schema.names, "head", "tail"])

    return in_batches(parts).mapInArrow(run, MARKED)


def synchronised(chunks: DataFrame) -> DataFrame:
    """row, k, of, at: chunk ``k`` goes on from ``at`` where the chunk ``of`` before it has ended a pre-token too (null: nowhere)."""
    before = chunks.where("next IS NOT NULL").select("row", F.col("k").alias("of"), F.col("next").alias("k"), "tail")
    return before.join(chunks.select("row", "k", "head"), ["row", "k"]).select("row", "k", "of", F.array_min(F.array_intersect("head", "tail")).alias("at"))


def joined(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """``SLICES`` in which each chunk that fits nowhere is part of the one before."""
    from pyspark.sql import Window

    order = Window.partitionBy("row").orderBy("k")
    starts = chunks.join(places.select("row", "k", F.col("at").isNull().alias("loose")), ["row", "k"], "left")
    own = starts.withColumn("first", F.max(F.when(~F.coalesce("loose", F.lit(False)), F.col("k"))).over(order))
    parts = F.array_sort(F.collect_list(F.struct("k", "next", "text")))
    groups = own.groupBy("row", "doc_id", F.col("first").alias("k")).agg(parts.alias("parts"))
    # All but the last of a group without their overlap.
    text = F.concat(F.array_join(F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda x: F.substr(x["text"], F.lit(1), F.char_length(x["text"]) - OVERLAP)), ""), F.element_at("parts", -1)["text"])
    return groups.select("row", "doc_id", "k", F.element_at("parts", -1)["next"].alias("next"), text.alias("text"))


def encode_long(docs: DataFrame, path: str) -> DataFrame:
    """``IDS`` of the longer texts, a part for each piece between resynchronised places."""
    dealt = slices(docs).repartition("row", "k")
    chunks = materialize(marked(dealt), "bpe-chunks")
    whole, fits = [], []
    while True:
        places = materialize(synchronised(chunks), "bpe-places")
        loose = places.where("at IS NULL").select("row").distinct()
        if loose.isEmpty():
            break
        # Only texts with a chunk that fits nowhere go on; what fits is done.
        whole.append(chunks.join(loose, "row", "left_anti"))
        fits.append(places.join(loose, "row", "left_anti"))
        rest, around = chunks.join(loose, "row", "left_semi"), places.join(loose, "row", "left_semi")
        chunks = materialize(marked(joined(rest, around).repartition("row", "k")), "bpe-chunks")
    for table in whole:
        chunks = chunks.unionByName(table)
    for table in fits:
        places = places.unionByName(table)
    ends = places.select("row", F.col("of").alias("k"), F.lit(None).cast("int").alias("start"), (F.col("at") - OVERLAP).alias("end"))
    cuts = places.select("row", "k", F.col("at").alias("start"), F.lit(None).cast("int").alias("end")).unionAll(ends).groupBy("row", "k").agg(F.max("start").alias("start"), F.max("end").alias("end"))
    pieces = chunks.select("row", "doc_id", "k", "text").join(cuts, ["row", "k"], "left").select("row", "doc_id", "k", "text", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            ids = [encode_text(path, t[s or 0 : len(t) + e if e is not None and e < 0 else len(t)]) for t, s, e in zip(*(b.column(c).to_pylist() for c in ("text", "start", "end")), strict=True)]
            yield pa.record_batch([b.column("row"), b.column("doc_id"), b.column("k"), _packed(ids)], names=["row", "doc_id", "part", "ids"])

    return in_batches(pieces).mapInArrow(run, IDS)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``IDS`` of all texts: little-endian unsigned 32-bit ids, those of a row in the order of ``part``."""
    return encode_short(docs, path).unionAll(encode_long(docs, path))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``BYTES``: the raw bytes of each part; a character may begin in one id and end in the next, so only a whole row's bytes need be UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches):
            raw = [text_bytes(path, np.frombuffer(x, "<u4").tolist()) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("row"), b.column("doc_id"), b.column("part"), pa.array(raw, pa.binary())], names=["row", "doc_id", "part", "bytes"])

    return in_batches(encoded).mapInArrow(run, BYTES)


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """``DIGESTS`` of encoded rows whose parts follow each other in order: ids are hashed and decoded part by part, never a row at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs, row, told = id_signs(path), None, None
        for b in batches:
            done = []
            for r, doc_id, raw in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "ids")), strict=True):
                if told is None or r != row:
                    if told is not None:
                        done.append(told)
                    row, told = r, [doc_id, 0, hashlib.sha256(), hashlib.sha256()]
                ids = np.frombuffer(raw, "<u4").tolist()
                if ids:
                    told[2].update(("," * (told[1] > 0) + ",".join([signs[i] for i in ids])).encode())
                    told[3].update(text_bytes(path, ids))
                    told[1] += len(ids)
            if done:
                yield _digest_batch(done)
        if told is not None:
            yield _digest_batch([told])

    return encoded.mapInArrow(run, DIGESTS)


def _digest_batch(done: list[list]) -> pa.RecordBatch:
    ids, counts, ours, theirs = zip(*done, strict=True)
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array([h.hexdigest() for h in ours]), pa.array([h.hexdigest() for h in theirs])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text: ``DIGESTS``, one row per row of ``docs``."""
    ordered = encode_long(docs, path).repartition("row").sortWithinPartitions("row", "part")
    return digests(encode_short(docs, path), path).unionAll(digests(ordered, path))
