"""Media columns: byte payloads as PNG images, sniffed, validated, corrected and carved.

A payload is kept losslessly as the 8-bit samples of an RGB image of 64 pixels a
row (192 bytes), so any text padded to a multiple of 192 is a whole image. The
sniffer does not trust declared types: an Aho-Corasick automaton over the formats'
magic bytes finds every place where one may begin, and a validator for each format
walks its structure and lengths and says where it ends. What a cell holds at
offset 0 corrects its declared type; what validates further in is carved out.

Defined cases: a null or empty text is one row of 192 spaces; a null cell has no
type; truncated or damaged media don't validate and are ``application/octet-stream``;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.llm.common import in_batches, materialize

UNIT, PIXELS = 192, 64
#: Bytes that are inflated at a time.
PIECE = 1 << 16
LEVEL = 1
UNKNOWN, DECLARED = "application/octet-stream", "text/plain"
_PNG = b"\x89PNG\r\n\x1a\n"


@dataclass(frozen=True)
class Found:
    kind: str
    start: int
    stop: int


def _chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(name)))


def to_png(payload: bytes) -> bytes:
    """A 64-pixel-wide RGB image whose rows are the payload's units, unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    raw = np.zeros((len(rows), UNIT + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", PIXELS, len(rows), 8, 2, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_chunks(data: bytes, start: int = 0) -> tuple[int, list[tuple[bytes, bytes]]] | None:
    """End and chunks of a PNG file at ``start``, if lengths, checksums and order are right."""
    at, chunks = start + len(_PNG), []
    if data[start:at] != _PNG:
        return None
    while at + 12 <= len(data):
        (size,) = struct.unpack_from(">I", data, at)
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data) or struct.unpack_from(">I", data, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(name)):
            return None
        if not chunks and (name != b"IHDR" or size != 13):
            return None
        chunks.append((name, body))
        at += 12 + size
        if name == b"IEND":
            return at, chunks
    return None


def from_png(data: bytes) -> bytes:
    """Samples of an 8-bit image without interlacing, all filters undone."""
    found = png_chunks(data)
    if found is None or all(name != b"IDAT" for name, _ in found[1]):
        raise ValueError("not a valid PNG file")
    _, chunks = found
    width, height, depth, color, _, _, interlace = struct.unpack(">IIBBBBB", chunks[0][1])
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or interlace or channels is None:
        raise ValueError("only 8-bit images without palette and interlacing are read")
    raw = zlib.decompress(b"".join(b for n, b in chunks if n == b"IDAT"))
    if len(raw) != height * (width * channels + 1):
        raise ValueError("samples don't fill the image")
    rows = np.frombuffer(raw, np.uint8).reshape(height, width * channels + 1)
    if not rows[:, 0].any():
        return rows[:, 1:].tobytes()
    out = np.zeros((height + 1, width, channels), np.uint8)
    for i, row in enumerate(rows, 1):
        kind, line = row[0], row[1:].reshape(width, channels)
        if kind == 0:
            out[i] = line
        elif kind == 1:
            out[i] = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            out[i] = line + out[i - 1]
        elif kind in (3, 4):
            left, corner, above = np.zeros(channels, np.int16), np.zeros(channels, np.int16), out[i - 1].astype(np.int16)
            for x in range(width):
                up = above[x]
                if kind == 3:
                    guess = (left + up) // 2
                else:  # of left, up and corner the one nearest to left + up - corner, in this order
                    whole = left + up - corner
                    a, b, c = abs(whole - left), abs(whole - up), abs(whole - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                out[i, x] = (line[x] + guess) & 255
                left, corner = out[i, x].astype(np.int16), up
        else:
            raise ValueError("no such filter")
    return out[1:].tobytes()


def _png(d: bytes, at: int) -> int | None:
    """Chunks in order with right checksums, image data among them."""
    found = png_chunks(d, at)
    return found[0] if found and any(name == b"IDAT" for name, _ in found[1]) else None


def _riff(d: bytes, at: int) -> int | None:
    """A RIFF form (WAVE, WEBP or AVI) whose chunks fill its stated length."""
    if len(d) < at + 12 or d[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return None
    stop, k = at + 8 + struct.unpack_from("<I", d, at + 4)[0], at + 12
    if stop > len(d):
        return None
    while k + 8 <= stop:
        k += 8 + (struct.unpack_from("<I", d, k + 4)[0] + 1) // 2 * 2
    return stop if k in (stop, stop + 1) and stop > at + 12 else None


def _jpeg(d: bytes, at: int) -> int | None:
    k = at + 2
    while k + 4 <= len(d) and d[k] == 0xFF:
        mark = d[k + 1]
        if mark == 0xD9:
            return k + 2
        size = struct.unpack_from(">H", d, k + 2)[0]
        if size < 2 or k + 2 + size > len(d):
            return None
        k += 2 + size
        if mark == 0xDA:  # entropy-coded data up to the next marker that is neither stuffing nor a restart
            while True:
                k = d.find(b"\xff", k)
                if k < 0 or k + 1 >= len(d):
                    return None
                if d[k + 1] == 0 or 0xD0 <= d[k + 1] <= 0xD7:
                    k += 2
                    continue
                break
    return k + 2 if d[k : k + 2] == b"\xff\xd9" else None


def _gif(d: bytes, at: int) -> int | None:
    if len(d) < at + 13 or d[at : at + 6] not in (b"GIF87a", b"GIF89a"):
        return None
    flags = d[at + 10]
    k = at + 13 + (3 * 2 ** ((flags & 7) + 1) if flags & 0x80 else 0)
    while k < len(d):
        if d[k] == 0x3B:
            return k + 1
        if d[k] == 0x21:
            k += 2
        elif d[k] == 0x2C and k + 10 <= len(d):
            k += 10 + (3 * 2 ** ((d[k + 9] & 7) + 1) if d[k + 9] & 0x80 else 0) + 1
        else:
            return None
        while k < len(d) and d[k]:
            k += 1 + d[k]
        k += 1
    return None


def _pdf(d: bytes, at: int) -> int | None:
    """Up to the last end mark before another file begins: each revision adds one, after a cross-reference's place."""
    if not d[at + 5 : at + 6].isdigit():
        return None
    limit = d.find(b"%PDF-", at + 5)
    limit = len(d) if limit < 0 else limit
    last = d.rfind(b"%%EOF", at, limit)
    if last < 0 or d.rfind(b"startxref", at, last) < 0:
        return None
    stop = last + 5
    return stop + (2 if d[stop : stop + 2] == b"\r\n" else 1 if d[stop : stop + 1] in (b"\r", b"\n") else 0)


def _zip(d: bytes, at: int) -> int | None:
    """Members from one local header to the next, then the directory, whose place and size its end record states."""
    k = at
    while d[k : k + 4] == b"PK\x03\x04" and k + 30 <= len(d):
        flags, packed, name, extra = struct.unpack_from("<H10xI4xHH", d, k + 6)
        k += 30 + name + extra + packed
        if flags & 8:  # sizes follow the data: look for the next header
            k = d.find(b"PK", k)
            while k >= 0 and d[k : k + 4] not in (b"PK\x03\x04", b"PK\x01\x02"):
                k = d.find(b"PK", k + 2)
            if k < 0:
                return None
    start = k
    while d[k : k + 4] == b"PK\x01\x02" and k + 46 <= len(d):
        k += 46 + sum(struct.unpack_from("<HHH", d, k + 28))
    if d[k : k + 4] != b"PK\x05\x06" or k + 22 > len(d):
        return None
    size, offset, note = struct.unpack_from("<IIH", d, k + 12)
    return k + 22 + note if (size, offset) == (k - start, start - at) and k + 22 + note <= len(d) else None


def _gzip(d: bytes, at: int) -> int | None:
    """To the end of the member; inflated a piece at a time, none of which is kept."""
    z, view, k = zlib.decompressobj(31), memoryview(d), at
    try:
        while not z.eof:
            if z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, PIECE)
            elif k < len(d):
                z.decompress(view[k : k + PIECE], PIECE)
                k += PIECE
            else:
                return None
    except zlib.error:
        return None
    return min(k, len(d)) - len(z.unused_data)


def _bmp(d: bytes, at: int) -> int | None:
    if len(d) < at + 26:
        return None
    size, _, offset, header = struct.unpack_from("<IIII", d, at + 2)
    return at + size if header in (12, 40, 52, 56, 108, 124) and 14 + header <= offset <= size <= len(d) - at else None


#: Magic bytes, the type they announce and the validator that finds its end.
FORMATS = (
    (_PNG, "image/png", _png), (b"RIFF", "riff", _riff), (b"\xff\xd8\xff", "image/jpeg", _jpeg), (b"GIF8", "image/gif", _gif),
    (b"%PDF-", "application/pdf", _pdf), (b"PK\x03\x04", "application/zip", _zip), (b"\x1f\x8b\x08", "application/gzip", _gzip), (b"BM", "image/bmp", _bmp),
)
_RIFF_KINDS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for magic, kind, valid in FORMATS:
            self.machine.add_word(magic.decode("latin-1"), (len(magic), kind, valid))
        self.machine.make_automaton()

    def find(self, data: bytes) -> list[Found]:
        """Every valid media file in ``data``, outermost first; what lies inside one is not listed."""
        out, free = [], 0
        for end, (size, kind, valid) in self.machine.iter(data.decode("latin-1")):
            at = end - size + 1
            if at >= free and (stop := valid(data, at)):
                out.append(Found(_RIFF_KINDS[data[at + 8 : at + 12]] if kind == "riff" else kind, at, stop))
                free = stop
        return out

    def kind(self, data: bytes) -> str:
        found = self.find(data)
        return found[0].kind if found and found[0].start == 0 else UNKNOWN


def sniffed(rows: DataFrame, media: str, declared: str | None = None) -> DataFrame:
    """Adds ``true_type``, ``corrected`` (the declared type was wrong) and ``embedded`` (type, offset, length, bytes carved from within)."""
    keep = [c for c in rows.columns if c not in ("true_type", "corrected", "embedded")]
    kinds = "true_type string, corrected boolean, embedded array<struct<type: string, offset: long, length: long, data: binary>>"
    own = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("data", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for b in batches:
            types, wrong, inside = [], [], []
            said = b.column(declared).to_pylist() if declared else [None] * b.num_rows
            for cell, word in zip(b.column(media).to_pylist(), said, strict=True):
                found = sniffer.find(cell) if cell is not None else []
                kind = None if cell is None else found[0].kind if found and found[0].start == 0 else UNKNOWN
                types.append(kind)
                wrong.append(bool(declared) and kind is not None and word != kind)
                inside.append([{"type": f.kind, "offset": f.start, "length": f.stop - f.start, "data": cell[f.start : f.stop]} for f in found if f.start])
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inside, own)], names=[*keep, "true_type", "corrected", "embedded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return in_batches(rows.select(*keep)).mapInArrow(run, f"{schema}, {kinds}")


def stored_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as an image, in a table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()]
                media = [to_png(x.ljust(max(1, -(-len(x) // UNIT)) * UNIT, b" ")) for x in raw]
                yield pa.record_batch([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(encode, "doc_id long, n_bytes long, media binary")
    return materialize(rows, "media")


def features(samples: np.ndarray) -> str:
    """Mean and spread of each channel and the number of distinct samples, of whole images."""
    rgb = samples.reshape(-1, 3).astype(np.int64)
    n, s, q = len(rgb), rgb.sum(axis=0), (rgb * rgb).sum(axis=0)
    mean, spread = s / n, np.sqrt(np.maximum(0, q / n - (s / n) ** 2))
    return f"rgb64x{n // PIXELS};mean=" + ",".join(f"{x:.3f}" for x in mean) + ";sd=" + ",".join(f"{x:.3f}" for x in spread) + f";used={np.count_nonzero(np.bincount(samples, minlength=256))}"


def media_columns(docs: DataFrame) -> DataFrame:
    """Stores every text as media, reads it back through the sniffer and digests it.

    Cells are declared as the text that they came from, so the sniffer corrects every one; what media
    a payload holds itself is carved from it (``embedded``: type, offset and length of each).
    """
    types = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, true_type string, corrected boolean, embedded array<struct<type: string, offset: long, length: long>>"

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                rows = []
                for doc_id, n, media in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                    first = next(iter(sniffer.find(media)), None)
                    if first is None or (first.start, first.stop) != (0, len(media)):
                        raise ValueError(f"the stored media of document {doc_id} are damaged")
                    payload = from_png(media)
                    inside = [{"type": f.kind, "offset": f.start, "length": f.stop - f.start} for f in sniffer.find(payload)]
                    rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(np.frombuffer(payload, np.uint8)), first.kind, first.kind != DECLARED, inside))
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "true_type", "corrected", "embedded"]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))]
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return in_batches(stored_media(docs)).mapInArrow(digest, types)
