"""Exact byte-pair encoding at bulk speed: each distinct white-space chunk goes through the tokenizers library once.

The vocabulary's own rules never join characters across white space, so a
document's ids are those of its chunks in order. A bounded cache holds the ids
of chunks seen before. Texts for which this does not hold for certain (control
characters that Python takes for white space and the library does not) go
through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable

import numpy as np

#: Chunks in a generation of the cache, and the longest that is kept. A full generation becomes
#: the older one, from which what is met again moves up.
CACHE_ENTRIES, CACHE_CHARS = 350_000, 40
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\u180e]")
_BEYOND_LATIN = re.compile("[^\x00-\xff]")
#: A full stop or comma that ends a chunk and belongs to a run of marks.
_MARKS = re.compile(r"(?:[^\w\s]|_)[.,][ \n]")
#: One pre-token of the vocabulary, or one before a full stop or comma.
_PLAIN = re.compile("([A-Za-zß-öø-ÿ]+)([.,]?)")


class _Chunks(dict):
    """White-space chunk to its ids; a chunk not yet known is encoded by the library."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        super().__init__()
        tokenizer = Tokenizer.from_file(vocabulary)
        if tokenizer.get_vocab_size() > 65536:
            raise ValueError("ids of this vocabulary don't fit 16 bits")
        self.encode, self.tokenize = tokenizer.encode, tokenizer.model.tokenize
        try:
            self.letters = {ord(x): y for x, y in _byte_letters(tokenizer)}
        except (AttributeError, IndexError, TypeError):  # a vocabulary without byte letters; the probes then rule chunks out
            self.letters = {}
        self.marks = {m: self.whole(m) for m in ".,"} | {"": b""}
        self.packed = [i.to_bytes(2, "little") for i in range(tokenizer.get_vocab_size())]
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def word(self, word: str) -> bytes:
        """One lower-case pre-token: straight to the library's merges."""
        spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.tokenize(spelt)])

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            m = _PLAIN.fullmatch(chunk)
            if m is None:
                ids = self.whole(chunk)
            elif m[2]:
                ids = self[m[1]] + self.marks[m[2]]
            else:
                ids = self.word(chunk.lower())
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


def _byte_letters(tokenizer) -> list[tuple[str, str]]:
    """The letter by which the vocabulary spells each byte of a non-ASCII letter."""
    out = []
    for b in range(0x80, 0x100):
        if 0xC2 <= b <= 0xC3:
            spelt = tokenizer.pre_tokenizer.pre_tokenize_str(bytes([b, 0xA1 if b == 0xC3 else 0xAA]).decode())[0][0]
            out.append((chr(b), spelt[0]))
        elif b < 0xC0:
            spelt = tokenizer.pre_tokenizer.pre_tokenize_str(bytes([0xC3, b]).decode())
            out.append((chr(b), spelt[0][0][1]))
    return out


#: The rules under which chunks between white space are encoded each by itself and in lower case: fixed values of the public vocabulary.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def separable(vocabulary: str) -> bool:
    """Whether a vocabulary's own rules say that no id reaches across white space, and that case and single marks split as ``Encoder`` has it."""
    with open(vocabulary, encoding="utf-8") as f:
        rules = json.load(f)
    normal, split, model = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    return normal.get("normalizers") == _NORMALIZERS and split.get("pretokenizers") == _PRE_TOKENIZERS and model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not rules.get("post_processor")


class Encoder:
    """``ids(texts)``: little-endian unsigned 16-bit ids of each text (null: none), as bytes."""

    #: Texts that a vocabulary of these rules must encode by chunks as it does whole, or chunks are not used with it.
    PROBES = ("The quick, brown fox's 12 jumps. Über\nGrößen; ça... va?!", "a  b\tc", " x", "Don't stop - it's 3.14, no.", "étude ÉTUDE ß ÿ")

    def __init__(self, vocabulary: str):
        self.chunks = _Chunks(vocabulary)
        self.get = self.chunks.__getitem__
        if not separable(vocabulary) or any(self.one(t) != self.chunks.whole(t) for t in self.PROBES):
            self.one = lambda text: self.chunks.whole(text or "")

    def one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self.chunks.whole(text)
        if not _BEYOND_LATIN.search(text) and "<|" not in text:
            # The library lowers these letters as Python does, and sets single marks apart anyway: fewer different chunks.
            text = text.lower()
            if not _MARKS.search(text):
                text = text.replace(", ", " , ").replace(". ", " . ").replace(".\n", " .\n")
        return b"".join(map(self.get, text.split()))

    def ids(self, texts: Iterable[str | None]) -> list[bytes]:
        return list(map(self.one, texts))


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]
