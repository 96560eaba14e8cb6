"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Folding lowers case, strips accents and characters that don't show (zero-width ones, soft
hyphens), maps look-alike letters, letters in circles and squares and digit or sign
substitutions to one Latin letter (l and i share one, as 1 may mean either) and
everything else to spaces. Letters that spaces part stay words of their own: joining
them would make words of initials. The lexicon holds words and word stems whose document
frequency differs between toxic and clean labelled rows beyond chance; an entry's
weight is its log odds. Exception phrases are the pairs of words around an entry
that occur in clean rows; each cancels the match that it stands around, once, however
many of them do. A text's sum of weights, by itself and in proportion to its length,
goes through a logistic function.

Learning sees at most ``LABELLED`` labelled documents of ``LABELLED_BYTES`` in all, the first
by a hash of the id and one text for each id: that is the documented bound. Scores
cover whole texts.

Defined cases: null or empty texts are scored like any text without entries; rows
without a label, or whose label is null, teach nothing; without toxic labels every
score is 0, with toxic labels but no clean ones every score is 1; a doc_id labelled
twice counts with its largest label, one with several texts teaches its longest (ties:
the last in order). Columns other than doc_id and text are never inputs of a score.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.llm.common import bucket_of, filtered, in_batches

LABELLED, LABELLED_BYTES = 12_000, 64 << 20
STEMS = (4, 5, 6)
#: Natural log of the chance at which a single entry of the lexicon may be there by luck, over all candidates.
LUCK = 3.0
MOST_WEIGHT = 6.0

#: Look-alikes of Latin letters (Cyrillic, Greek) and substitutions by digits.
_ALIKE = dict(zip("авсеніјкморѕтухуԁһԛԝαβεικνορτυχγω0134578", "abceHijkmopstyxydhqwabeiknoptuxywoieastb", strict=True)) | {"н": "h", "l": "i", "ı": "i"}
#: Runs of signs that stand for letters: between letters or digits, or $ and @ before a letter at a word's beginning.
_SIGNED = re.compile(r"(?<=[^\W_])[!|$@]+(?=[^\W_])|(?<![^\W_])[$@]+(?=[^\W\d_])")
#: Characters that don't show, between which signs would not be seen as standing inside a word.
_HIDDEN = re.compile("[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]+")
#: A letter in a circle, square or parentheses, by the end of its character's name.
_FRAMED = re.compile(r"(?:CIRCLED|SQUARED|PARENTHESIZED|REGIONAL INDICATOR) (?:LATIN (?:CAPITAL|SMALL) LETTER|SYMBOL LETTER) ([A-Z])$")
_SIGNS = str.maketrans({"!": "i", "|": "i", "$": "s", "@": "a"})


class _Folding(dict):
    def __missing__(self, code: int) -> str:
        out, framed = "", _FRAMED.search(unicodedata.name(chr(code), ""))
        for c in unicodedata.normalize("NFKD", framed[1].lower() if framed else chr(code).lower()):
            if unicodedata.combining(c):
                continue
            c = _ALIKE.get(c, c)
            out += c if c.isalnum() else " "
        if unicodedata.combining(chr(code)) or unicodedata.category(chr(code)) == "Cf":
            out = ""
        self[code] = out
        return out


_FOLDING = _Folding()


def fold(text: str | None) -> str:
    """' word word ' of the folded text, single spaces around each word; ' ' if there is none."""
    if not text:
        return " "
    text = _HIDDEN.sub("", text)
    text = _SIGNED.sub(lambda m: m[0].translate(_SIGNS), text)
    words = text.translate(_FOLDING).split()
    return f" {' '.join(words)} " if words else " "


def _forms(folded: str) -> set[str]:
    """Entries that a text holds: ' word ' and ' stem'."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for n in STEMS:
        out.update({" " + w[:n] for w in words if len(w) >= n})
    return out


def _gain(k: int, n: int, c: int, m: int) -> float:
    """Log likelihood ratio that k of n toxic and c of m clean rows differ in chance."""

    def part(x: float, of: float) -> float:
        return x * math.log(x / of) if x else 0.0

    p = (k + c) / (n + m)
    return part(k, n * p) + part(n - k, n * (1 - p)) + part(c, m * p) + part(m - c, m * (1 - p)) if 0 < p < 1 else 0.0


class Lexicon:
    """entries with weights, exceptions (phrase to the entry it excuses and where that begins), and the logistic function over a text's sum."""

    def __init__(self, entries: dict[str, float], exceptions: dict[str, tuple[int, str]], curve: np.ndarray):
        self.entries, self.exceptions, self.curve, self.machine = entries, exceptions, curve, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"machine": None}

    def matches(self, folded: str) -> list[tuple[int, str]]:
        """Place and entry of every match that no exception around it cancels."""
        if self.machine is None:
            import ahocorasick

            self.machine = ahocorasick.Automaton()
            for phrase in self.entries.keys() | self.exceptions.keys():
                self.machine.add_word(phrase, phrase)
            if len(self.machine):
                self.machine.make_automaton()
        found, excused = [], set()
        for end, phrase in self.machine.iter(folded) if len(self.machine) else ():
            at = end - len(phrase) + 1
            if phrase in self.entries:
                found.append((at, phrase))
            if phrase in self.exceptions:
                offset, entry = self.exceptions[phrase]
                excused.add((at + offset, entry))
        return [x for x in found if x not in excused]

    def total(self, folded: str) -> float:
        return sum(self.entries[entry] for _, entry in self.matches(folded))

    def features(self, folded: str) -> list[float]:
        s, n = self.total(folded), folded.count(" ")
        return [1.0, math.log1p(s), math.log1p(100 * s / max(n, 10))]

    def score(self, text: str | None) -> float:
        z = float(np.dot(self.features(fold(text)), self.curve))
        return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def _lexicon(toxic: list[str], clean: list[str]) -> dict[str, float]:
    found = Counter()
    for t in toxic:
        found.update(_forms(t))
    found = {w: k for w, k in found.items() if k >= 4}
    against: Counter = Counter()
    for t in clean:
        against.update(found.keys() & _forms(t))
    n, m = len(toxic), len(clean)
    least = math.log(max(len(found), 1)) + LUCK
    good = {}
    for w, k in found.items():
        c = against[w]
        odds = math.log((k + 0.5) / (n + 1)) - math.log((c + 0.5) / (m + 1))
        if odds >= 2 and _gain(k, n, c, m) >= least:
            good[w] = (k, c, odds)
    kept: dict[str, tuple[int, int, float]] = {}
    for w in sorted(good, key=len):
        above = next((w[:i] for i in range(len(w) - 1, 1, -1) if w[:i] in kept), None)
        if above is None:
            kept[w] = good[w]
        elif kept[above][0] <= 1.05 * good[w][0]:  # the longer form has nearly all of it
            del kept[above]
            kept[w] = good[w]
    return {w: min(x, MOST_WEIGHT) for w, (_, _, x) in kept.items()}


def _exceptions(entries: dict[str, float], toxic: list[str], clean: list[str]) -> dict[str, tuple[int, str]]:
    """Pairs of words around an entry that mark it as harmless."""
    lexicon = Lexicon(entries, {}, np.zeros(3))

    def around(t: str) -> set[tuple[str, int, str]]:
        out = set()
        for start, entry in lexicon.matches(t):
            stop = t.find(" ", start + 1)
            after, before = t.find(" ", stop + 1), t.rfind(" ", 0, start)
            if after > 0:
                out.add((t[start : after + 1], 0, entry))
            if before >= 0:
                out.add((t[before : stop + 1], start - before, entry))
        return out

    harmless, harmful = Counter(p for t in clean for p in around(t)), Counter(p for t in toxic for p in around(t))
    n, m = len(toxic), len(clean)
    return {phrase: (offset, entry) for (phrase, offset, entry), c in sorted(harmless.items()) if c >= 3 and c / m > 3 * (harmful[phrase, offset, entry] + 0.5) / n}


def _once(folded: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One of each group of texts with the same label and the same set of words; all others stay."""
    seen = {}
    for t, y in folded:
        seen.setdefault((y, hashlib.blake2b(" ".join(sorted(set(t.split()))).encode("utf-8", "surrogatepass"), digest_size=16).digest()), t)
    return [(t, k[0]) for k, t in seen.items()]


def learn(rows: list[tuple[str | None, int]]) -> Lexicon:
    folded = _once([(fold(t), y) for t, y in rows])
    toxic, clean = [t for t, y in folded if y == 1], [t for t, y in folded if y == 0]
    if not toxic or not clean:
        return Lexicon({}, {}, np.array([-1e9 if not toxic else 1e9, 0, 0], float))
    entries = _lexicon(toxic, clean)
    lexicon = Lexicon(entries, _exceptions(entries, toxic, clean), np.zeros(3))
    x, y = np.array([lexicon.features(t) for t, _ in folded]), np.array([float(v == 1) for _, v in folded])
    w = np.zeros(3)
    for _ in range(50):  # Newton's steps on the ridge-penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-3, 1e-1, 1e-1])
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    lexicon.curve = w
    return lexicon


def labelled_rows(docs: DataFrame, labels: DataFrame, admit) -> list[tuple[str | None, int]]:
    """(text, label) of the documents that ``admit`` lets through, within the bound: the first by hash, one text for each id."""
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    marks = marks.where(admit(F.col("_id"))).withColumn("_turn", F.xxhash64("_id")).orderBy("_turn", "_id").limit(LABELLED)
    few = F.broadcast(marks)  # LABELLED rows at most, 20 bytes each
    one = F.max(F.struct(F.octet_length("text").alias("size"), "text")).alias("x")
    rows = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("_id")).groupBy("_id", "_toxic", "_turn").agg(one)
    out, left = [], LABELLED_BYTES
    for r in rows.select("_turn", "_id", "_toxic", F.coalesce("x.size", F.lit(0)).alias("size"), "x.text").orderBy("_turn", "_id").toLocalIterator(prefetchPartitions=False):
        left -= r["size"]
        if left < 0:
            break
        out.append((r["text"], r["_toxic"]))
    return out


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # a few hundred entries

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([own.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(score, "doc_id long, score double")


def kept_rows(docs: DataFrame, lexicon: Lexicon, most: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score under ``most``."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    return filtered(docs, lambda texts: [held.value.score(t) < most for t in texts])


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns where crc32(doc_id as text) mod 5 is not 0."""
    lexicon = learn(labelled_rows(docs, labels, lambda i: F.crc32(i.cast("string")) % 5 != 0))
    held_out = F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))
    return scores(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
