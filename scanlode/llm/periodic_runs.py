"""Runs (maximal repetitions) of the words of each text, by the runs theorem.

Every run holds, from some place on, the longest Lyndon word that begins there under
one of two orders of the words: the usual one and its reverse. So for each place and
order there is one candidate only:

1. the suffixes of all texts of a slice are sorted at once (prefix doubling over those
   still tied; a text's suffixes stand apart from another's), which gives the inverse
   suffix array of each order;
2. the longest Lyndon word at a place ends before the next smaller value of that array;
3. LCP arrays (from the suffix array; only irreducible values are compared word by word)
   with a sparse table of minima answer how far a root's period goes on to the right and,
   on the reversed words of those texts that still have candidates, to the left;
4. equal (start, period) are one run.

Everything is a numpy operation over a whole slice of texts; nothing is quadratic in a
text, and memory is linear in it (some 500 bytes a word): the levels of the sparse table are made one after
another, and the questions of a level are answered when it stands.

Only runs with ``LEAST`` words and ``TIMES`` periods are asked for. In such a run some
root repeats at least twice behind itself, so shorter extensions are dropped early.

Defined cases: null and empty texts and those of white space have no words and no runs;
a null doc_id draws no changed words; repeated rows are rows of their own; an empty table
gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.llm.common import in_batches

#: The shortest run in words and in periods.
LEAST, TIMES = 6, 4
#: Bytes of the texts that are handled at once; a longer text is a slice of its own.
SLICE = 1 << 20
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def suffix_ranks(words: np.ndarray, text: np.ndarray, end: np.ndarray, end_first: bool = True) -> np.ndarray:
    """The inverse suffix array of all texts in one: place of each suffix among all, texts one after another.

    ``end``: where each place's text ends; a suffix that is another's beginning comes before it, or after it without ``end_first``.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    beyond = -1 if end_first else n
    key = text * (int(words.max()) + 1) + words
    open_ = np.argsort(key, kind="stable")
    rank, old, new = np.zeros(n, np.int64), np.zeros(n, np.int64), key[open_]
    step = 0
    while len(open_):
        # Of each group of equal keys the first place in the order is its rank.
        fresh = np.ones(len(open_), bool)
        fresh[1:] = (new[1:] != new[:-1]) | (old[1:] != old[:-1])
        at = np.flatnonzero(fresh)
        size = np.diff(np.append(at, len(open_)))
        if step:
            group = np.ones(len(open_), bool)
            group[1:] = old[1:] != old[:-1]
            first = np.flatnonzero(group)
            base = np.repeat(first, np.diff(np.append(first, len(open_))))
            rank[open_] = old + np.repeat(at, size) - base
        else:
            rank[open_] = np.repeat(at, size)
        open_ = open_[np.repeat(size > 1, size)]
        step = 2 * step or 1
        behind = open_ + step
        there = behind < end[open_]
        follow = np.where(there, rank[np.where(there, behind, 0)], beyond) + 1
        old = rank[open_]
        order = np.argsort(old * (n + 2) + follow)
        open_, old, new = open_[order], old[order], follow[order]
    return rank


def next_smaller(rank: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each place the next one of its text with a smaller rank, else the text's end: places jump over what those they meet have jumped."""
    n = len(rank)
    to, padded = np.arange(1, n + 1), np.append(rank, -1)
    open_ = np.flatnonzero((to < end) & (padded[to] > rank))
    while len(open_) > 64:
        to[open_] = to[to[open_]]
        met = to[open_]
        open_ = open_[(met < end[open_]) & (padded[met] > rank[open_])]
    for i in open_[::-1].tolist():  # the few that have far to go
        j, value, stop = int(to[i]), rank[i], end[i]
        while j < stop and padded[j] > value:
            j = int(to[j])
        to[i] = j
    return to


def lcp_array(words: np.ndarray, rank: np.ndarray, end: np.ndarray) -> np.ndarray:
    """At each rank how many words its suffix shares with the one before, within the same text.

    Where the words in front of both are equal too, the value is one less than the place before has; the
    others are compared, and they add up to n log n at most.
    """
    n = len(words)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    before[(before >= 0) & (end[before] != end)] = -1
    here = np.flatnonzero(before >= 0)
    i, j = here, before[here]
    front = (i > 0) & (j > 0)
    same = np.zeros(len(i), bool)
    same[front] = (words[i[front] - 1] == words[j[front] - 1]) & (end[i[front] - 1] == end[i[front]]) & (end[j[front] - 1] == end[j[front]])
    # The suffixes in front must be neighbours too.
    same[same] = before[i[same] - 1] == j[same] - 1
    own = np.zeros(n, np.int64)
    left = here[~same]
    for k in range(32):
        a, b = left + k, before[left] + k
        on = (a < end[left]) & (b < end[left])
        on[on] = words[a[on]] == words[b[on]]
        left = left[on]
        own[left] += 1
        if not len(left):
            break
    for p in left.tolist():
        own[p] += _shared(words, p + own[p], before[p] + own[p], end[p])
    known = np.where(before >= 0, own, 0)
    alone = np.ones(n, bool)
    alone[here[same]] = False
    source = np.maximum.accumulate(np.where(alone, np.arange(n), 0))
    known = np.where(alone, known, known[source] - (np.arange(n) - source))
    out = np.zeros(n, np.int64)
    out[rank] = known
    return out


def _shared(words: np.ndarray, i: int, j: int, end: int) -> int:
    """Length of the common beginning of two suffixes, in growing blocks."""
    done, block = 0, 64
    while True:
        size = min(block, end - max(i, j) - done)
        if size <= 0:
            return done
        differs = words[i + done : i + done + size] != words[j + done : j + done + size]
        if differs.any():
            return done + int(differs.argmax())
        done, block = done + size, 2 * block


def range_minima(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of values[low..high] for each pair: a sparse table whose levels follow one another."""
    level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    order = np.argsort(level, kind="stable")
    bounds = np.searchsorted(level[order], np.arange(int(level.max()) + 2) if len(level) else [0])
    out, table = np.zeros(len(low), values.dtype), values
    for k in range(len(bounds) - 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        asked = order[bounds[k] : bounds[k + 1]]
        out[asked] = np.minimum(table[low[asked]], table[high[asked] - (1 << k) + 1])
    return out


def extension(lcp: np.ndarray, rank: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words the suffixes at i and j of the same text share."""
    a, b = np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j])
    return range_minima(lcp, a + 1, b)


def roots(words: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, period, words that go on to the right: Lyndon roots that are repeated twice at least behind themselves."""
    found = []
    rank = suffix_ranks(words, text, end)
    lcp = None
    for order in (rank, None):
        if order is None:  # under the reversed order of words an end still comes first
            order = (len(words) - 1) - suffix_ranks(words, text, end, end_first=False)
        i = np.arange(len(words))
        j = next_smaller(order, end)
        period = j - i
        near = np.flatnonzero(i + (TIMES - 1) * period <= end)  # room for the repeats
        near = near[(j[near] < end[near])]
        near = near[words[i[near]] == words[j[near]]]
        if len(near):
            lcp = lcp_array(words, rank, end) if lcp is None else lcp
            on = extension(lcp, rank, near, j[near])
            keep = on >= 2 * period[near]
            found.append((near[keep], period[near][keep], on[keep]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


def runs_of(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, start (in all words), length, period of each run, by text, start and period; ``starts``: where each text begins, and the end."""
    sizes = np.diff(starts)
    text, end = np.repeat(np.arange(len(sizes)), sizes), np.repeat(starts[1:], sizes)
    i, period, right = roots(words, text, end)
    # To the left: on the reversed words of the texts that have roots.
    back = np.zeros(len(i), np.int64)
    has = np.unique(text[i])
    if len(has):
        part = np.concatenate([np.arange(starts[t + 1] - 1, starts[t] - 1, -1) for t in has])
        own_sizes = sizes[has]
        own_starts = np.concatenate(([0], np.cumsum(own_sizes)))
        own_text, own_end = np.repeat(np.arange(len(has)), own_sizes), np.repeat(own_starts[1:], own_sizes)
        turned = words[part]
        rank = suffix_ranks(turned, own_text, own_end)
        lcp = lcp_array(turned, rank, own_end)
        at = np.searchsorted(has, text[i])
        # The word before i stands here; none before a text's first.
        place = own_starts[at] + (starts[has][at] + own_sizes[at] - 1) - (i - 1)
        inner = np.flatnonzero(i > starts[text[i]])
        back[inner] = extension(lcp, rank, place[inner], place[inner] - period[inner])
    start, length = i - back, period + right + back
    keep = (length >= LEAST) & (length >= TIMES * period)
    found = np.unique(np.stack([text[i], start, period, length], axis=1)[keep], axis=0)
    return found[:, 0], found[:, 1], found[:, 3], found[:, 2]


def drawn(words: np.ndarray, doc_id: int | None) -> np.ndarray:
    """The words, or for a tenth of all ids those with a repeated tail."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def report(doc_ids: list[int | None], texts: pa.Array) -> pa.RecordBatch:
    """A row of ``RESULT`` for each text of a slice."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, parents = split.flatten(), pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    some = pc.greater(pc.binary_length(flat), 0)  # an edge of white space leaves an empty word
    flat, parents = flat.filter(some), parents[some.to_numpy(zero_copy_only=False)]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.searchsorted(parents, np.arange(len(doc_ids) + 1))
    words = np.concatenate([drawn(codes[a:b], d) for d, a, b in zip(doc_ids, starts, starts[1:])]) if len(doc_ids) else codes
    text, start, length, period = runs_of(words, starts)
    # Kept words: what lies in a run behind its first period goes.
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    spelt = coded.dictionary.take(pa.array(words[kept]))
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, starts), pa.int32()), spelt), " ")
    first = np.searchsorted(text, np.arange(len(doc_ids) + 1))
    columns: dict[str, list] = {name: [] for name in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    for d in range(len(doc_ids)):
        own = slice(first[d], first[d + 1])
        s, n, p = (start[own] - starts[d]).tolist(), length[own].tolist(), period[own].tolist()
        best = min(range(len(s)), key=lambda k: (-n[k], s[k], p[k]), default=None)
        told = (None,) * 4 if best is None else (s[best], n[best], p[best], 1000 * n[best] // p[best])
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in zip(s, n, p, strict=True))
        values = (len(s), *told, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(lines[d].as_buffer()).hexdigest())
        for column, value in zip(columns.values(), values, strict=True):
            column.append(value)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.record_batch([pa.array(doc_ids, pa.int64()), *(pa.array(c, k) for c, k in zip(columns.values(), kinds, strict=True))], names=["doc_id", *columns])


def sliced(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of about ``SLICE`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``RESULT``, a row for each row of ``docs``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                yield report(part.column(0).to_pylist(), part.column(1))

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, RESULT)
