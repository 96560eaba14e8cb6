"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of widths 2, 3 and 4 over one-hot bytes are sums of table rows, one table
per place in the filter, so applying one is a gather and an addition; neighbouring
places are folded into tables over byte pairs. Each filter's maximum over a
window of ``WINDOW`` bytes goes through a rectifier and a softmax layer. A text is
all of its windows, side by side and padded with zeros; its languages' log
probabilities are averaged over the windows, weighted by their bytes.

Training sees at most ``PER_LANGUAGE`` texts of each language (chosen by a hash of id
and text) and ``WINDOWS`` windows of each; that is the documented bound, and nothing
else is sampled. ASCII digits, punctuation and case are folded first, so the
network learns letters.

Defined cases: a null text, or one without any letter, is ``und`` with score 0; a
table without labelled rows gives ``und`` everywhere. Columns other than doc_id
and text are never inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlode.llm.common import bucket_of, filtered, in_batches

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANGUAGE, WINDOWS, EPOCHS, BATCH = 400, 6, 10, 128
#: Windows that go through the network at a time.
AT_ONCE = 512
UNKNOWN = "und"

_FOLD = bytearray(range(256))
for _b in range(128):
    _c = chr(_b)
    _FOLD[_b] = ord(_c.lower()) if _c.isalpha() else 32
_FOLD = bytes(_FOLD)


def windows_of(text: str) -> np.ndarray:
    """All windows of a text, n x WINDOW; runs of anything but letters become one space."""
    raw = b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split())
    n = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


class ByteNet:
    """tables[w][k]: 256 x FILTERS, what a byte at place k adds to the filters of width w; then a softmax layer."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.tables = {w: [rng.normal(0, 0.3, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS}
        n = FILTERS * len(WIDTHS)
        self.top = rng.normal(0, 0.1, (n, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "pairs"}

    def freeze(self) -> ByteNet:
        """Folds neighbouring places into tables over byte pairs, 65,536 x FILTERS; once per process."""
        if "pairs" in self.__dict__:
            return self
        self.pairs = {}
        for w, t in self.tables.items():
            self.pairs[w] = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)]
        return self

    def responses(self, x: np.ndarray) -> dict[int, np.ndarray]:
        """n x places x FILTERS for each width."""
        out = {}
        for w, t in self.tables.items():
            places = WINDOW - w + 1
            r = t[0][x[:, :places]]
            for k in range(1, w):
                r += t[k][x[:, k : k + places]]
            out[w] = r
        return out

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Each filter's maximum over the window, by the folded tables."""
        both = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out = np.empty((len(x), FILTERS * len(WIDTHS)), np.float32)
        for i, w in enumerate(WIDTHS):
            places = WINDOW - w + 1
            r = np.take(self.pairs[w][0], both[:, :places], axis=0)
            if w == 3:
                r += np.take(self.tables[3][2], x[:, 2 : 2 + places], axis=0)
            elif w == 4:
                r += np.take(self.pairs[4][1], both[:, 2 : 2 + places], axis=0)
            n = places
            while n > 1:  # halves against halves: long contiguous runs
                half = n // 2
                np.maximum(r[:, :half], r[:, n - half : n], out=r[:, :half])
                n -= half
            out[:, i * FILTERS : (i + 1) * FILTERS] = r[:, 0]
        return np.maximum(out, 0)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.top + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> ByteNet:
        """Cross entropy by Adagrad; the gradient reaches only the places that won the pooling."""
        rng = np.random.default_rng(seed)
        memory = {w: [np.full_like(t, 1e-3) for t in ts] for w, ts in self.tables.items()}
        top_memory, bias_memory = np.full_like(self.top, 1e-3), np.full_like(self.bias, 1e-3)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                pick = order[at : at + BATCH]
                b, n = x[pick], len(pick)
                best, peak = {}, []
                for w, r in self.responses(b).items():
                    best[w] = r.argmax(axis=1)
                    peak.append(np.take_along_axis(r, best[w][:, None, :], axis=1)[:, 0])
                raw = np.concatenate(peak, axis=1)
                h = np.maximum(raw, 0)
                z = h @ self.top + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(n), y[pick]] -= 1
                p /= n
                back = (p @ self.top.T) * (raw > 0)
                for value, grad, mem in ((self.top, h.T @ p, top_memory), (self.bias, p.sum(axis=0), bias_memory)):
                    mem += grad * grad
                    value -= 0.05 * grad / np.sqrt(mem)
                rows, f = np.arange(n)[:, None], np.arange(FILTERS)[None, :]
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        grad = np.zeros((256, FILTERS), np.float32)
                        np.add.at(grad, (b[rows, best[w] + k], np.broadcast_to(f, g.shape)), g)
                        memory[w][k] += grad * grad
                        self.tables[w][k] -= 0.05 * grad / np.sqrt(memory[w][k])
        return self


def _drawn_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most ``WINDOWS`` windows of each text, drawn by its turn; none of a text without a letter."""
    for batch in batches:
        langs, turns, out = [], [], []
        for lang, turn, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if has_letter(text):
                own = windows_of(text)
                langs.append(lang)
                turns.append(turn)
                out.append(own[np.random.default_rng(turn % 2**63).permutation(len(own))[:WINDOWS]].tobytes())
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(turns, pa.int64()), pa.array(out, pa.binary())], names=["lang", "turn", "windows"])


def training_rows(docs: DataFrame, learn) -> list[tuple[str, np.ndarray]]:
    """(lang, windows) of at most ``PER_LANGUAGE`` texts of each language among the rows that ``learn`` admits.

    Tasks cut the windows, so a text brings ``WINDOWS`` of ``WINDOW`` bytes to the driver at most; rows that
    repeat an id and its text are one.
    """
    own = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * PER_LANGUAGE / n))])
    turn = F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(3))
    drawn = own.select("lang", turn.alias("turn"), "text").where(F.pmod("turn", F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")])
    cut = in_batches(drawn).mapInArrow(_drawn_windows, "lang string, turn long, windows binary").dropDuplicates(["lang", "turn"])
    first = Window.partitionBy("lang").orderBy("turn")  # some hundreds of rows of a language
    rows = cut.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= PER_LANGUAGE).orderBy("lang", "turn").select("lang", "windows").collect()
    return [(r["lang"], np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW)) for r in rows]


def train(rows: list[tuple[str, np.ndarray]], seed: int = 4) -> ByteNet | None:
    """A network fitted to (lang, windows); None without rows."""
    if not rows:
        return None
    languages = sorted({k for k, _ in rows})
    rng = np.random.default_rng(seed)
    x = np.concatenate([w for _, w in rows])
    y = np.concatenate([np.full(len(w), languages.index(k)) for k, w in rows])
    # Each window also counts cut short, so that short texts are known too.
    short = x.copy()
    short[np.arange(WINDOW)[None, :] >= rng.integers(8, WINDOW, len(x))[:, None]] = 0
    return ByteNet(languages).fit(np.concatenate([x, short]), np.concatenate([y, y]))


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """The columns of ``docs`` that are named doc_id and text in, (doc_id, lang_pred, score) out; every window counts."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(net)  # about 60 KB

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        if model is not None:
            model.freeze()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                langs, scores = _predict(model, b.column(1).to_pylist())
                yield pa.record_batch([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return in_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")


def _predict(model: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores, parts, owner = [UNKNOWN] * len(texts), [0.0] * len(texts), [], []
    for i, t in enumerate(texts):
        if model is not None and t and has_letter(t):
            parts.append(windows_of(t))
            owner += [i] * len(parts[-1])
    if parts:
        x, owner = np.concatenate(parts), np.array(owner)
        weight = (x != 0).sum(axis=1)
        logs = np.concatenate([model.log_probabilities(x[k : k + AT_ONCE]) for k in range(0, len(x), AT_ONCE)])
        total = np.zeros((len(texts), logs.shape[1]))
        np.add.at(total, owner, logs * weight[:, None])
        size = np.bincount(owner, weight, len(texts))
        for i in np.unique(owner).tolist():
            p = total[i] / size[i]
            p = np.exp(p - p.max())
            p /= p.sum()
            k = int(p.argmax())
            langs[i], scores[i] = model.languages[k], float(p[k])
    return langs, scores


def kept_rows(docs: DataFrame, net: ByteNet | None, least: float) -> DataFrame:
    """The rows, with all their columns, whose language is known with a score of ``least`` or more.

    Without a model (no row has both a language and a text) those whose text has a letter.
    """
    if net is None:
        return filtered(docs, lambda texts: [bool(t) and has_letter(t) for t in texts])
    held = docs.sparkSession.sparkContext.broadcast(net)

    def keep(texts: list[str | None]) -> list[bool]:
        langs, scores = _predict(held.value and held.value.freeze(), texts)
        return [k != UNKNOWN and s >= least for k, s in zip(langs, scores, strict=True)]

    return filtered(docs, keep)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns where crc32(doc_id as text) mod 4 is not 2."""
    fold = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    net = train(training_rows(docs, ~fold))
    return identify(docs, net).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
