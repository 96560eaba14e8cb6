"""Mixing sources to target weights, with DataFrame functions only.

Rows get hash-random keys. A key's leading bits give its range of keys within
its source (the keys are uniform, so ranges of equal width hold about equally
many rows and need no sampling), each range is sorted on its own, and prefix
sums over the ranges' totals make the running total distributed: a source with
a third of all rows is spread over ``RANGES`` sorts. Every source is then cut at
its exact budget, after whole epochs.

Defined cases: a null or empty text has size 0 and is never taken; a null source
is a source of its own, last in order; rows that repeat a doc_id are separate
rows with the same key, ordered among themselves by size; rows without a doc_id get
their keys from their texts; an empty table gives an empty mix. Targets are
windows over one row for each source, in one task: that holds for some millions of sources. Only the columns named in the arguments are read, so extra columns
of any name do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanlode.llm.common import WORD, materialize, numbered

#: Weights by source in code-point order, null last, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's share of all words, and the most that a source may repeat.
SHARE, MOST_EPOCHS = 1.5, 2
#: Key ranges within a source; each is sorted by itself.
RANGES = 1024


def n_words(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets of ``sizes(source, source_size)``: shares by weight, capped at ``epochs`` times the size.

    Sharing the excess anew until none is above has a closed form: with sources
    sorted by cap / weight, the first k are capped and the rest get the level
    (T - caps of the first k) / (their weights), for the least k at which the
    level fits under the next cap. The level rises up to that k and falls after
    it, so it is the greatest. One row per source, so the window is small.
    """
    numbered = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(numbered) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before, every = by_level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    rows = rows.withColumns(
        {
            "total": F.sum("source_size").over(every) * F.lit(share),
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "rest": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    target = F.least(F.col("cap"), F.col("weight") * F.max("level").over(every))
    return rows.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: words of each row that the mix takes, repeats counted.

    The same rows give the same result at any partitioning.
    """
    return _taken(docs, [], seed, weights, share, epochs)


def _taken(docs: DataFrame, keys: list[str], seed: int, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = MOST_EPOCHS) -> DataFrame:
    """The columns of ``mix``, and ``keys``, which tell rows apart that repeat a doc_id at one size."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), F.md5(F.coalesce("text", F.lit("")))))
    key = F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 16)
    keyed = docs.select("doc_id", "source", n_words().alias("size"), key.alias("key"), *keys)
    keyed = keyed.withColumn("range", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("int") * RANGES / 65536).cast("int"))
    keyed = materialize(keyed, "mix-keys")  # texts are read and counted once, for the totals and for the cut
    totals = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(totals.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, epochs)
    ranged = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.withColumn("range_start", F.coalesce(F.sum("range_size").over(ranged), F.lit(0)).cast("long"))
    starts = starts.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    starts = starts.select(F.col("s.source").alias("of"), F.col("s.range").alias("in_range"), "range_start", "source_size", "target")
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *keys).rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)).cast("long"))
    run = run.join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in_range")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target")).cast("long") - whole * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("range_start") - F.col("inside")))
    return run.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), (whole * F.col("size") + part).cast("long").alias("taken"), *keys)


def mixed_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time that a document is taken.

    A source's boundary document is cut after its last taken word; ``n_chars``,
    if there, is counted anew. Rows that repeat a doc_id, or have none, are taken each
    by its own source, size and turn.
    """
    keyed, key = numbered(docs, "mix-rows")
    of, n, words, turn = (f"{key}_{x}" for x in ("of", "n", "words", "turn"))
    taken = _taken(keyed, [key], seed).where("taken > 0").select(F.col(key).alias(of), F.col("taken").alias(n), F.col("size").alias(words))
    rows = keyed.join(taken, F.col(key) == F.col(of))
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(1), F.ceil(F.col(n) / F.col(words)).cast("int"))))
    left = F.least(F.col(words), F.col(n) - (F.col(turn) - 1) * F.col(words)).cast("int")
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), 1, left), "")
    text = F.when(left < F.col(words), cut).otherwise(F.col("text"))
    fresh = {"text": text}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(left < F.col(words), F.length(cut)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.withColumns(fresh).select(*docs.columns)
