"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact check of survivors.

1. Each document's set of 5-word shingles gives a signature and a 128-bit digest
   of the set. Documents with equal sets form a class; only its least row goes on,
   by a row key, since ids may be null or repeat.
2. Bands of the signature put classes in buckets. A bucket's least class is its
   hub and meets every other member: no pairs within a bucket are emitted.
3. A pair's signatures are compared batch by batch. It is dropped as soon as the
   posterior probability of a similarity of ``NEAR`` or more falls under ``MISS``.
   Survivors are confirmed on their full sets.
4. Links give components. In buckets that still hold members of several components
   the largest component is compared with the rest, and the rest with itself, in
   blocks of ``BLOCK`` members (pairs of blocks are units of their own, so a large bucket
   is many tasks), skipping pairs that are linked already or that meet in an earlier
   band; what survives is confirmed on full sets within its unit, and the
   components are final. What is sent grows with a bucket's size times the blocks of
   its strangers; only strangers among themselves are quadratic.

A pair at a similarity of exactly 0.85 shares no band with probability
(1 - 0.85^5)^24 = 8e-7, and less above. Shingles, band keys and units are 64-bit hashes
and a set's digest has 128 bits: two of n shingles of a pair of documents fall together
with chance n^2 / 2^65, two of 10^10 sets with chance 2e-19.

Defined cases: a document without words or text has an empty set and links with
nothing; fewer than five words count as one shingle; rows that repeat a doc_id
are one document as far as links go, whatever their texts; a null doc_id row is a
document of its own, linked by its text and not kept if its group has an id; of a
group without ids one row is kept, with a null component_id; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.llm.common import discard, in_batches, materialize, numbered
from scanlode.llm.components import components
from scanlode.llm.shingles import forget, mixed, shingle_set

#: Links are 100 * intersection >= NEAR_PERCENT * union.
NEAR_PERCENT = 85
ROWS, BANDS = 5, 24
HASHES = ROWS * BANDS
#: Hashes compared before each decision, and the chance at which a pair may be dropped wrongly.
STEP, MISS = 20, 1e-7
#: Members of a block of a bucket, and of a split of a hub's members.
BLOCK, SPLIT = 256, 256
#: Ids up to which the wanted rows of a large table are found by a broadcast (8 bytes each); beyond it they are joined.
BROADCAST_IDS = 1_000_000

_rng = np.random.default_rng(85)
_A = _rng.integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    v = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(v), 4096):
        x = v[at : at + 4096, None] * _A
        x += _B
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(out, x.min(axis=0), out=out)
    return out


def least_matches(near: float = NEAR_PERCENT / 100, miss: float = MISS) -> dict[int, int]:
    """By number of hashes compared, the least matches at which a pair stays.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1),
    and P(similarity >= t) is the chance of at most m successes in n + 1 trials of chance t.
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * near**m * (1 - near) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out[n] = m
    return out


def survives(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature tables (n x HASHES) stay after all batches."""
    alive = np.arange(len(a))
    same = np.zeros(len(a), np.int32)
    for n, least in least_matches().items():
        same[alive] += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1, dtype=np.int32)
        alive = alive[same[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def sizes_fit(n, m):
    """Sets whose sizes alone allow a link."""
    return np.minimum(n, m) * 100 >= np.maximum(n, m) * NEAR_PERCENT


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            b = batch.slice(at, 1024)
            size, h1, h2, sig = [], [], [], []
            for text in b.column(1).to_pylist():
                s = shingle_set(text)
                size.append(len(s))
                h1.append(np.add.reduce(mixed(s)).view(np.int64) if len(s) else 0)
                h2.append(np.add.reduce(mixed(s ^ np.uint64(0x9E3779B97F4A7C15))).view(np.int64) if len(s) else 0)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([b.column(0), b.column(2), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "row", "n", "h1", "h2", "sig"])
    forget()


def signatures(docs: DataFrame) -> DataFrame:
    return in_batches(docs.select("doc_id", "text", "row")).mapInArrow(_sign, "doc_id long, row long, n long, h1 long, h2 long, sig binary")


def _table(column, width: int = HASHES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, width)


#: Names a split of a hub's members: splits of a hub that leads buckets of several sizes are counted by size.
HUB_SPLIT = ["a", "splits", "split"]


def _posterior(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            stays = survives(_table(b.column("sig_a")), _table(b.column("sig_b")))
            yield b.select([*HUB_SPLIT, "b"]).filter(pa.array(stays))


def _to_splits(pairs: DataFrame, of_hub: DataFrame) -> DataFrame:
    """Columns of the hubs (key a), once for each split of their members: no split is a hot key."""
    return pairs.select(*HUB_SPLIT).distinct().join(of_hub, "a")


def plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (``HUB_SPLIT``, b) whose signatures survive the sequential comparison."""
    one = _to_splits(pairs, reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")))
    two = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"))
    rows = pairs.join(one, HUB_SPLIT).join(two, "b").select(*HUB_SPLIT, "b", "sig_a", "sig_b")
    return in_batches(rows).mapInArrow(_posterior, "a long, splits long, split long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """The one definition of a link between full sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= NEAR_PERCENT * (len(x) + len(y) - both)


def _against_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by hub, split and member, the hub's own text (member null) first: members that are near their hub."""
    hub = np.empty(0, np.uint64)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            b = batch.slice(at, 256)
            keep = []
            for member, text in zip(b.column("b").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = shingle_set(text)
                if member is None:
                    hub = own
                keep.append(member is not None and similar(hub, own))
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    forget()


def texts_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """rep, text of the wanted rows, in a table."""
    ids = materialize(ids, "near-ids")
    small = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col("row").alias("rep"), "text").join(F.broadcast(ids) if small else ids, "rep", "left_semi")
    texts = materialize(texts, "near-texts")
    discard(ids)
    return texts


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) of the pairs whose full sets are near enough, in a table; a hub's text goes once to each split of its members."""
    pairs = materialize(pairs, "near-pairs")
    texts = texts_of(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), docs)
    own = pairs.join(texts.withColumnRenamed("rep", "b"), "b").select(*HUB_SPLIT, "b", "text")
    hubs = _to_splits(pairs, texts.withColumnRenamed("rep", "a")).select(*HUB_SPLIT, F.lit(None).cast("long").alias("b"), "text")
    rows = own.unionByName(hubs).repartition(*HUB_SPLIT).sortWithinPartitions(*HUB_SPLIT, F.asc_nulls_first("b"))
    out = materialize(in_batches(rows).mapInArrow(_against_hub, "a long, b long"), "near-links")
    discard(pairs)
    discard(texts)
    return out


def bands(reps: DataFrame) -> DataFrame:
    """key, band, rep, n: a row for each class and band."""
    keys = [F.struct(F.xxhash64(F.lit(i), F.substring("sig", 4 * ROWS * i + 1, 4 * ROWS)).alias("key"), F.lit(i).alias("band")) for i in range(BANDS)]
    return reps.select(F.explode(F.array(*keys)).alias("x"), "rep", "n").select("x.key", "x.band", "rep", "n")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by unit: the table of each unit."""
    unit, held = None, []
    for b in batches:
        at, units = 0, b.column("unit").to_numpy()
        cuts = (np.flatnonzero(units[1:] != units[:-1]) + 1).tolist() + [len(units)] if len(units) else []
        for cut in cuts:
            if held and units[at] != unit:
                yield pa.Table.from_batches(held)
                held = []
            unit = units[at]
            held.append(b.slice(at, cut - at))
            at = cut
    if held:
        yield pa.Table.from_batches(held)


def _candidates(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """Row numbers (i, others) of pairs in a unit whose first common band this is and whose signatures survive."""
    sig, comp, n, side = _table(t.column("sig")), *(t.column(c).to_numpy() for c in ("component", "n", "side"))
    first = ROWS * t.column("band")[0].as_py()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(right)
    right = left if alone else right
    for k, i in enumerate(left.tolist()):
        other = right[k + 1 :] if alone else right
        other = other[(comp[other] != comp[i]) & sizes_fit(n[other], n[i])]
        if len(other):
            other = other[survives(np.broadcast_to(sig[i], (len(other), HASHES)), sig[other])]
        if len(other) and first:
            other = other[~(sig[other, :first] == sig[i, :first]).reshape(len(other), -1, ROWS).all(axis=2).any(axis=1)]
        if len(other):
            yield i, other


def _in_question(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that are in some surviving pair."""
    for t in _units(batches):
        rows: set[int] = set()
        for i, other in _candidates(t):
            rows.add(i)
            rows.update(other.tolist())
        if rows:
            yield from t.drop_columns(["sig"]).take(pa.array(sorted(rows))).combine_chunks().to_batches()


def _confirm_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join different components of a unit, confirmed on full sets."""
    for t in _units(batches):
        rep, comp, texts = t.column("rep").to_pylist(), t.column("component").to_pylist(), t.column("text")
        sets: dict[int, np.ndarray] = {}
        top: dict[int, int] = {}

        def root(x: int, top=top) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        def of(i: int, sets=sets, texts=texts) -> np.ndarray:
            if i not in sets:
                sets[i] = shingle_set(texts[i].as_py())
            return sets[i]

        a, b = [], []
        for i, other in _candidates(t):
            for j in other.tolist():
                if root(comp[i]) != root(comp[j]):
                    if similar(of(i), of(j)):
                        top[root(comp[i])] = root(comp[j])
                        a.append(rep[i])
                        b.append(rep[j])
        if a:
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _dealt(known: DataFrame) -> DataFrame:
    """Rows of ``known(key, band, rep, n, component)`` in units: a row for each unit that a member is compared in.

    A bucket's largest component is compared with the rest, and the rest with itself, block
    by block. Members of the largest component never meet each other, so a large
    group with few strangers costs its size times the strangers' blocks, not its square.
    """
    parts = known.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
    buckets = parts.groupBy("key").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("members")).where(F.col("members") > F.col("top.size"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    buckets = materialize(buckets.select("key", F.col("top.component").alias("most"), blocks(F.col("top.size")).alias("most_blocks"), blocks(F.col("members") - F.col("top.size")).alias("rest_blocks")), "open-buckets")
    rows = known.join(buckets, "key").withColumn("top", F.col("component") == F.col("most"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.when(F.col("top"), F.col("most_blocks")).otherwise(F.col("rest_blocks"))).cast("int"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    unit = lambda kind, low, high, side: F.struct(F.xxhash64("key", F.lit(kind), low, high).alias("unit"), F.lit(side).alias("side") if isinstance(side, int) else side.alias("side"))
    of_top = F.transform(upto(F.col("rest_blocks")), lambda p: unit(0, p, F.col("block"), 1))
    of_rest = F.concat(
        F.transform(upto(F.col("most_blocks")), lambda q: unit(0, F.col("block"), q, 0)),
        F.transform(upto(F.col("rest_blocks")), lambda p: unit(1, F.least(p, F.col("block")), F.greatest(p, F.col("block")), F.when(F.col("block") > p, 1).otherwise(0))),
    )
    return rows.select("band", "rep", "n", "component", F.explode(F.when(F.col("top"), of_top).otherwise(of_rest)).alias("u")).select("u.unit", "u.side", "band", "rep", "n", "component")


def leftovers(rows: DataFrame, comps: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Confirmed links between different components within buckets, hubs aside; ``rows(key, band, rep, n)``.

    The first pass over the units only finds which members are in question; only
    their texts are fetched, and no pair leaves a unit before it is confirmed.
    """
    known = rows.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    # In a table: its size is known when the join is planned, so a small list of keys is
    # broadcast without dealing the rows by key, and a large one is joined with skewed keys split.
    known = materialize(known.select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("component")), "bucket-members")
    signs = reps.select("rep", "sig")
    types = "unit long, side int, band int, rep long, n long, component long"
    asked = _dealt(known).join(signs, "rep").select("unit", "side", "band", "rep", "n", "component", "sig").repartition("unit").sortWithinPartitions("unit", "side", "rep")
    asked = materialize(in_batches(asked).mapInArrow(_in_question, types), "in-question")
    texts = texts_of(asked.select("rep").distinct(), docs)
    full = asked.join(signs, "rep").join(texts, "rep").select("unit", "side", "band", "n", "component", "rep", "sig", "text")
    links = materialize(in_batches(full.repartition("unit").sortWithinPartitions("unit", "side", "rep")).mapInArrow(_confirm_units, "a long, b long").distinct(), "more-links")
    for x in (asked, texts, known):
        discard(x)
    return links


def _one_id(signs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows that repeat a doc_id with different sets."""
    of_set = F.struct("h1", "h2", "n")
    with_id = signs.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "h1", "h2", "n")
    several = with_id.groupBy("doc_id").agg(F.min(of_set).alias("x"), F.max(of_set).alias("y")).where("x != y").select("doc_id")
    reps = with_id.join(several, "doc_id").join(classes.select("h1", "h2", "n", "rep"), ["h1", "h2", "n"])
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return reps.join(least, "doc_id").select(F.col("rep").alias("a"), "b").where("a != b").distinct()


def grouped(docs: DataFrame, by_id: bool) -> DataFrame:
    """row, doc_id, n, first (row and doc_id of the group's row with the least id, nulls last; null without words) of each row of ``docs(row, doc_id, text)``.

    ``by_id``: rows that repeat a doc_id are one document, otherwise each is its own.
    """
    signs = materialize(signatures(docs), "signatures")
    # Equal sets have equal signatures; the first row is the one with the least id.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    classes = materialize(signs.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("row").alias("rep"), F.min("sig").alias("sig"), first.alias("first")), "classes")
    reps = classes.select("rep", "n", "sig")
    rows = bands(reps)
    hubs = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = materialize(rows.join(hubs, "key").select("key", "band", "rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n"), "members").where("rep != hub"), "buckets")
    fits = F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * NEAR_PERCENT
    # A bucket's size tells how many splits its hub's members need; a pair that several buckets hold is taken from the smallest.
    pairs = shared.where(fits).groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.ceil(F.min("members") / SPLIT).alias("splits"))
    pairs = pairs.select("a", "splits", F.pmod(F.xxhash64("b"), F.col("splits")).alias("split"), "b")
    links = confirmed(plausible(pairs, reps), docs)
    if by_id:
        links = links.unionByName(_one_id(signs, classes))
    comps = materialize(components(links), "components")
    more = leftovers(shared.where("members > 2").select("key", "band", "rep", "n"), comps, reps, docs)
    if more.limit(1).count():
        comps = materialize(components(links.unionByName(more)), "components")
    of = classes.join(comps, F.col("rep") == F.col("node"), "left").select("h1", "h2", "n", "first", F.coalesce("component", "rep").alias("component"))
    firsts = of.groupBy("component").agg(F.min("first").alias("first"))
    of = materialize(of.select("h1", "h2", "n", "component").join(firsts, "component").select("h1", "h2", "n", "first"), "class-groups")
    return signs.select("row", "doc_id", "n", "h1", "h2").join(of, ["h1", "h2", "n"], "left").select("row", "doc_id", "n", "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row."""
    keyed, key = numbered(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "near-rows")
    out = grouped(keyed.withColumnRenamed(key, "row"), by_id=True)
    component = F.coalesce("first.doc_id", "doc_id")
    # Rows that repeat the least id are all kept.
    kept = F.col("first").isNull() | (F.col("row") == F.col("first.row")) | F.coalesce(F.col("doc_id") == F.col("first.doc_id"), F.lit(False))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(kept, F.lit(True)).alias("kept"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns; rows without words all stay, and rows that repeat a doc_id are documents of their own."""
    keyed, key = numbered(docs, "near-rows")
    out = grouped(keyed.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(key).alias("row")), by_id=False)
    kept = materialize(out.where("first IS NULL OR row = first.row").select(F.col("row").alias(key)), "kept-rows")
    return keyed.join(kept, key, "left_semi").select(*docs.columns)
