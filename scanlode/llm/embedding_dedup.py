"""Near-duplicate embeddings by sorted projection passes over centred vectors, and exactly where vectors crowd.

1. Vectors of one label that are equal component by component form a class; only
   its least vec_id goes on, with the class's size.
2. A label's vectors (a unit) of ``CENTRED`` or more are taken relative to their mean direction, so that
   a direction that all share doesn't spoil the signs.
3. Signs of ``BITS`` random projections are a vector's sketch. Each of ``PASSES`` passes
   puts the sketches' bits in another random order and sorts a unit's vectors
   lexicographically by them. Each is compared with the ``WINDOW`` before it, over
   the borders of partitions too (a partition of fewer rows than ``WINDOW`` hides pairs between
   its two neighbours in that pass). Only keys and ids are sorted.
4. Pairs whose sketches differ in few enough bits are fetched once and confirmed by their
   cosine in double precision. A cosine of 0.98 is a distance of 0.2 at most; ``near_bits`` of a vector at
   distance r from the mean is what that distance can turn, and five deviations. Without a
   centre a bit differs with chance 0.064, the limit is 26 and loses a pair with chance 1e-7; all
   passes together miss one among 300,000 evenly spread vectors with chance 1e-4 or so.
   At r = 0.55 (a mean cosine of 0.7) a bit differs with chance 0.117: of 1,942 links of 100,000 such
   vectors of one label 1,940 were found, 4 % of the vectors lay within ``TIGHT``.
5. A bounded window can't hold the neighbours of a vector in a crowd. Where ``CROWD`` of a
   window lie within ``LOOSE_BITS`` bits (an angle of about 53 degrees as seen from the mean), the loosely near
   are put into one region, over all passes; so are the vectors of a unit that are nearer than
   ``TIGHT`` to its mean, where sign bits are no guide. A region of more than
   ``BLOCK`` vectors and at most ``SHARE`` of its unit is a unit of its own: centred at its own mean, it goes
   through all passes again, and so on; units shrink by that share each turn.
   The other regions are compared exactly: in pairs of blocks of ``BLOCK``, single-precision tiles, double at the
   border. Only counts and a spanning forest of the links leave a pair of blocks.
6. Confirmed pairs and forests are united over all passes and turns.

Passes are linear in a label's vectors (times the sort), exact regions quadratic in their own
size and not in the label's. What is large and still exact are near copies by the thousand, whose
links no window holds, and sets whose vectors lie within ``TIGHT`` of their common mean (a mean cosine of 0.76 and more).

Defined cases: a null label or a vector that is null, empty, zero or holds null or
non-finite components links with nothing; vectors of different length never link;
rows that repeat a vec_id are one vertex: whatever one of them reaches, all reach, and
their n_links is the sum over their different vectors of the other vec_ids that each links with;
they are no links of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanlode.llm.common import discard, in_batches, materialize
from scanlode.llm.components import components

LEAST = 0.98
BITS, PASSES, WINDOW = 128, 24, 64
NEAR_BITS, LOOSE_BITS, CROWD = 26, 38, 16
#: Vectors that a unit needs to be centred, and the distance to the mean under which sign bits are no guide.
CENTRED, TIGHT = 1000, 0.49
#: A region of at most this share of its unit passes again; a larger one would look as crowded from its own mean.
SHARE = 0.75
#: Rows of a pass that a task sorts, and those that are compared at a time.
PER_TASK, AT_ONCE = 100_000, 4096
#: Vectors of a block of a region, the side of the tiles that a pair of blocks multiplies, and the pairs computed again at a time.
BLOCK, TILE, AGAIN = 4096, 1024, 4096
#: Regions that fit one block are cut into so many too, of so many vectors at least, so that a single crowd is worked on by several tasks.
SPREAD, LEAST_BLOCK = 4, 256
KEYS = "unit long, pass int, k1 long, k2 long, rep long, near int"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (as stored) of the rows that may link."""
    kind = vectors.schema["embedding"].dataType.simpleString()
    v = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v")).where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))


def _lists(column) -> list[np.ndarray]:
    """Double-precision rows of a list column."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(pc.list_value_length(lists).to_numpy())
    return np.split(flat, ends[:-1]) if len(ends) else []


def _unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column) -> np.ndarray:
    """Unit rows; all lists of one length."""
    return _unit_rows(np.stack(_lists(column)))


def linked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The one definition of a link between unit rows."""
    return np.einsum("ij,ij->i", x, y) >= LEAST


# Classes of equal vectors.


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = [hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() for x in _lists(b.column("v"))]
        yield pa.record_batch([*b.columns, pa.array(own, pa.binary())], names=[*b.schema.names, "digest"])


# Sorted passes.


@cache
def _projections(size: int) -> np.ndarray:
    return np.random.default_rng(size).normal(size=(size, BITS))


_ORDERS = [np.random.default_rng(98 + p).permutation(BITS) for p in range(PASSES)]


def near_bits(r: np.ndarray) -> np.ndarray:
    """Most bits in which the sketch of a vector at distance r from the centre may differ from that of a vector linked with it."""
    p = 2 / np.pi * np.arcsin(np.minimum(1.0, np.sqrt((1 - LEAST) / 2) / np.maximum(r, 1e-9)))
    return np.clip(np.ceil(BITS * p + 5 * np.sqrt(BITS * p * (1 - p))), NEAR_BITS, LOOSE_BITS).astype(np.int32)


def _relative(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors: row numbers, and their unit rows relative to their centres (none: as they are)."""
    rows, centres = _lists(batch.column("v")), batch.column("centre").to_pylist()
    sizes = np.array([len(x) for x in rows])
    for size in np.unique(sizes).tolist():
        pick = np.flatnonzero(sizes == size)
        x = _unit_rows(np.stack([rows[i] for i in pick]))
        for k, i in enumerate(pick.tolist()):
            if centres[i] is not None:
                x[k] -= centres[i]
        yield pick, x


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each vector and pass: the bits of its sketch in the pass's order."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            b = batch.slice(at, 1024)
            unit, rep = b.column("unit").to_numpy(), b.column("rep").to_numpy()
            for pick, x in _relative(b):
                bits, near = x @ _projections(x.shape[1]) > 0, pa.array(near_bits(np.sqrt((x * x).sum(axis=1))))
                for p, order in enumerate(_ORDERS):
                    k = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">i8").astype(np.int64)
                    yield pa.record_batch([pa.array(unit[pick]), pa.array(np.full(len(pick), p, np.int32)), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(rep[pick]), near], names=[c.split()[0] for c in KEYS.split(", ")])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, n, s: the number and the sum of the unit vectors of each unit in a batch."""
    for b in batches:
        rows, units = _lists(b.column("v")), b.column("unit").to_numpy()
        out = []
        for unit in np.unique(units).tolist():
            x = _unit_rows(np.stack([rows[i] for i in np.flatnonzero(units == unit)]))
            out.append((unit, len(x), x.sum(axis=0)))
        yield pa.record_batch([pa.array([u for u, _, _ in out], pa.int64()), pa.array([n for _, n, _ in out], pa.int64()), pa.array([x for _, _, x in out], pa.list_(pa.float64()))], names=["unit", "n", "s"])


def _centred(units: DataFrame) -> DataFrame:
    """``units(unit, rep, v)`` with the mean of the unit's unit vectors, null in small units; sums are taken batch by batch, then by unit and place."""
    sums = in_batches(units.select("unit", "v")).mapInArrow(_sums, "unit long, n long, s array<double>")
    means = sums.select("unit", "n", F.posexplode("s")).groupBy("unit", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).where(F.col("n") >= CENTRED)
    centres = means.groupBy("unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda x: x["m"]).alias("centre"))
    return units.join(materialize(centres, "vector-centres"), "unit", "left").select("unit", "rep", "v", "centre")


def _tight(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """unit, rep of the vectors nearer than ``TIGHT`` to their centre."""
    for b in batches:
        for pick, x in _relative(b) if b.num_rows else ():
            rows = pa.array(pick[(x * x).sum(axis=1) < TIGHT * TIGHT])
            yield pa.record_batch([b.column("unit").take(rows), b.column("rep").take(rows)], names=["unit", "rep"])


def _windows(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive rows in order: pairs (a, b) near enough to be fetched, and a spanning forest (node, root) of each crowd."""
    n, pairs, loose = len(t["rep"]), [], []
    k1, k2 = t["k1"].view(np.uint64), t["k2"].view(np.uint64)
    crowd = np.zeros(n, np.int32)
    for d in range(1, min(WINDOW, n - 1) + 1):
        apart = np.bitwise_count(k1[d:] ^ k1[:-d]).astype(np.int32) + np.bitwise_count(k2[d:] ^ k2[:-d])
        i = np.flatnonzero((apart <= LOOSE_BITS) & (t["unit"][d:] == t["unit"][:-d]) & (t["pass"][d:] == t["pass"][:-d]))
        if len(i):
            crowd[i] += 1
            crowd[i + d] += 1
            loose.append((i, i + d, apart[i]))
    if not loose:
        none = np.empty(0, np.int64)
        return none, none, none, none
    i, j, apart = (np.concatenate(x) for x in zip(*loose, strict=True))
    inside = crowd >= CROWD
    both = inside[i] & inside[j]
    pairs = (apart <= np.maximum(t["near"][i], t["near"][j])) & ~both
    root, (p, q) = np.arange(n), (i[inside[i] | inside[j]], j[inside[i] | inside[j]])
    while len(p):  # least reachable row of each crowd
        least = root.copy()
        np.minimum.at(least, p, root[q])
        np.minimum.at(least, q, root[p])
        least = least[least]
        if (least == root).all():
            break
        root = least
    at = np.flatnonzero(root != np.arange(n))
    rep = t["rep"]
    return rep[i[pairs]], rep[j[pairs]], rep[at], rep[root[at]]


_FOUND = "kind int, a long, b long, border int, " + KEYS


def _found(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n, none = len(a), [pa.nulls(len(a), t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())]
    return pa.record_batch([pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(b), *none], names=[c.split()[0] for c in _FOUND.split(", ")])


def _compared(batches: Iterator[pa.RecordBatch], borders: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows of ``KEYS`` in windows: pairs to fetch (kind 0), loosely near ones in crowds (1), and the first and last rows (2) for the borders to the partitions before and after."""
    names = [c.split()[0] for c in KEYS.split(", ")]
    part = TaskContext.get().partitionId() if borders else 0
    held: dict[str, np.ndarray] | None = None

    def edge(t: dict[str, np.ndarray], border: int) -> pa.RecordBatch:
        n = len(t["rep"])
        return pa.record_batch([pa.array(np.full(n, 2, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(np.full(n, border, np.int32)), *(pa.array(t[c]) for c in names)], names=[c.split()[0] for c in _FOUND.split(", ")])

    head = 0
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            b = batch.slice(at, AT_ONCE)
            t = {c: b.column(c).to_numpy() for c in names}
            if borders and head < WINDOW:
                first = {c: x[: WINDOW - head] for c, x in t.items()}
                head += len(first["rep"])
                yield edge(first, part - 1)
            if held is not None:
                t = {c: np.concatenate([held[c], x]) for c, x in t.items()}
            a, b_, node, root = _windows(t)
            if len(a):
                yield _found(0, a, b_)
            if len(node):
                yield _found(1, node, root)
            held = {c: x[-WINDOW:] for c, x in t.items()}
    if borders and held is not None:
        yield edge(held, part)


def _passes(units: DataFrame) -> DataFrame:
    """a, b, loose: pairs to fetch and, ``loose``, forests of the crowds, over all passes; ``units(unit, rep, v)`` is a table."""
    tasks = max(1, -(-units.count() * PASSES // PER_TASK))
    centred = _centred(units)
    keys = in_batches(centred).mapInArrow(_keys, KEYS)
    order = ("unit", "pass", "k1", "k2", "rep", "near")
    keys = keys.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    found = materialize(in_batches(keys).mapInArrow(lambda x: _compared(x, True), _FOUND), "vector-windows")
    # Two windows of rows for each border.
    edges = found.where("kind = 2").select("border", *order).repartition("border").sortWithinPartitions("border", *order)
    over = in_batches(edges.select(*order)).mapInArrow(lambda x: _compared(x, False), _FOUND)
    every = found.where("kind < 2").unionByName(over)
    tight = materialize(in_batches(centred.where("centre IS NOT NULL")).mapInArrow(_tight, "unit long, rep long"), "vector-tight")
    about = tight.join(tight.groupBy("unit").agg(F.min("rep").alias("b")), "unit").select(F.col("rep").alias("a"), "b", F.lit(True).alias("loose"))
    every = every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("kind") == 1).alias("loose")).unionByName(about)
    out = materialize(every.where("a != b").distinct(), "vector-pairs")
    discard(found)
    discard(tight)
    return out


def _candidates(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs to fetch; node, component: the members of the regions that are compared exactly. ``reps(unit, rep, v)``."""
    pairs, exact, units = [], [], reps.select("unit", "rep", "v")
    while True:
        found = _passes(units)
        pairs.append(found.where("NOT loose").select("a", "b"))
        of = materialize(components(found.where("loose").select("a", "b")), "vector-regions")
        sizes = units.groupBy("unit").agg(F.count(F.lit(1)).alias("whole"))
        parts = of.join(units.select(F.col("rep").alias("node"), "unit"), "node").groupBy("component").agg(F.min("unit").alias("unit"), F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
        large = materialize(parts.join(sizes, "unit").where(F.col("n") <= SHARE * F.col("whole")).select("component"), "large-regions")
        if not large.limit(1).count():
            exact.append(of)
            break
        exact.append(of.join(large, "component", "left_anti").select("node", "component"))
        again = of.join(large, "component", "left_semi").select(F.col("node").alias("rep"), F.col("component").alias("unit"))
        units = materialize(units.select("rep", "v").join(again, "rep").select("unit", "rep", "v"), "vector-units")
    every = pairs[0]
    for more in pairs[1:]:
        every = every.unionByName(more).distinct()
    regions = exact[0]
    for more in exact[1:]:
        regions = regions.unionByName(more)
    return every, materialize(regions, "exact-regions")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            x, y = _lists(b.column("x")), _lists(b.column("y"))
            stays = np.zeros(b.num_rows, bool)
            sizes = np.array([len(r) for r in x])
            for size in np.unique(sizes).tolist():
                pick = np.flatnonzero(sizes == size)
                stays[pick] = linked(_unit_rows(np.stack([x[i] for i in pick])), _unit_rows(np.stack([y[i] for i in pick])))
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(stays))


# Regions, exactly.


def _near(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray) -> np.ndarray:
    """Which pairs of unit rows have a cosine of LEAST or more, exact as double precision is."""
    bound = (x.shape[1] + 8) * 1.2e-7
    cosine = x32 @ y32.T
    near = cosine >= LEAST - bound
    if near.any():
        i, j = np.nonzero(near & (cosine <= LEAST + bound))
        for at in range(0, len(i), AGAIN):
            p, q = i[at : at + AGAIN], j[at : at + AGAIN]
            near[p, q] = linked(x[p], y[q])
    return near


def _unit(t: pa.Table) -> pa.RecordBatch:
    """Links (a, b) that span the unit's components, and (a, others) for each class with links to the facing side, or within the only one."""
    x, side, rep, copies = _matrix(t.column("v")), *(t.column(c).to_numpy() for c in ("side", "rep", "copies"))
    x32, weight = x.astype(np.float32), copies.astype(np.float64)
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = not len(two)
    two = one if alone else two
    total, top, a, b = np.zeros(len(rep)), np.arange(len(rep)), [], []
    for at in range(0, len(one), TILE):
        p = one[at : at + TILE]
        for by in range(at if alone else 0, len(two), TILE):
            q = two[by : by + TILE]
            near = _near(x[p], x[q], x32[p], x32[q])
            if not near.any():
                continue
            near &= rep[p][:, None] != rep[q]
            total[p] += near @ weight[q]
            if not alone or at != by:
                total[q] += weight[p] @ near
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                i, other = p[k], q[near[k]]
                other = other[top[other] != top[i]]
                if len(other):
                    for c, first in zip(*np.unique(top[other], return_index=True), strict=True):
                        top[top == c] = top[i]
                        a.append(rep[i])
                        b.append(rep[other[first]])
    linked = np.flatnonzero(total)
    no = [None]
    return pa.record_batch(
        [
            pa.array(np.concatenate([np.array(a, np.int64), rep[linked]])),
            pa.array(np.array(b, np.int64).tolist() + no * len(linked), pa.int64()),
            pa.array(no * len(a) + total[linked].astype(np.int64).tolist(), pa.int64()),
        ],
        names=["a", "b", "others"],
    )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by region and blocks: what each pair of blocks finds."""
    names, held, now = ("region", "low", "high"), [], None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c) for c in names]
        new = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            new |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[lo].as_py() for k in keys)
            if held and key != now:
                yield _unit(pa.Table.from_batches(held))
                held = []
            now = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield _unit(pa.Table.from_batches(held))


def _regions(reps: DataFrame, of: DataFrame) -> DataFrame:
    """Links (a, b) that span each region's components, and (a, others) counts; ``of(node, component)`` are the regions."""
    rows = reps.join(of.select(F.col("node").alias("rep"), F.col("component").alias("region")), "rep").select("region", "rep", "copies", "v")
    blocks = of.groupBy(F.col("component").alias("region")).agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("region", F.greatest(F.ceil(F.col("n") / BLOCK), F.least(F.lit(SPREAD), F.ceil(F.col("n") / LEAST_BLOCK))).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "region").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.select("region", "rep", "copies", "v", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
    dealt = dealt.select("region", low.alias("low"), high.alias("high"), side.alias("side"), "rep", "copies", "v")
    dealt = dealt.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high", "side", "rep")
    return materialize(in_batches(dealt).mapInArrow(_compare, "a long, b long, others long"), "vector-links")


def near_embeddings(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row."""
    rows = usable(vectors)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", digest binary"
    rows = materialize(in_batches(rows).mapInArrow(_digests, schema), "vectors")
    classes = materialize(rows.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("copies")), "vector-classes")
    least = classes.select(F.col("label").alias("_l"), F.col("digest").alias("_d"), "rep", "copies")
    reps = rows.join(least, (F.col("vec_id") == F.col("rep")) & (F.col("label") == F.col("_l")) & (F.col("digest") == F.col("_d")))
    reps = reps.select("label", "digest", "rep", "copies", "v").dropDuplicates(["label", "digest"])
    reps = materialize(reps.select(F.xxhash64("label", F.size("v")).alias("unit"), "rep", "copies", "v"), "vector-reps")
    pairs, of = _candidates(reps)
    crowds = _regions(reps, of)
    one, two = (of.select(F.col("node").alias(x), F.col("component").alias(f"in_{x}")) for x in "ab")
    # Within a region everything is compared already.
    single = pairs.join(one, "a", "left").join(two, "b", "left").where("in_a IS NULL OR in_b IS NULL OR in_a != in_b").select("a", "b")
    x, y = (reps.select(F.col("rep").alias(k), F.col("v").alias(v), F.col("copies").alias(f"n_{k}")) for k, v in (("a", "x"), ("b", "y")))
    links = in_batches(single.join(x.drop("n_a"), "a").join(y.drop("n_b"), "b").select("a", "b", "x", "y")).mapInArrow(_verified, "a long, b long")
    links = materialize(links, "vector-singles")
    # Classes that share a vec_id are reached from each other.
    of_id = rows.select("vec_id", "label", "digest").join(classes, ["label", "digest"]).select("vec_id", "rep").distinct()
    several = of_id.groupBy(F.col("vec_id").alias("_id")).agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").drop("most")
    shared = of_id.join(several, F.col("vec_id") == F.col("_id")).select("a", F.col("rep").alias("b")).where("a != b").distinct()
    comps = materialize(components(links.unionByName(crowds.where("b IS NOT NULL").select("a", "b")).unionByName(shared)), "vector-components")
    others = links.join(y.select("b", F.col("n_b").alias("others")), "b").select(F.col("a").alias("rep"), "others").unionByName(links.join(x.select("a", F.col("n_a").alias("others")), "a").select(F.col("b").alias("rep"), "others"))
    counted = others.unionByName(crowds.where("others IS NOT NULL").select(F.col("a").alias("rep"), "others")).groupBy("rep").agg(F.sum("others").alias("others"))
    of_class = classes.join(comps, F.col("rep") == F.col("node"), "left").join(counted, "rep", "left")
    of_class = of_class.select("label", "digest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("component"))
    by_id = rows.select("vec_id", "label", "digest").distinct().join(of_class, ["label", "digest"]).groupBy(F.col("vec_id").alias("_id")).agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(by_id, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
