"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Every pair (in large tables every triple) of signed random directions spans a one-dimensional projection (their sum). A vector stands in the sorted lists of
those projections only where it is extreme: for the combinations among its strongest directions. The number of directions grows with the table's, by the
square root (cube root) of its vectors, so that the mean list holds no more of them at any size. (Strong directions lie near each other, the more so in few dimensions, so
meetings still grow somewhat: from 50,000 to 200,000 random vectors 570 to 846 a vector in 64 dimensions, 238 to 262 in 384.) In each list a query-centred window takes the vectors whose projection is within a distance that near vectors keep; every such
meeting of two vectors is a collision. Pairs with enough collisions are verified. The count that
suffices is calibrated on random pairs of exactly the least similarity, through the same directions, so that
RECALL of them pass; nearer pairs collide more often. Random directions treat all orientations alike, so the calibration
holds for any data of that dimension.

Lists that begin with one direction are one task's, and a vector is filed there once, with its strongest directions, projections and components in 255 steps. So the first
list where two vectors meet is enough to count all their collisions, and to bound their cosine: where the bounds leave no doubt, a task tells how many links each vector has and
a forest that connects them, which is in proportion to the vectors and not to the pairs. Pairs in doubt, a hundredth or so around the least cosine, are verified in double precision.

Vectors of one direction are one representative with a multiplicity. More than MOST_IN_LIST vectors of one first direction are compared in blocks dealt to
different tasks.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .components import components, roots_of

#: Share of threshold pairs that calibration keeps.
RECALL = 0.97
#: Fewest and most directions of pairs and of triples, strongest directions that file a vector, and the vectors up to which the fewest do.
SHAPES = {2: (512, 8192, 10, 1 << 16), 3: (2048, 16384, 13, 1 << 25)}
#: Half width of a window in standard deviations of the projected difference of a threshold pair.
SPREAD = 2.5
#: Vectors of one first direction that a task compares; more are dealt in blocks.
MOST_IN_LIST = 4096
SEED = 20


class Shape(NamedTuple):
    """How vectors are filed: directions in a combination, directions in all, strongest ones of a vector."""

    order: int
    directions: int
    top: int


def shape_for(vectors: int) -> Shape:
    """The shape whose lists stay short: there are as many lists as directions to the power of the order, so with twice the directions 2**order times the vectors fit."""
    for order, (fewest, most, top, up_to) in SHAPES.items():
        n = fewest
        while vectors > up_to and n < most:
            n, up_to = 2 * n, up_to << order
        if vectors <= up_to:
            break
    return Shape(order, n, top)


@lru_cache(maxsize=2)
def directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).normal(size=(dim, count))


def lists_of(x: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(list numbers, projections) of unit vectors: a row per vector, a column per combination of its strongest directions."""
    signed, value = _strongest(x, shape)
    chosen = np.array(list(combinations(range(shape.top), shape.order)))
    number, at = np.zeros((len(x), len(chosen)), np.int64), np.zeros((len(x), len(chosen)))
    for column in chosen.T:
        number = number * (2 * shape.directions) + signed[:, column]
        at += value[:, column]
    return number, at / np.sqrt(shape.order)


def window(least: float) -> float:
    """Half width: SPREAD times the deviation of a standard normal projection of a threshold pair's difference."""
    return SPREAD * float(np.sqrt(2 - 2 * least))


@lru_cache(maxsize=8)
def enough(dim: int, least: float, shape: Shape = Shape(2, 512, 10), trials: int = 3000) -> int:
    """The highest collision count that RECALL of random pairs with cosine `least` reach (1 at least)."""
    rng = np.random.default_rng([SEED, dim, 1])
    x = rng.normal(size=(trials, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(trials, dim))
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-300)
    y = least * x + np.sqrt(1 - least**2) * y if dim > 1 else x
    half, counts = window(least), []
    for begin in range(0, trials, 250):
        (kx, px), (ky, py) = lists_of(x[begin: begin + 250], shape), lists_of(y[begin: begin + 250], shape)
        for a, p, b, q in zip(kx, px, ky, py, strict=True):
            _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
            counts.append(np.count_nonzero(np.abs(p[i] - q[j]) <= half))
    return max(1, int(np.sort(counts)[int(trials * (1 - RECALL))]))


#: Products of vectors and directions that a task holds at once, and meetings that it looks at together.
PRODUCTS, MEETINGS = 1 << 22, 1 << 17


def _record(dim: int, shape: Shape) -> np.dtype:
    """What a vector takes along: its strongest directions (signed, ascending) and projections, its components in 255 steps with their size, and how far these are from it."""
    return np.dtype([("signed", "<i4" if shape.directions > 1 << 14 else "<u2", shape.top), ("value", "<f4", shape.top), ("steps", "i1", dim), ("size", "<f8"), ("off", "<f8"), ("copies", "<i8")])


def _units(batches, shape: Shape):
    """(dim, places in the batch, batch, unit vectors) in parts of one dimension."""
    for batch in batches:
        vectors = batch.column("embedding")
        dims = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            every, most = np.flatnonzero(dims == dim), max(1, PRODUCTS // shape.directions)
            for begin in range(0, len(every), most):
                mine = every[begin: begin + most]
                x = np.array(vectors.take(pa.array(mine)).flatten(), np.float64).reshape(len(mine), dim)
                x /= np.abs(x).max(axis=1, keepdims=True)
                yield int(dim), mine, batch, x / np.linalg.norm(x, axis=1, keepdims=True)


def _strongest(x: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(signed directions ascending, projections): the strongest ones of unit vectors."""
    p = x @ directions(x.shape[1], shape.directions)
    best = np.argpartition(-np.abs(p), shape.top, axis=1)[:, :shape.top]
    value = np.take_along_axis(p, best, axis=1)
    signed = best * 2 + (value > 0)
    order = np.argsort(signed, axis=1)
    return np.take_along_axis(signed, order, axis=1), np.abs(np.take_along_axis(value, order, axis=1))


def _sizes(batches, shape: Shape):
    """(dim, first, n): vectors of a batch by each direction that can be the first of a combination."""
    for dim, _, _, x in _units(batches, shape):
        first, n = np.unique(_strongest(x, shape)[0][:, : shape.top - shape.order + 1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), dim), pa.int32()), pa.array(first, pa.int32()), pa.array(n, pa.int64())], names=["dim", "first", "n"])


def _file(batches, shape: Shape):
    """(dim, first, rep, body): a row of each representative for each direction that can be the first of a combination."""
    firsts = shape.top - shape.order + 1
    for dim, mine, batch, x in _units(batches, shape):
        reps, copies = (batch.column(c).to_numpy()[mine] for c in ("rep", "copies"))
        body = np.zeros(len(x), _record(dim, shape))
        body["signed"], body["value"] = _strongest(x, shape)
        body["size"] = np.abs(x).max(axis=1) / 127
        body["steps"] = np.rint(x / body["size"][:, None])
        body["off"] = np.linalg.norm(x - body["steps"] * body["size"][:, None], axis=1)
        body["copies"] = copies
        rows = np.repeat(body, firsts)
        ends = pa.py_buffer((np.arange(len(rows) + 1) * body.dtype.itemsize).astype(np.int32))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(rows), dim), pa.int32()), pa.array(body["signed"][:, :firsts].ravel(), pa.int32()), pa.array(np.repeat(reps, firsts)), pa.Array.from_buffers(pa.binary(), len(rows), [None, ends, pa.py_buffer(rows.tobytes())]),
        ], names=["dim", "first", "rep", "body"])


def _meetings(run: np.ndarray, first: np.ndarray, cross: np.ndarray, own: np.ndarray, body: np.ndarray, shape: Shape, half: float):
    """(i, j, list): rows that meet in a list, found by the lists whose first direction is the rows' own. `list` tells its other directions' places in row i."""
    at_first = np.argmax(body["signed"] == first[:, None], axis=1)
    rows, lists, places, chosen = [], [], [], list(combinations(range(shape.top), shape.order))
    for k, places_of in enumerate(chosen):
        mine = np.flatnonzero(at_first == places_of[0])
        number, at = np.zeros(len(mine), np.int64), body["value"][mine, places_of[0]].astype(np.float64)
        for column in places_of[1:]:
            number = number * (2 * shape.directions) + body["signed"][mine, column]
            at += body["value"][mine, column]
        rows.append(mine)
        lists.append(number)
        places.append(np.stack([at / np.sqrt(shape.order), np.full(len(mine), float(k))]))
    rows, lists, places = np.concatenate(rows), np.concatenate(lists), np.concatenate(places, axis=1)
    order = np.lexsort((places[0], lists, run[rows]))
    rows, lists, at, k = rows[order], lists[order], places[0][order], places[1][order].astype(np.int64)
    i, lag = np.arange(len(rows)), 1
    while len(i):
        i = i[i + lag < len(rows)]
        j = i + lag
        near = (run[rows[i]] == run[rows[j]]) & (lists[i] == lists[j]) & (at[j] - at[i] <= half)
        i, j = i[near], j[near]
        a, b = rows[i], rows[j]
        hit = ~cross[a] | (own[a] != own[b])  # in a pair of blocks only across
        if hit.any():
            yield a[hit], b[hit], k[i[hit]]
        lag += 1


def _counted(x: np.ndarray, y: np.ndarray, shape: Shape, half: float) -> tuple[np.ndarray, np.ndarray]:
    """(collisions, number of the first combination of x that collides) of pairs of records."""
    same = x["signed"][:, :, None] == y["signed"][:, None, :]
    shared = same.any(axis=2)
    apart = x["value"].astype(np.float64) - np.take_along_axis(y["value"], same.argmax(axis=2), axis=1)
    n, first = np.zeros(len(x), np.int64), np.full(len(x), -1)
    for k, places in enumerate(combinations(range(shape.top), shape.order)):
        met = shared[:, list(places)].all(axis=1) & (np.abs(apart[:, list(places)].sum(axis=1)) <= half * np.sqrt(shape.order) * (1 + 1e-6))
        first[met & (n == 0)] = k
        n += met
    return n, first


#: Rows of a task: the links of node a that are certain (n, b is null), a pair that connects (n is 0), a pair whose cosine decides (n is null).
FOUND = "a long, b long, n long"


def _collide(batches, least: float, shape: Shape, open_all: bool = False):
    """FOUND rows of the vectors that collide often enough; rows come sorted by (dim, first, left, right).

    A pair is looked at in the first of the lists where it meets, so no task needs to know what others found. Its collisions are counted from what both vectors took
    along. Components in steps give the cosine up to the two vectors' distances from them: within these bounds it is certain, other pairs are left open (`open_all`: all are).
    """
    half = window(least)

    def looked_at(dim: int, t: pa.Table):
        kind, column = _record(dim, shape), lambda c: t.column(c).to_numpy()
        body = np.frombuffer(b"".join(t.column("body").to_pylist()), kind)
        rep, own, left, right, first = (column(c) for c in ("rep", "own", "left", "right", "first"))
        change = np.zeros(len(rep), bool)
        for c in (first, left, right):
            change[1:] |= c[1:] != c[:-1]
        run, need = np.cumsum(change), enough(dim, least, shape)
        exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64
        steps, sure = body["steps"].astype(exact), []
        for i, j, k in _meetings(run, first, left != right, own, body, shape, half):
            for begin in range(0, len(i), MEETINGS):
                a, b, at = (v[begin: begin + MEETINGS] for v in (i, j, k))
                cosine = np.einsum("ij,ij->i", steps[a], steps[b]).astype(np.float64) * body["size"][a] * body["size"][b]
                slack = body["off"][a] + body["off"][b] * (1 + body["off"][a]) + 1e-9
                near = cosine + slack >= least
                a, b, at, cosine, slack = a[near], b[near], at[near], cosine[near], slack[near]
                n, begins = _counted(body[a], body[b], shape, half)
                good = (n >= need) & (begins == at)
                a, b, certain = a[good], b[good], (cosine - slack >= least)[good] & (not open_all)
                if len(a) > certain.sum():
                    u, v = rep[a[~certain]], rep[b[~certain]]
                    yield np.minimum(u, v), np.maximum(u, v), None
                if certain.any():
                    sure.append((a[certain], b[certain]))
            if sum(len(a) for a, _ in sure) > MEETINGS:
                yield from told(sure, rep, body["copies"])
                sure = []
        if sure:
            yield from told(sure, rep, body["copies"])

    def told(sure, rep, copies):
        a, b = (np.concatenate(c) for c in zip(*sure, strict=True))
        who, at = np.unique(np.concatenate([rep[a], rep[b]]), return_inverse=True)
        n = np.zeros(len(who), np.int64)
        np.add.at(n, at, np.concatenate([copies[b], copies[a]]))
        yield who, None, n
        nodes, roots = roots_of(rep[a], rep[b])
        apart = nodes != roots  # an edge for each node at most connects what the pairs connect
        yield nodes[apart], roots[apart], np.zeros(apart.sum(), np.int64)

    def rows(t: pa.Table):
        dims = t.column("dim").to_numpy()
        for dim in np.unique(dims):
            for a, b, n in looked_at(int(dim), t.filter(pa.array(dims == dim))):
                void = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), void if b is None else pa.array(b, pa.int64()), void if n is None else pa.array(n, pa.int64())], names=["a", "b", "n"])

    held = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not len(t):
            continue
        change = np.zeros(len(t), bool)
        for c in ("dim", "first", "left", "right"):
            v = t.column(c).to_numpy()
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and held[-1].column(c)[-1].as_py() != v[0]
        cuts = np.flatnonzero(change)
        if len(cuts) and (held or cuts[-1]):
            yield from rows(pa.concat_tables([*held, t.slice(0, cuts[-1])]))
            held, t = [], t.slice(cuts[-1])
        held.append(t)
    if held:
        yield from rows(pa.concat_tables(held))


def _cosines(batches):
    """(a, b, cosine) of candidate rows with both vectors."""
    for batch in batches:
        va, vb = batch.column("va"), batch.column("vb")
        dims = pc.list_value_length(va).to_numpy(zero_copy_only=False)
        for dim in np.unique(dims):
            mine = pa.array(np.flatnonzero(dims == dim))
            x, y = (np.array(v.take(mine).flatten(), np.float64).reshape(len(mine), dim) for v in (va, vb))
            x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
            cosine = np.einsum("ij,ij->i", x, y) / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(mine), batch.column("b").take(mine), pa.array(cosine)], names=["a", "b", "cosine"])


def _met(reps: DataFrame, least: float, open_all: bool = False) -> DataFrame:
    """FOUND rows of representatives (rep, copies, embedding)."""
    shape = shape_for(reps.count())
    spark = reps.sparkSession
    filed = reps.mapInArrow(lambda b: _file(b, shape), "dim int, first int, rep long, body binary")
    sizes = reps.mapInArrow(lambda b: _sizes(b, shape), "dim int, first int, n long").groupBy("dim", "first").agg(F.sum("n").alias("n")).filter("n > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / MOST_IN_LIST).cast("int")).drop("n")
    # a row for each first direction: as many as directions, whatever the table's size
    rows = filed.join(F.broadcast(sizes), ["dim", "first"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "dim", "first", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"), "rep", "own", "body"
    )
    order, tasks = ["dim", "first", "left", "right"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return dealt.repartition(tasks, *order).sortWithinPartitions(*order).mapInArrow(lambda b: _collide(b, least, shape, open_all), FOUND)


def _verified(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """(a, b, cosine) of those pairs (a, b) whose cosine in double precision is `least` or more."""
    both = pairs.join(reps.select(F.col("rep").alias("a"), F.col("embedding").alias("va")), "a").join(reps.select(F.col("rep").alias("b"), F.col("embedding").alias("vb")), "b")
    return both.select("a", "b", "va", "vb").mapInArrow(_cosines, "a long, b long, cosine double").filter(F.col("cosine") >= least)


def near_pairs(reps: DataFrame, least: float = 0.9) -> DataFrame:
    """(a, b, cosine), a < b: pairs of representatives (rep long, embedding) found with cosine >= `least`, a row each."""
    return _verified(_met(reps.withColumn("copies", F.lit(1).cast("long")), least, open_all=True).select("a", "b"), reps, least)


def near_duplicates(vectors: DataFrame, least: float = 0.9, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    A vector that is null, empty, all zero or holds null or non-finite components has no link and is its own component. Vectors of different
    lengths never link. n_links counts the other rows linked directly, copies included; component_id is the least vec_id
    that links reach. Rows with a null id are not linked (component null, kept false). Rows of one
    direction are recognised by two hashes of the vector over its largest component (96 bits).
    """
    x = F.col(column)
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), x.alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | ~F.exists("embedding", lambda v: v != 0)
    good = F.coalesce(~bad & (F.size("embedding") > 0), F.lit(False)) & F.col("vec_id").isNotNull()
    # vectors of one direction are one: scaled by their largest component, copies times a power of two are equal to the bit
    top = F.array_max(F.transform("embedding", F.abs))
    unit = F.transform("embedding", lambda v: v.cast("double") / top)
    small_batches(vectors.sparkSession)
    fine = rows.filter(good).select("vec_id", unit.alias("embedding"))
    fine = fine.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    classes = fine.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    reps = fine.withColumnRenamed("vec_id", "rep").join(classes, ["rep", "h1", "h2"]).dropDuplicates(["rep", "h1", "h2"]).select("rep", "copies", "embedding")
    reps = materialize(reps, "reps")
    found = materialize(_met(reps, least), "near")
    links = materialize(_verified(found.filter("n is null").select("a", "b"), reps, least).select("a", "b"), "links")
    weight = classes.select(F.col("rep").alias("b"), "copies")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    certain = found.filter("b is null").select("a", F.col("n").alias("copies"))
    degree = both.join(weight, "b").select("a", "copies").unionByName(certain).groupBy("a").agg(F.sum("copies").alias("others"))
    joined = links.unionByName(found.filter("n = 0").select("a", "b"))
    found = components(joined.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = classes.join(degree, classes.rep == degree.a, "left").join(found, classes.rep == found.node, "left").select(
        "h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    out = fine.join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    apart = rows.filter(~good).select("vec_id", F.lit(0).alias("n_links"), F.col("vec_id").alias("component_id"))  # no join: they would share one key
    out = out.unionByName(apart)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
