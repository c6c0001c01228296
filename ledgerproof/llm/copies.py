"""Near copies by the exact Jaccard similarity of word shingles.

Equal shingle sets are one node. Two sets of similarity `share` or more have a shingle in common among the first few of each
in any one order of all shingles (a prefix of n - ceil(share * n) + 1), so joining prefixes misses no pair. The order puts shingles that a sample of
the documents repeats last: it only decides how many candidates there are. Each set also has a sketch of a bit or more for a shingle, of which every
shingle flips one: two sketches differ in at most as many bits as the sets differ in shingles, so bit counts rule out most
candidates and never a similar pair. The rest is verified on whole sets, in three steps, of which each looks only at what isn't
connected yet: each set against the least one that it shares a shingle with (whole sets move once, to that one's task), then against the least
of each other shingle, then all sets of a shingle, whose sketches are compared in the shingle's tasks: where many share one, first each set with the one that differs least from it, which
joins most of a dense group by a pair for each set, then all pairs that the sketches don't rule out and that still aren't connected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, first_rows, in_arrow, let_go, materialize, slices, small_batches
from .components import components
from .simhash import fingerprints, near_fingerprints

#: Documents whose shingles are counted for the order, times a shingle must stand there to come late, and shingles of that order.
SAMPLED, OFTEN, MOST_OFTEN = 4000, 3, 500_000
#: Least bits of a sketch.
SKETCH = 512
#: Sets that share a shingle beyond which each is first joined with the one nearest to it.
DENSE = 32
#: Rows of six numbers at most (15 MB) that are sent to every task instead of being shuffled with what they meet; more are shuffled.
FEW_ROWS = 300_000
#: Sets that share a shingle and are compared by their sketches in one task; more are dealt to pairs of such blocks.
BLOCK = 2048
#: Sets that one task compares with the least one of a star; more are dealt to several.
STAR = 4096
MARKS = "doc_id long, node long, n int, bits array<long>, first array<long>, h long"


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct XXH64 of `size` words in a row (white space and A-Z as in SimHash); a shorter text is one shingle."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.int64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b], 42) for a, b in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)], np.uint64).view(np.int64))


def prefix(found: np.ndarray, order: tuple[np.ndarray, np.ndarray], share: float) -> np.ndarray:
    """The first shingles of a set, one of which any set that is similar enough has among its own first ones."""
    keys, often = order
    n = len(found)
    least = int(np.ceil(share * n - 1e-9))
    rank = np.zeros(n, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        rank = np.where(keys[at] == found, often[at], 0)
    return found[np.lexsort((found, rank))][: n - least + 1]


def _sets(rows: DataFrame, size: int, schema: str, make) -> DataFrame:
    """Over (k, t): `make(keys, sets)` gives the columns of `schema`; with a column h, that is handed on last."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        let_go()
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                columns = make(batch.column("k"), [shingles(t, size) for t in binary_texts(batch.column("t"))])
                yield pa.RecordBatch.from_arrays([*columns, *([batch.column("h")] if "h" in names else [])], names=names)

    return in_arrow(rows, run, schema)


def _digests(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def sketch(found: np.ndarray) -> np.ndarray:
    """The words of a set's sketch: a power of two of bits, its size or more; every shingle flips the bit that its low bits number.

    A sketch of half as many bits is its two halves' exclusive or.
    """
    bits = max(SKETCH, 1 << (len(found) - 1).bit_length()) if len(found) else SKETCH
    return np.packbits((np.bincount(found & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _lists(keys, sets):
    return [keys, pa.array(sets, pa.list_(pa.int64()))]


def _possible(pairs: DataFrame, marks: DataFrame, share: float) -> DataFrame:
    """The pairs (u, v) whose sizes and sketches don't rule the similarity out. Similar sizes differ by one halving of a sketch at most."""
    side = lambda node, x: marks.select(F.col("node").alias(node), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.join(side("u", "x"), "u").join(side("v", "y"), "v").filter(F.least("nx", "ny") >= share * F.greatest("nx", "ny") - 1e-9)
    half = lambda b: F.zip_with(F.slice(b, 1, (F.size(b) / 2).cast("int")), F.slice(b, (F.size(b) / 2).cast("int") + 1, (F.size(b) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    x = F.when(F.size("bitsx") > F.size("bitsy"), half(F.col("bitsx"))).otherwise(F.col("bitsx"))
    y = F.when(F.size("bitsy") > F.size("bitsx"), half(F.col("bitsy"))).otherwise(F.col("bitsy"))
    differ = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    return both.filter(differ * (1 + share) <= (1 - share) * (F.col("nx") + F.col("ny")) + 1e-9).select("u", "v")


def similar(x: np.ndarray, y: np.ndarray, share: float) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= share * (len(x) + len(y) - both) - 1e-9


def _stars(stars: DataFrame, texts: DataFrame, nodes: DataFrame, size: int, share: float) -> DataFrame:
    """Those rows of stars (u, v), one for each v, whose whole sets are similar. Each set is made and moved once; the least one of a large star to several tasks."""
    parts = stars.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    rays = stars.join(parts, "u").select("u", F.col("v").alias("node"), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("ray"))
    middles = parts.select("u", F.col("u").alias("node"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("ray"))
    wanted = materialize(rays.unionByName(middles).join(nodes.select("node", "doc_id"), "node"), "stars")
    rows = texts.select("k", "t").join(_few(wanted), F.col("k") == F.col("doc_id")).select("node", "u", "part", "ray", "t")
    small_batches(stars.sparkSession)

    def sets(batches):
        let_go()
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                found = [shingles(t, size) for t in binary_texts(batch.column("t"))]
                own = pa.array(_digests(found) == batch.column("node").to_numpy(), pa.bool_())  # not another text of the same id
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "u", "part", "ray")), pa.array(found, pa.list_(pa.int64()))], names=["node", "u", "part", "ray", "s"])
                yield out.filter(own)

    def compare(batches):
        let_go()
        middle = at = None
        for batch in batches:
            good = []
            for u, part, ray, s in zip(batch.column("u").to_pylist(), batch.column("part").to_pylist(), batch.column("ray").to_pylist(), batch.column("s"), strict=True):
                s = s.values.to_numpy()
                if ray == 0:
                    middle, at = s.copy(), (u, part)
                good.append(ray == 1 and at == (u, part) and similar(middle, s, share))
            out = batch.filter(pa.array(good, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("u"), out.column("node")], names=["u", "v"])

    made = rows.mapInArrow(sets, "node long, u long, part int, ray int, s array<long>")
    return made.repartition("u", "part").sortWithinPartitions("u", "part", "ray").mapInArrow(compare, "u long, v long")


def _verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (u, v) whose whole sets have the similarity."""

    def run(batches):
        let_go()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                u, v = batch.column("a"), batch.column("b")
                good = [similar(x.values.to_numpy(), y.values.to_numpy(), share) for x, y in zip(u, v, strict=True)]
                yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    left = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    small_batches(pairs.sparkSession)
    return _few(pairs).join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _few(rows: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast where it is small."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else rows


def _meeting(rows: DataFrame, share: float, nearest: bool = False) -> DataFrame:
    """The pairs (u, v) of sets that share a key, aren't connected, and that sizes and sketches don't rule out. rows: key, node, c, n, bits, held (the key's rows).
    `nearest`: of each set's pairs in a key (or two blocks of it) only the one whose sketches differ least.

    A key's sets meet in one task and are compared there as they come, in blocks; what leaves it are pairs that must be verified. A key with more
    than BLOCK sets is cut into blocks, and each two of them meet in a task of their own.
    """
    parts = F.ceil(F.col("held") / BLOCK).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "c", "n", "bits")
    small_batches(rows.sparkSession)

    def pairs(part, node, c, n, sketches):
        """Index pairs of a group; lists are by sketch length, and a sketch meets those of its own length and, halved, the next shorter ones."""
        by: dict[int, list[int]] = {}
        for i, s in enumerate(sketches):
            by.setdefault(len(s), []).append(i)
        best: dict[int, tuple] = {}  # of a set: its least difference, and with which set
        for length, mine in by.items():
            own = np.stack([sketches[i] for i in mine])
            for shorter, against in ((length, mine), (length // 2, by.get(length // 2))):
                if against is None:
                    continue
                table = own if shorter == length else np.stack([sketches[i] for i in against])
                folded = own if shorter == length else own[:, :shorter] ^ own[:, shorter:]
                against = np.array(against)
                for k, i in enumerate(mine):
                    good = c[against] != c[i]
                    good &= np.minimum(n[against], n[i]) >= share * np.maximum(n[against], n[i]) - 1e-9
                    if part[0] >= 0:  # two blocks: only what stands in different ones
                        good &= part[against] != part[i]
                    if shorter == length:
                        good &= against > i
                    at = np.flatnonzero(good)
                    if len(at):
                        differ = np.bitwise_count(table[at] ^ folded[k]).sum(axis=1, dtype=np.int64)
                        good = differ * (1 + share) <= (1 - share) * (n[against[at]] + n[i]) + 1e-9
                        those = against[at[good]].tolist()
                        if not nearest:
                            yield from ((min(node[i], node[j]), max(node[i], node[j])) for j in those)
                            continue
                        for j, d in zip(those, differ[good].tolist(), strict=True):
                            for x, y in ((i, j), (j, i)):
                                if x not in best or (d, node[y]) < best[x]:
                                    best[x] = d, node[y]
        yield from {(min(node[x], y), max(node[x], y)) for x, (_, y) in best.items()}

    def compare(batches):
        let_go()
        at, held = None, []

        def close():
            if len(held) > 1:
                part, node, c, n = (np.array([h[x] for h in held], np.int64) for x in range(4))
                part = part if at[1] != at[2] else np.full(len(held), -1)
                found = list(pairs(part, node.tolist(), c, n, [h[4] for h in held]))
                if found:
                    u, v = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("key", "low", "high", "part", "node", "c", "n")]
            for key, low, high, part, node, c, n, bits in zip(*columns, batch.column("bits"), strict=True):
                if (key, low, high) != at:
                    yield from close()
                    at, held = (key, low, high), []
                held.append((part, node, c, n, bits.values.to_numpy().view(np.uint64).copy()))
        yield from close()

    dealt = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(compare, "u long, v long").distinct()


def classes(docs: DataFrame, size: int = 5, share: float = 0.8) -> DataFrame:
    """(doc_id, component_id, h, c) of every row with an id: the least doc_id that chains of similar texts reach, the text's xxhash64, and the class.

    Texts without words are equal. Repeated ids are repeated here, each with its own text's class. Sets are told apart by 64-bit hashes.
    """
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("k"), F.col("text").alias("t"), F.xxhash64("text").alias("h"))
    total = texts.count()
    some = texts if total <= SAMPLED else texts.filter(F.pmod(F.xxhash64("k", "h"), F.lit(1 << 30)) < int((1 << 30) * SAMPLED / total))
    listed = _sets(some.select("k", "t"), size, "node long, shingles array<long>", _lists)
    counted = listed.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= OFTEN)
    counted = counted.orderBy(F.desc("n"), "key").limit(MOST_OFTEN).toArrow()
    keys, often = counted.column("key").to_numpy(), counted.column("n").to_numpy()
    order = np.argsort(keys)
    sent = docs.sparkSession.sparkContext.broadcast((keys[order], often[order]))  # of what a sample repeats, MOST_OFTEN at most

    def marked(keys, sets):
        return [
            keys, pa.array(_digests(sets)), pa.array([len(s) for s in sets], pa.int32()), pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
            pa.array([prefix(s, sent.value, share) for s in sets], pa.list_(pa.int64())),
        ]

    marks = materialize(_sets(texts, size, MARKS, marked), "marks")
    nodes = materialize(marks.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")), "nodes")
    # copies of one set file the same rows, which the distinct ones among shared keys make one
    filed = marks.select(F.explode("first").alias("key"), "node")
    shared = filed.groupBy("key").agg(F.min("node").alias("u"), F.max("node").alias("last")).filter("u < last").select("key", "u")
    filed = materialize(filed.join(shared, "key").distinct(), "shared")
    bits = materialize(marks.select("node", "n", "bits").dropDuplicates(["node"]), "bits")
    again = marks.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("node")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Similar ones of written pairs; only sets that are needed are made again."""
        wanted = materialize(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct().join(nodes, "node").select("node", "doc_id"), f"{name}-wanted")
        ids = _few(wanted).select(F.col("doc_id").alias("k"))
        sets = _sets(texts.join(ids, "k", "left_semi").select("k", "t"), size, "node long, shingles array<long>", lambda _, x: [pa.array(_digests(x)), pa.array(x, pa.list_(pa.int64()))])
        if not wanted.join(again, "node", "left_semi").isEmpty():  # whole rows that repeat
            sets = sets.dropDuplicates(["node"])
        return materialize(_verified(pairs, materialize(sets, f"{name}-sets"), share), name)

    def classed(rows: DataFrame, found: DataFrame, node: str, c: str) -> DataFrame:
        return rows.join(found.select(F.col("node").alias(node), F.col("component").alias(c)), node, "left").withColumn(c, F.coalesce(c, node))

    def open_rows(found: DataFrame, name: str) -> DataFrame:
        """(key, node, c, held) of the shingles whose sets aren't all connected yet; held: how many sets a shingle has."""
        named = classed(filed.select("key", "node"), found, "node", "c")
        keys = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count(F.lit(1)).alias("held")).filter("low < high").select("key", "held")
        return materialize(named.join(keys, "key"), name)

    # each set against one other: a shingle that thousands share, or many shingles that two share, make one row for each set
    stars = _possible(filed.filter("u < node").groupBy(F.col("node").alias("v")).agg(F.min("u").alias("u")), bits, share)
    links = materialize(_stars(materialize(stars, "star-pairs"), texts, nodes, size, share), "first")
    found = components(links)
    left = open_rows(found, "open")
    if not left.isEmpty():
        least = left.groupBy("key").agg(F.min(F.struct("c", "node")).alias("least")).select("key", F.col("least.c").alias("cu"), F.col("least.node").alias("u"))
        rest = left.join(least, "key").filter("c <> cu").select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
        links = links.unionByName(verified(materialize(_possible(rest, bits, share), "second-pairs"), "second"))
        found = components(links)
        left = open_rows(found, "still-open")
    dense = left.filter(F.col("held") > DENSE)
    if not dense.isEmpty():
        links = links.unionByName(verified(materialize(_meeting(dense.join(bits, "node"), share, nearest=True), "nearest-pairs"), "nearest"))
        found = components(links)
        left = open_rows(found, "last-open")
    rest = materialize(_meeting(left.join(bits, "node"), share), "third-pairs")
    joined = found if rest.isEmpty() else components(links.unionByName(verified(rest, "third")))
    named = marks.select("doc_id", "node", "h").join(joined, "node", "left").select("doc_id", F.coalesce("component", "node").alias("c"), "h")
    least = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "c").select("doc_id", "component_id", "h", "c")


def with_fingerprints(docs: DataFrame, found: DataFrame, radius: int) -> DataFrame:
    """`found` (classes of docs) with those classes made one that chains of SimHash fingerprints within `radius` bits connect.

    A fingerprint is a node by itself, not by an id, so texts that share an id aren't connected by it.
    """
    prints = materialize(fingerprints(docs.filter("doc_id is not null")).select("fp", "h").distinct(), "prints")
    near = components(near_fingerprints(prints.select("fp", F.col("fp").alias("rep")).distinct(), radius))
    met = prints.join(near, prints["fp"] == near["node"], "left").select("h", F.coalesce("component", "fp").alias("s"))
    met = materialize(met.join(found.select("h", "c").distinct(), "h").select("s", "c").distinct(), "met")
    least = met.groupBy("s").agg(F.min("c").alias("u"), F.max("c").alias("last")).filter("u < last").select("s", "u")
    ends = components(met.join(least, "s").filter("c <> u").select("u", F.col("c").alias("v"))).withColumnRenamed("node", "c")
    return found.join(ends, "c", "left").select("doc_id", "h", F.coalesce("component", "c").alias("c"))


def kept(docs: DataFrame, size: int = 5, share: float = 0.8, radius: int | None = None) -> DataFrame:
    """One row of each class of near copies (see first_rows for which one), with all its columns. Rows without an id stay.

    `radius`: texts are near copies too where their SimHash fingerprints differ in so many bits at most.
    """
    found = classes(docs, size, share)
    return first_rows(docs, found if radius is None else with_fingerprints(docs, materialize(found, "classes"), radius), "c")
