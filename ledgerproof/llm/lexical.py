"""Ranked lexical search as a blocked product of sparse matrices.

The documents are kept as blocks of a term-document matrix (compressed by term, only terms that the items ask for, with their counts), written once.
Document frequencies and lengths are sums over the blocks. Then every block is multiplied by the item-term matrix: a row of the product is the merge
of the block's rows for the item's terms (Gustavson's order), impacts being 64-bit integers, and of each row only the highest scores stay, first of a block, then of a
task, then of the item. Items are taken in blocks of a bounded number of terms, each of which is one pass over the documents.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary_texts, in_arrow, let_go, materialize, slices

#: Documents of a block of the matrix, and the cells of the product that are merged at once (one item's row at least).
BLOCK_DOCS, CELLS = 4096, 1 << 19
#: Item terms of a block of items (an item with more is a block of its own).
BLOCK_TERMS = 1_000_000
# a byte to its lower-case (A-Z only), ASCII that is neither letter nor digit to a blank; all bytes of other characters stay
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MATRIX = "ids array<long>, lengths array<long>, terms array<int>, held array<int>, at array<int>, tf array<int>, n_docs long, n_terms long"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of whatever isn't ASCII, A-Z lower-cased."""
    return text.translate(TERM_BYTES).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term binary, times long): each term of an item once, with its occurrences. Rows of one item_id are one item; null texts have no terms."""

    def run(batches):
        let_go()
        for batch in batches:
            rows = [(k, t, n) for k, text in zip(batch.column("k").to_pylist(), binary_texts(batch.column("t")), strict=True) for t, n in Counter(terms_of(text)).items()]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["item_id", "term", "times"])

    rows = in_arrow(items.select(F.col("item_id").cast("long").alias("k"), F.col("text").alias("t")), run, "item_id long, term binary, times long")
    return rows.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def matrix(docs: DataFrame, vocabulary) -> DataFrame:
    """MATRIX: a row for each block of documents with terms. `vocabulary` is a broadcast list of terms.

    ids and lengths are the documents' (a null id stays null), terms the numbers of those that the block holds, held in how many of its documents, at and tf the
    places of these documents in the block and the occurrences there, term after term. n_docs and n_terms count all of the block.
    """

    def run(batches):
        let_go()
        number = {t: i for i, t in enumerate(vocabulary.value)}
        for whole in batches:
            for part in slices(whole, "t", 4 << 20):
                for start in range(0, part.num_rows, BLOCK_DOCS):
                    batch = part.slice(start, BLOCK_DOCS)
                    kept, lengths, terms, at, tf = [], [], [], [], []
                    for i, text in enumerate(binary_texts(batch.column("t"))):
                        found = terms_of(text)
                        if not found:
                            continue
                        here = [(number[t], n) for t, n in Counter(found).items() if t in number]
                        terms += [t for t, _ in here]
                        tf += [n for _, n in here]
                        at += [len(kept)] * len(here)
                        kept.append(i)
                        lengths.append(len(found))
                    if not kept:
                        continue
                    terms, at, tf = np.array(terms, np.int32), np.array(at, np.int32), np.array(tf, np.int32)
                    order = np.argsort(terms, kind="stable")
                    names, held = np.unique(terms, return_counts=True)
                    row = [batch.column("k").take(pa.array(kept)).to_pylist(), lengths, names, held.astype(np.int32), at[order], tf[order], len(kept), sum(lengths)]
                    kinds = [pa.list_(pa.int64())] * 2 + [pa.list_(pa.int32())] * 4 + [pa.int64()] * 2
                    yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=[f.split()[0] for f in MATRIX.split(", ")])

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").alias("t")), run, MATRIX)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def damping(length: int, documents: int, total: int) -> int:
    return 100 - 90 + 90 * length * documents // total


class Product:
    """The items' rows and what they have gathered so far in one task: for each item at most k of (score, no id, id), best first."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, documents: int, total: int, k: int):
        self.starts, self.terms, self.times, self.weights = starts, terms, times, weights
        self.documents, self.total, self.k = documents, total, k
        self.best: list[np.ndarray | None] = [None] * (len(starts) - 1)
        self.least = np.zeros(len(starts) - 1, np.int64)  # a later document needs this score at least

    def take(self, ids: np.ndarray, unnamed: np.ndarray, lengths: list[int], terms: np.ndarray, held: np.ndarray, at: np.ndarray, tf: np.ndarray) -> None:
        """Multiply by one block of documents."""
        width = len(ids)
        damped = np.array([damping(n, self.documents, self.total) for n in lengths], np.int64)
        tf = tf.astype(np.int64)
        impact = np.repeat(self.weights[terms], held) * (1_000_000_000 * tf // (1000 * tf + 8 * damped[at]))
        ends = np.cumsum(held)
        row_start, row_size = np.zeros(len(self.weights), np.int64), np.zeros(len(self.weights), np.int64)
        row_start[terms], row_size[terms] = ends - held, held
        sizes = row_size[self.terms]
        bounds = np.r_[0, np.cumsum(sizes)][self.starts]  # products before each item
        item, last = 0, len(self.starts) - 1
        while item < last:
            # items whose products and accumulators stay within bounds, one at least
            stop = min(max(int(np.searchsorted(bounds, bounds[item] + CELLS, "right")) - 1, item + 1), item + max(CELLS // width, 1), last)
            a, b = int(self.starts[item]), int(self.starts[stop])
            size = sizes[a:b]
            before = np.cumsum(size) - size
            each = np.repeat(row_start[self.terms[a:b]] - before, size) + np.arange(int(size.sum()))
            owner = np.repeat(np.arange(stop - item), np.diff(self.starts[item: stop + 1]))
            sums = np.zeros((stop - item) * width, np.int64)
            np.add.at(sums, np.repeat(owner * width, size) + at[each], np.repeat(self.times[a:b], size) * impact[each])
            sums = sums.reshape(stop - item, width)
            for row in np.flatnonzero(sums.max(axis=1) >= np.maximum(self.least[item:stop], 1)).tolist():
                self._keep(item + row, sums[row], ids, unnamed)
            item = stop

    def _keep(self, item: int, scores: np.ndarray, ids: np.ndarray, unnamed: np.ndarray) -> None:
        good = np.flatnonzero(scores >= max(int(self.least[item]), 1))
        if len(good) > self.k:  # all that tie with the last place stay for the sort
            good = good[scores[good] >= np.partition(scores[good], len(good) - self.k)[len(good) - self.k]]
        rows = np.stack([scores[good], unnamed[good], ids[good]])
        if self.best[item] is not None:
            rows = np.concatenate([self.best[item], rows], axis=1)
        rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.k]]
        self.best[item] = rows
        if rows.shape[1] == self.k:
            self.least[item] = rows[0, -1]


def _block(docs: DataFrame, terms: DataFrame, k: int, once: bool) -> DataFrame:
    """item_id, doc_id, score: at least the k best of each item of one block."""
    spark = docs.sparkSession
    asked = terms.orderBy("item_id", "term").toArrow()  # one block of items: BLOCK_TERMS rows, or one item
    names = asked.column("term").to_pylist()
    vocabulary = sorted(set(names))
    number = {t: i for i, t in enumerate(vocabulary)}
    item_ids = asked.column("item_id").to_pylist()
    starts = [i for i in range(len(item_ids)) if i == 0 or item_ids[i] != item_ids[i - 1]]
    items = [item_ids[i] for i in starts]
    starts = np.array([*starts, len(item_ids)], np.int64)
    row_terms = np.array([number[t] for t in names], np.int64)
    times = np.ones(len(names), np.int64) if once else asked.column("times").to_numpy()

    blocks = materialize(matrix(docs, spark.sparkContext.broadcast(vocabulary)), "matrix")
    whole = blocks.agg(F.sum("n_docs").alias("documents"), F.sum("n_terms").alias("total")).first()
    df = blocks.select(F.explode(F.arrays_zip("terms", "held")).alias("x")).groupBy("x.terms").agg(F.sum("x.held").alias("df")).toArrow()  # a row for each term of the block of items
    weights = np.zeros(len(vocabulary), np.int64)
    for t, n in zip(df.column("terms").to_pylist(), df.column("df").to_pylist(), strict=True):
        weights[t] = weight(whole.documents, n)
    sent = spark.sparkContext.broadcast((starts, row_terms, times, weights, items))

    def run(batches):
        let_go()
        starts, row_terms, times, weights, items = sent.value
        product = Product(starts, row_terms, times, weights, whole.documents, whole.total, k)
        flat = lambda batch, name, i: batch.column(name)[i].values
        for batch in batches:
            for i in range(batch.num_rows):
                ids = flat(batch, "ids", i)
                arrays = [flat(batch, name, i).to_numpy(zero_copy_only=False) for name in ("terms", "held", "at", "tf")]
                product.take(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), flat(batch, "lengths", i).to_pylist(), *arrays)
        for item, rows in zip(items, product.best, strict=True):
            if rows is not None:
                found = pa.array([None if missing else i for missing, i in zip(rows[1].tolist(), rows[2].tolist(), strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([item] * rows.shape[1], pa.int64()), found, pa.array(rows[0], pa.int64())], names=["item_id", "doc_id", "score"])

    return in_arrow(blocks.select("ids", "lengths", "terms", "held", "at", "tf"), run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, once: bool = True) -> DataFrame:
    """item_id, rank int, doc_id long, score long: the k documents of highest score above 0 for each item (fewer, if there are no more).

    A document's score sums weight * (10^9 tf div (1000 tf + 8 damping)) over the item's terms, each counted `once`, or as often as it stands in the item. Documents are rows: a
    repeated id ranks once for each of its rows. Equal scores rank by doc_id, rows without an id last. Rows without a term (null and empty texts too) don't count
    as documents. Items without a term have no rows, nor has anything where one table is empty. A task holds k rows for each item of a block.
    """
    terms = materialize(item_terms(items), "item-terms")
    total = terms.count()
    parts = max(1, math.ceil(2 * total / BLOCK_TERMS))  # halved, as items are dealt by hash
    found = None
    for part in range(parts):
        some = terms if parts == 1 else terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        if not some.isEmpty():
            rows = materialize(_block(docs, some, k, once), "found")
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents
), sized AS (
    SELECT r, doc_id, found, CAST(len(found) AS BIGINT) AS n FROM d WHERE len(found) > 0
), whole AS (
    SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM sized
), asked AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), counted AS (
    SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(found) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY r, term
), weighed AS (
    SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), whole
), scored AS (
    SELECT item_id, c.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total)))) AS BIGINT) AS score
    FROM asked JOIN counted c USING (term) JOIN weighed USING (term) JOIN sized s ON s.r = c.r, whole GROUP BY item_id, c.r
), ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN sized USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
