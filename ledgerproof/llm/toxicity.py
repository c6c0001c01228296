"""Toxicity by a factorization machine over hashed terms.

Terms are a text's distinct words and the first three to six letters of each (so that inflected forms meet). The machine
adds linear weights and, for each pair of terms that stand together, the product of their factors: an insult weighs more
next to a group's name. A sparse linear fit over every term seen in a few rows of a bounded, labelled sample, with the least penalty that serves
a fifth of the rows, held back, no worse than the best one (by one standard error), picks terms with an effect of their own; those with an effect only
next to another one are picked by the score of their pair on what
that fit leaves over. All others have no weight, so long clean texts don't add up noise. Fitting is numpy in one task; scoring reads every whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, held, in_arrow, in_one_task, let_go, materialize, slices, texts_of, where_text
from .hashing import mix

#: Hash buckets, and prefix lengths in letters. Words and beginnings of PAIRED letters have the lower half of the buckets: these are screened in pairs.
BUCKETS, PREFIXES, PAIRED = 1 << 21, (3, 4, 5, 6), 4
HALF = BUCKETS // 2
#: Labelled rows of a class in the training sample, terms of all its rows, and rows of it that a term must stand in.
MOST_ROWS, MOST_TERMS, LEAST_ROWS = 4000, 8_000_000, 4
#: Penalties of a term in standard deviations of its gradient, of which held-back rows choose one, and steps of the sparse fit for each.
PENALTIES, STEPS = (4.5, 3.6, 2.8, 2.0), 60
#: Score at which a pair counts (no pair in fewer than its square of rows can reach it), what its rows must have left over in all, and terms compared at once.
PAIR_Z, PAIR_LEFT, PAIR_BLOCK = 6.0, 3.0, 512
PAIR_ROWS = int(PAIR_Z**2)
FACTORS, EPOCHS, RATE, BATCH, L1, L2 = 8, 30, 0.1, 256, 1e-3, 1e-4
#: Epochs that compare penalties, and rows held back that are needed for it.
CHOICE_EPOCHS, LEAST_BACK = 10, 40
#: Words whose weighed terms a task keeps between batches.
MOST_WORDS = 250_000
WORD = re.compile(r"[^\W\d_]+")


def terms(words: list[str]) -> np.ndarray:
    """Buckets of each word and its prefixes, a row per word; -1 where a prefix would be the word or longer."""
    out = np.full((len(words), 1 + len(PREFIXES)), -1, np.int64)
    if not words:
        return out
    out[:, 0] = np.array([xxhash.xxh64_intdigest(w, 7) for w in words], np.uint64) % np.uint64(HALF)
    longest = max(PREFIXES)
    letters = np.array(words, f"U{longest}").view(np.uint32).reshape(len(words), longest).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    h = np.zeros(len(words), np.uint64)
    for k in range(longest):
        h = mix(h * np.uint64(31) + letters[:, k] + np.uint64(1))
        if k + 1 in PREFIXES:
            bucket = (mix(h ^ np.uint64(k + 77)) % np.uint64(HALF)).astype(np.int64) + HALF * (k + 1 != PAIRED)
            out[:, 1 + PREFIXES.index(k + 1)] = np.where(sizes >= k + 1, bucket, -1)
    return out


def buckets_of(text: str) -> np.ndarray:
    """Distinct buckets of a whole text."""
    found = np.unique(terms(list(set(WORD.findall(text.lower())))))
    return found[found >= 0]


@dataclass
class Machine:
    chosen: np.ndarray  # sorted buckets
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Bias + linear + pairwise terms, for rows of positions in `chosen`."""
        owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.concatenate(rows) if rows else np.empty(0, np.int64)
        n = len(rows)
        out = self.bias + np.bincount(owner, self.linear[at], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            out += 0.5 * (np.bincount(owner, v, n) ** 2 - np.bincount(owner, v * v, n))
        return out

    def positions(self, texts: list[str]) -> list[np.ndarray]:
        """Weighed terms of each whole text."""
        known = held(("terms", self.bias, len(self.chosen), float(self.linear.sum())), dict)
        if len(known) > MOST_WORDS:
            known.clear()
        sets = [set(WORD.findall(t.lower())) for t in texts]
        new = list(set().union(*sets) - known.keys())
        if new:
            found = terms(new)
            at = np.minimum(np.searchsorted(self.chosen, found), max(0, len(self.chosen) - 1))
            hit = (self.chosen[at] == found) & (found >= 0) if len(self.chosen) else np.zeros(found.shape, bool)
            known.update(dict.fromkeys(new))
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                known[new[i]] = at[i][hit[i]]
        out = []
        for s in sets:
            got = [p for w in s if (p := known[w]) is not None]
            out.append(np.unique(np.concatenate(got)) if got else np.empty(0, np.int64))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.positions(texts)), -40, 40)))


def _within(flat: np.ndarray, sizes: np.ndarray, terms_: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in `terms_` of the buckets of all rows that stand there, bounds of the rows)."""
    place = np.full(number, -1, np.int32)
    place[terms_] = np.arange(len(terms_))
    at = place[flat]
    return at[at >= 0], np.r_[0, np.cumsum(at >= 0)][np.r_[0, np.cumsum(sizes)]]


def _sparse(at: np.ndarray, sizes: np.ndarray, y: np.ndarray, weights: np.ndarray, n: int, bias: float, mine: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(what is left of the labels, weights of terms) of a linear fit over all terms for each penalty, from the highest to the lowest: accelerated proximal steps.

    A term's penalty is in proportion to the deviation of its gradient, so rare and common terms are judged alike. `mine`: the rows' weights in the
    fit, 0 for rows held back.
    """
    bounds = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    who = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    by_term = np.argsort(at, kind="stable")
    rows_of, edges = who[by_term], np.searchsorted(at[by_term], np.arange(n + 1))
    del who, by_term

    def over_terms(v):  # sums of a row's value over the rows of each term
        return _sums(v.astype(np.float32)[rows_of], edges)

    def over_rows(v):
        return _sums(v.astype(np.float32)[at], bounds)

    start = mine * (y - 1 / (1 + np.exp(-bias)))
    scale = np.sqrt(np.maximum(over_terms(start**2), 1e-12))  # also makes the terms' columns comparable
    scale[scale < 1e-5] = 1e6  # terms of held-back rows alone stay out
    vector = np.ones(len(y))  # the largest eigenvalue of the scaled rows' products bounds the step
    norm = 1.0
    for _ in range(12):
        vector = over_rows(over_terms(vector) / scale**2)
        norm = float(np.sqrt(vector @ vector)) or 1.0
        vector /= norm
    rate = 1 / (0.3 * float(weights.max()) * (norm + len(y) / max(start @ start, 1e-9)) * 1.05)
    offset = 1 / np.sqrt(max(start @ start, 1e-9))
    b, w, fits = 0.0, np.zeros(n), []
    for penalty in PENALTIES:
        t, ahead_b, ahead_w = 1.0, b, w
        for _ in range(STEPS):
            raw = bias + ahead_b * offset + over_rows(ahead_w / scale)
            e = mine * (y - 1 / (1 + np.exp(-np.clip(raw, -40, 40))))
            old_b, old_w = b, w
            b = ahead_b + rate * e.sum() * offset
            moved = ahead_w + rate * over_terms(e) / scale
            w = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
            t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            ahead_b, ahead_w = b + (last - 1) / t * (b - old_b), w + (last - 1) / t * (w - old_w)
        raw = np.clip(bias + b * offset + over_rows(w / scale), -40, 40)
        fits.append((y - 1 / (1 + np.exp(-raw)), w / scale))
    return fits


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the runs between bounds; 0 for an empty one."""
    out = np.zeros(len(bounds) - 1)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, bounds[full])
    return out


def _paired(at: np.ndarray, sizes: np.ndarray, left: np.ndarray, n: int, may: np.ndarray) -> np.ndarray:
    """Terms (of those that `may`) of pairs that stand together in PAIR_ROWS rows or more and whose rows have more, or less, left over than chance.

    What either term has left over on average is taken off. All pairs of such terms are looked at, a block of terms by another, by batched matrix products.
    """
    often = np.flatnonzero(may & (np.bincount(at, minlength=n) >= PAIR_ROWS))
    who = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    drawn = np.bincount(at, np.random.default_rng(0).random(len(sizes))[who], n)
    often = often[np.unique(np.round(drawn[often], 9), return_index=True)[1]]  # terms of the same rows are one
    place = np.full(n, -1, np.int64)
    place[often] = np.arange(len(often))
    mean = (np.abs(np.bincount(at, left[who], n)) / np.maximum(np.bincount(at, minlength=n), 1))[often].astype(np.float32)
    inside = place[at] >= 0
    who, col = who[inside], place[at[inside]]
    order = np.argsort(col, kind="stable")
    who, edges = who[order], np.searchsorted(col[order], np.arange(len(often) + 1))
    found = np.zeros(len(often), bool)
    r = left.astype(np.float32)[:, None]

    def block(lo, hi):
        x = np.zeros((len(sizes), hi - lo), np.float32)
        a, b = edges[lo], edges[hi]
        x[who[a:b], np.repeat(np.arange(hi - lo), np.diff(edges[lo: hi + 1]))] = 1
        return x

    r2 = (left**2).astype(np.float32)[:, None]
    spans = [(lo, min(lo + PAIR_BLOCK, len(often))) for lo in range(0, len(often), PAIR_BLOCK)]
    for k, one in enumerate(spans):
        x = block(*one)
        signed, squared, counts = (np.ascontiguousarray(v.T) for v in (x * r, x * r2, x))
        for two in spans[k:]:
            z = x if two == one else block(*two)
            total = np.abs(signed @ z)
            if not (total >= PAIR_LEFT).any():
                continue
            both = counts @ z
            more = total - both * np.maximum.outer(mean[one[0]: one[1]], mean[two[0]: two[1]])
            good = (total >= PAIR_LEFT) & (both >= PAIR_ROWS) & (more > 0)
            if good.any():
                good[good] = more[good] >= PAIR_Z * np.sqrt(np.maximum((squared @ z)[good], 1e-9))
            if two == one:
                np.fill_diagonal(good, False)
            found[one[0]: one[1]] |= good.any(axis=1)
            found[two[0]: two[1]] |= good.any(axis=0)
    return often[found]


def fit(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray | None = None, seed: int = 1) -> Machine:
    """Train on rows of distinct buckets with 0/1 labels: adagrad steps, soft thresholds on linear weights."""
    y = np.asarray(labels, np.float64)
    weights = np.ones(len(y)) if weights is None else weights
    prior = float(np.clip((weights * y).sum() / max(weights.sum(), 1e-9), 1e-4, 1 - 1e-4)) if len(y) else 1e-4
    none = Machine(np.empty(0, np.int64), float(np.log(prior / (1 - prior))), np.zeros(0), np.zeros((0, FACTORS)))
    if not len(y) or y.min() == y.max():
        return none
    sizes = np.array([len(r) for r in rows], np.int64)
    flat = np.concatenate(rows)
    number = int(flat.max(initial=0)) + 1
    seen = np.flatnonzero(np.bincount(flat, minlength=number) >= LEAST_ROWS)
    kept, bounds = _within(flat, sizes, seen, number)
    back = np.arange(len(y)) % 5 == 4
    fits = _sparse(kept, np.diff(bounds), y, weights, len(seen), none.bias, np.where(back, 0.0, weights))
    paired = _paired(kept, np.diff(bounds), fits[-1][0], len(seen), seen < HALF)
    choices = [(np.union1d(np.flatnonzero(w), paired), w) for _, w in fits]
    choices = [c for c in choices if len(c[0])]
    if not choices:
        return none

    def trained(fine: np.ndarray, linear: np.ndarray, rows_of: np.ndarray, epochs: int) -> tuple[Machine, np.ndarray, np.ndarray]:
        at, edges = _within(flat, sizes, seen[fine], number)
        m = Machine(seen[fine], none.bias, linear[fine], np.random.default_rng(seed).normal(0, 0.02, (len(fine), FACTORS)))
        _train(m, at.astype(np.int64), edges, y, weights, rows_of, epochs, seed)
        return m, at, edges

    def losses(m: Machine, at: np.ndarray, edges: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(back)
        raw = np.clip(m.raw([at[edges[i]: edges[i + 1]] for i in some]), -40, 40)
        return weights[some] * np.log1p(np.exp(np.where(y[some] > 0.5, -raw, raw)))

    if len(choices) > 1 and back.sum() >= LEAST_BACK:
        # few rows are held back: the most terms whose loss isn't worse than the least one by more than the differences between rows explain
        each = [losses(*trained(*c, np.flatnonzero(~back), CHOICE_EPOCHS)) for c in choices]
        best = min(each, key=np.sum)
        excess = [(x - best).sum() - np.sqrt(len(best)) * (x - best).std() for x in each]
        choices = [c for c, more in zip(choices, excess, strict=True) if more <= 0]
    return trained(*choices[-1], np.arange(len(y)), EPOCHS)[0]


def _train(m: Machine, kept: np.ndarray, bounds: np.ndarray, y: np.ndarray, weights: np.ndarray, rows: np.ndarray, epochs: int, seed: int) -> None:
    """Adagrad steps over the given rows."""
    rng = np.random.default_rng(seed)
    n = len(m.chosen)
    gw, gv, gb = np.full(n, 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH)):
            mine = [kept[bounds[i]: bounds[i + 1]] for i in part]
            e = (1 / (1 + np.exp(-np.clip(m.raw(mine), -40, 40))) - y[part]) * weights[part] / len(part)
            at, who = np.concatenate(mine), np.repeat(np.arange(len(part)), [len(r) for r in mine])
            step = np.bincount(at, e[who], n)
            gw += step**2
            rate = RATE / np.sqrt(gw)
            moved = m.linear - rate * step
            m.linear = np.sign(moved) * np.maximum(np.abs(moved) - rate * L1, 0)
            for f in range(FACTORS):
                v = m.factors[at, f]
                total = np.bincount(who, v, len(part))
                step = np.bincount(at, e[who] * (total[who] - v), n) + L2 * m.factors[:, f] / len(rows)
                gv[:, f] += step**2
                m.factors[:, f] -= RATE / np.sqrt(gv[:, f]) * step
            gb += e.sum() ** 2
            m.bias -= RATE / np.sqrt(gb) * e.sum()


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, place, terms) of labelled rows outside the held-out fold, at most `most` ids of each class, and how many ids each class has.

    A hash of the id picks ids below a threshold, so nothing is sorted; conflicting labels of one id count as toxic, and of several rows of
    one id one teaches (the least by hash of its text). The ids, at most 2 x `most`, are broadcast to the documents; whole texts become
    distinct term buckets there. With very long texts fewer ids are taken, so that there are MOST_TERMS buckets at most.
    """
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 30))
    picked = known.withColumn("place", place)
    limit = F.lit(-1)
    for label, n in counts.items():
        limit = F.when(F.col("toxic") == label, F.lit(min(1 << 30, int((1 << 30) * 0.85 * most / n)) if n > most else 1 << 30)).otherwise(limit)
    ids = picked.filter(F.col("place") < limit).select("doc_id", "toxic", "place")

    def run(batches):
        let_go()
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [buckets_of(t).astype(np.int32) for t in texts_of(batch.column("text"))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("doc_id", "toxic", "place", "h")), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "toxic", "place", "h", "terms"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic"), F.col("place").cast("long").alias("place"), F.xxhash64("text").alias("h"), "text"
    )
    found = in_arrow(rows, run, "doc_id long, toxic int, place long, h long, terms array<int>")
    one = materialize(found.groupBy("doc_id", "toxic", "place").agg(F.min_by("terms", "h").alias("terms")), "sample")
    sizes = one.select("doc_id", "place", F.size("terms").alias("n")).toPandas().sort_values(["place", "doc_id"])  # at most 2 x `most` rows
    fits = sizes[sizes["n"].cumsum() <= MOST_TERMS]
    upto = int(fits["place"].max()) if len(fits) else -1
    return one.filter(F.col("place") <= (upto if len(fits) < len(sizes) else 1 << 30)).select("doc_id", "toxic", "place", "terms"), counts


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_ROWS) -> Machine:
    """Fit on the sample, in a task; classes weigh as much as they have ids."""
    rows, counts = sample(docs, labels, most)

    def make(batches: list[pa.RecordBatch]) -> Machine:
        if not batches:
            return fit([], np.empty(0))
        got = pa.Table.from_batches(batches).combine_chunks()
        place, ids, label = (got.column(c).to_numpy() for c in ("place", "doc_id", "toxic"))
        order = np.lexsort((ids, place))
        order = np.concatenate([order[label[order] == c][:most] for c in (0, 1)])
        found = got.column("terms").combine_chunks()
        bounds, flat = found.offsets.to_numpy(), found.values.to_numpy()  # arrays, not lists of objects
        taken = {c: max(1, int((label[order] == c).sum())) for c in (0, 1)}
        weight = np.array([counts.get(int(c), 0) / taken[int(c)] for c in label[order]], np.float64)
        return fit([flat[bounds[i]: bounds[i + 1]] for i in order], label[order], weight * len(order) / max(weight.sum(), 1e-9))

    return in_one_task(rows, make)


def score(docs: DataFrame, labels: DataFrame | None = None, machine: Machine | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `docs`; only the text is scored (null: empty).

    An empty text gets the score of a text without weighed terms. Repeated rows score alike; without labels of both
    classes every score is the prior.
    """
    machine = learn(docs, labels) if machine is None else machine
    sent = docs.sparkSession.sparkContext.broadcast(machine)  # at most the terms of the sample

    def run(batches):
        own = sent.value
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                p = own.score(texts_of(batch.column("t")))
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("h"), F.col("text").alias("t"))
    return in_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def kept(docs: DataFrame, labels: DataFrame | None = None, machine: Machine | None = None) -> DataFrame:
    """The rows of `docs` with a score below one half, with all their columns. Decided row by row in one scan."""
    machine = learn(docs, labels) if machine is None else machine
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return where_text(docs, lambda texts: sent.value.score([t or "" for t in texts]) < 0.5)
