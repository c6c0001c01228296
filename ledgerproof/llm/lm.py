"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Symbols are the text end, classes (by their last letters) of words, and words of their own: all those with LEAST_COUNT
training tokens and a thirtieth of the square root of all, so the vocabulary grows with the corpus (up to HEAD). A symbol's
logit is the product of its output vector with the sum of the two preceding symbols' input vectors, each scaled by its position's weights, plus a
bias. Symbols stand in groups by frequency: the model gives a group's probability, then a symbol's within its group, so normalising
costs two small batched matrix products whatever the vocabulary. The most frequent symbols have input vectors of their own; other
words are seen by their class as contexts. A word outside the vocabulary has its class's probability times its smoothed
share of the class's training tokens, so the counts behind every score cover the whole corpus.

Training is numpy in tasks and goes over every training text. Texts are dealt by a hash to rounds and, in each round, to shards of about CELL
tokens, as many shards as rounds: all shards of a round go on from the same parameters, and what they learn is averaged, each row by how
often a shard met it. What a text is dealt to depends on its content and id alone, so the model doesn't depend on Spark's partitions.

Counts are kept by the 64-bit XXH64 of a word (two words of a billion share one with probability 0.03, and then share a count).
The HEAD most frequent hashes are broadcast; rarer words are joined with the count table by hash. A rare word has at most
1/HEAD of all tokens, so no key of that join is hot.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, crc_fold, in_arrow, let_go, materialize, slices

#: Suffix classes, vector width, words whose counts are broadcast, training tokens that a word of the vocabulary has at least.
CLASSES, WIDTH, HEAD, LEAST_COUNT = 128, 16, 1 << 17, 10
#: Symbols with an input vector of their own, symbols of a group.
INPUTS, GROUP = 1024, 256
#: Training: tokens of a shard in a round, passes over a corpus below that, most tokens of a step, noise groups and noise symbols of each group, step size.
CELL, MOST_PASSES, BATCH, NOISE_GROUPS, NOISE, RATE = 4_000_000, 4, 16384, 16, 24, 0.1
#: Contexts whose logits are held at once, words a task keeps between batches.
CONTEXTS_AT_ONCE, MOST_WORDS = 8192, 600_000
END = 0
END_HASH = xxhash.xxh64_intdigest(b"", 42) - (1 << 64 if xxhash.xxh64_intdigest(b"", 42) >> 63 else 0)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


def classes(words: list[bytes]) -> np.ndarray:
    """A class in 1..CLASSES from the last two bytes of each word."""
    return np.array([1 + (w[-1] * 31 + (w[-2] if len(w) > 1 else 0) * 17) % CLASSES for w in words], np.int64)


@dataclass
class Tables:
    """What the counts give: broadcast to every task."""

    head: np.ndarray  # sorted hashes of the most frequent words
    counts: np.ndarray  # their counts
    symbol: np.ndarray  # their symbols, 0 where a word has only its class
    tokens: int
    distinct: int
    share: np.ndarray  # log10 of the smoothed size of each symbol's class; 0 for whole words
    prior: np.ndarray  # smoothed probability of each symbol in training
    context: np.ndarray  # each symbol as a context: itself or its class

    @property
    def base(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))


@dataclass
class Noise:
    """The noise distributions: groups by their share, and symbols by their share of the group."""

    log_group: np.ndarray
    log_within: np.ndarray
    group_edge: np.ndarray
    within_edge: np.ndarray  # group number + share of the group up to a symbol

    @classmethod
    def of(cls, prior: np.ndarray) -> Noise:
        group = np.arange(len(prior)) // GROUP
        size = np.bincount(group, prior)
        within = prior / size[group]
        start = np.r_[0, np.cumsum(prior)[:-1]]
        first = start[group * GROUP]
        edge = group + np.minimum((start + prior - first) / size[group], 1)
        return cls(np.log(size / size.sum()).astype(np.float32), np.log(within).astype(np.float32), np.cumsum(size) / size.sum(), edge)


@dataclass
class Model:
    inputs: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    groups: np.ndarray
    group_bias: np.ndarray
    scale: np.ndarray  # weights of the nearer and the farther context

    @classmethod
    def start(cls, prior: np.ndarray, seed: int = 1) -> Model:
        rng, noise = np.random.default_rng(seed), Noise.of(prior)
        small = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
        scale = np.repeat(np.array([[1.0], [0.5]], np.float32), WIDTH, axis=1)
        zero = lambda n: np.zeros((n, WIDTH), np.float32)  # noqa: E731 - so that it starts from the shares of the training tokens
        return cls(small(min(INPUTS, len(prior))), zero(len(prior)), noise.log_within.copy(), zero(len(noise.log_group)), noise.log_group.copy(), scale)

    def copy(self) -> Model:
        return Model(*(getattr(self, f.name).copy() for f in fields(self)))

    def hidden(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return self.inputs[first] * self.scale[0] + self.inputs[second] * self.scale[1]

    def logp(self, first: np.ndarray, second: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural log-probabilities of targets after the contexts (second, first)."""
        n, group = len(self.inputs), target // GROUP
        codes = first.astype(np.int64) * n + second
        keys, slot = np.unique(group.astype(np.int64) * n * n + codes, return_inverse=True)
        own, code = keys // (n * n), keys % (n * n)
        edges = np.searchsorted(own, np.arange(len(self.groups) + 1))
        norm = np.empty(len(keys), np.float64)
        for g in np.flatnonzero(np.diff(edges)).tolist():
            vectors, bias = self.outputs[g * GROUP: (g + 1) * GROUP].T, self.bias[g * GROUP: (g + 1) * GROUP]
            for at in range(edges[g], edges[g + 1], CONTEXTS_AT_ONCE):
                part = code[at: min(at + CONTEXTS_AT_ONCE, edges[g + 1])]
                norm[at: at + len(part)] = _log_sum(self.hidden(part // n, part % n) @ vectors + bias)
        pairs, where = np.unique(code, return_inverse=True)
        order = np.argsort(where, kind="stable")
        edges = np.searchsorted(where[order], np.arange(0, len(pairs) + CONTEXTS_AT_ONCE, CONTEXTS_AT_ONCE))
        for k, at in enumerate(range(0, len(pairs), CONTEXTS_AT_ONCE)):
            part, some = pairs[at: at + CONTEXTS_AT_ONCE], order[edges[k]: edges[k + 1]]
            logits, line = self.hidden(part // n, part % n) @ self.groups.T + self.group_bias, where[some] - at
            chosen = logits[line, own[some]]
            norm[some] += _log_sum(logits)[line] - chosen
        out = np.empty(len(target), np.float64)
        for at in range(0, len(target), 1 << 16):
            t = target[at: at + (1 << 16)]
            h = self.hidden(first[at: at + (1 << 16)], second[at: at + (1 << 16)])
            out[at: at + (1 << 16)] = np.einsum("ij,ij->i", h, self.outputs[t]) + self.bias[t] - norm[slot[at: at + (1 << 16)]]
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1)
    x -= top[:, None]
    np.exp(x, out=x)
    return np.log(x.sum(axis=1)) + top


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """Noise-contrastive steps: groups against groups, symbols against symbols of their group; noise is shared by the tokens of a step."""

    def __init__(self, model: Model, noise: Noise, seed: int, sums: Model | None = None, batch: int = BATCH):
        self.model, self.noise, self.rng, self.batch = model, noise, np.random.default_rng(seed), batch
        ones = lambda a: np.ones(a.shape[:1], np.float32)
        self.sums = Model(*(ones(getattr(model, f.name)) for f in fields(model))) if sums is None else sums
        self.met = Model(*(np.zeros(getattr(model, f.name).shape[:1], np.int64) for f in fields(model)))

    def _move(self, name: str, at: np.ndarray, rows: np.ndarray) -> None:
        """An adagrad step for the rows `at`, which may repeat."""
        into, total = getattr(self.model, name), getattr(self.sums, name)
        order = np.argsort(at, kind="stable")
        keys = at[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        g = np.add.reduceat(rows[order], starts, axis=0)
        keys = keys[starts]
        total[keys] += np.square(g).mean(axis=1) if g.ndim == 2 else np.square(g)
        rate = RATE / np.sqrt(total[keys])
        into[keys] -= g * (rate[:, None] if g.ndim == 2 else rate)
        getattr(self.met, name)[keys] += np.diff(np.r_[starts, len(at)])

    def step(self, first: np.ndarray, second: np.ndarray, target: np.ndarray) -> None:
        m, noise, n = self.model, self.noise, np.float32(1 / np.sqrt(len(target)))
        order = np.argsort(target // GROUP, kind="stable")
        first, second, target = first[order], second[order], target[order]
        group = target // GROUP
        a, b = m.inputs[first], m.inputs[second]
        h = a * m.scale[0] + b * m.scale[1]
        # groups
        drawn = np.minimum(np.searchsorted(noise.group_edge, self.rng.random(NOISE_GROUPS)), len(m.groups) - 1)
        q, qn, log_k = m.groups[group], m.groups[drawn], np.float32(np.log(NOISE_GROUPS))
        real = -_sigmoid(-(np.einsum("ij,ij->i", h, q) + m.group_bias[group] - noise.log_group[group] - log_k))
        fake = _sigmoid(h @ qn.T + m.group_bias[drawn] - noise.log_group[drawn] - log_k)
        dh = real[:, None] * q + fake @ qn
        group_rows, group_at = np.vstack([real[:, None] * h, fake.T @ h]) * n, np.r_[group, drawn]
        group_bias = np.r_[real, fake.sum(axis=0)] * n
        # symbols, each group's against noise of its own
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        ends = np.r_[starts[1:], len(group)]
        mine = group[starts]
        drawn = np.searchsorted(noise.within_edge, mine[:, None] + self.rng.random((len(mine), NOISE)))
        drawn = np.minimum(drawn, np.minimum((mine[:, None] + 1) * GROUP, len(m.bias)) - 1)
        q, log_k = m.outputs[target], np.float32(np.log(NOISE))
        qn, off = m.outputs[drawn], m.bias[drawn] - noise.log_within[drawn] - log_k
        one = -_sigmoid(-(np.einsum("ij,ij->i", h, q) + m.bias[target] - noise.log_within[target] - log_k))
        other = np.empty((len(h), NOISE), np.float32)
        for k, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            other[lo:hi] = h[lo:hi] @ qn[k].T + off[k]
        other = _sigmoid(other).astype(np.float32)
        dh += one[:, None] * q
        back = np.empty(qn.shape, np.float32)
        for k, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            dh[lo:hi] += other[lo:hi] @ qn[k]
            back[k] = other[lo:hi].T @ h[lo:hi]
        rows = np.vstack([one[:, None] * h, back.reshape(-1, WIDTH)]) * n
        at = np.r_[target, drawn.ravel()]
        bias = np.r_[one, np.add.reduceat(other, starts, axis=0).ravel()] * n
        scale = np.stack([(dh * a).sum(axis=0), (dh * b).sum(axis=0)]) * n
        inputs = np.vstack([dh * m.scale[0], dh * m.scale[1]]) * n
        self._move("groups", group_at, group_rows)
        self._move("group_bias", group_at, group_bias)
        self._move("outputs", at, rows)
        self._move("bias", at, bias)
        self._move("inputs", np.r_[first, second], inputs)
        self._move("scale", np.array([0, 1]), scale)

    def run(self, symbols: np.ndarray, context: np.ndarray) -> None:
        first, second = contexts(symbols, context)
        for at in range(0, len(symbols), self.batch):
            part = slice(at, at + self.batch)
            self.step(first[part], second[part], symbols[part])


def contexts(symbols: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places before each, as contexts; END before a text's begin."""
    seen = context[symbols]
    first = np.r_[END, seen[:-1]]
    second = np.where(first == END, END, np.r_[END, END, seen[:-2]][: len(symbols)])
    return first, second


class Reader:
    """Words of a task's texts as symbols, counts and hashes."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.forget()

    def forget(self):
        self.index: dict[bytes, int] = {}
        self.symbol, self.count, self.hash = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def read(self, texts: list[bytes]):
        """(word numbers of all texts, words of each text, symbols of all tokens with text ends)."""
        if len(self.index) > MOST_WORDS:
            self.forget()
        lists = [t.lower().split() for t in texts]
        new = list(set().union(*lists) - self.index.keys())
        if new:
            t = self.tables
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            h = hashes(new)
            at = np.minimum(np.searchsorted(t.head, h), len(t.head) - 1)
            there = t.head[at] == h
            whole = np.where(there, t.symbol[at], 0)
            self.symbol = np.r_[self.symbol, np.where(whole > 0, whole, classes(new))]
            self.count = np.r_[self.count, np.where(there, t.counts[at], -1)]
            self.hash = np.r_[self.hash, h]
        sizes = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter((i for x in lists for i in map(self.index.__getitem__, x)), np.int64, int(sizes.sum()))
        symbols = np.full(len(flat) + len(lists), END, np.int64)
        symbols[np.arange(len(flat)) + np.repeat(np.arange(len(lists)), sizes)] = self.symbol[flat]
        return flat, sizes, symbols


def count_words(docs: DataFrame) -> DataFrame:
    """(h long, cls int, n long): counts of all training tokens, text ends included, by hash of the word."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "t"):
                found: Counter = Counter()
                texts = binary_texts(batch.column("t"))
                for t in texts:
                    found.update(t.lower().split())
                words = list(found)
                h, c, n = np.r_[hashes(words), END_HASH], np.r_[classes(words), 0], np.r_[np.array(list(found.values()), np.int64), len(texts)]
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int32)), pa.array(n.astype(np.int64))], names=["h", "cls", "n"])

    found = in_arrow(docs.select(F.col("text").alias("t")), run, "h long, cls int, n long")
    return found.groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


def tables_of(counts: DataFrame) -> Tables | None:
    """Totals, the broadcast head and the class sizes. None where there's no training text."""
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    if not total.n:
        return None
    head = counts.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    h, n, cls = head.column("h").to_numpy(), head.column("n").to_numpy(), head.column("cls").to_numpy().astype(np.int64)
    least = max(LEAST_COUNT, total.n**0.5 / 30)
    words = np.flatnonzero((h != END_HASH) & (n >= least))
    symbol = np.zeros(len(h), np.int64)
    symbol[words] = np.arange(CLASSES + 1, CLASSES + 1 + len(words))
    by_class = {r.cls: (r.n, r.v) for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    size, kinds, weight = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1), np.zeros(CLASSES + 1 + len(words))
    for c, (a, b) in by_class.items():
        size[c], kinds[c] = a, b
    np.subtract.at(size, cls[words], n[words])
    np.subtract.at(kinds, cls[words], 1)
    weight[: CLASSES + 1] = size
    weight[CLASSES + 1:] = n[words]
    share = np.zeros(len(weight))
    share[1: CLASSES + 1] = np.log10(size[1:] + 0.5 * (kinds[1:] + 1))
    prior = (weight + 0.5) / (weight + 0.5).sum()
    context = np.arange(len(weight))
    context[INPUTS:] = cls[words][INPUTS - CLASSES - 1:]
    order = np.argsort(h)
    return Tables(h[order], n[order], symbol[order], int(total.n), int(total.v), share, prior, context)


def shards_of(docs: DataFrame, sent, cells: int) -> DataFrame:
    """(round, shard, h, s): the symbols of every text, dealt by a hash of its id and content to `cells` x `cells` parts."""

    def symbols(batches):
        let_go()
        reader = Reader(sent.value)
        for whole in batches:
            for batch in slices(whole, "t"):
                _, sizes, flat = reader.read(binary_texts(batch.column("t")))
                bounds = np.r_[0, np.cumsum((sizes + 1) * 4)].astype(np.int64)
                data = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(flat.astype("<i4").tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("h"), data.cast(pa.binary())], names=["h", "s"])

    coded = in_arrow(docs.select(F.xxhash64("doc_id", "text").alias("h"), F.col("text").alias("t")), symbols, "h long, s binary")
    part = lambda n: F.pmod(F.xxhash64("h", F.lit(n)), F.lit(cells)).cast("int")
    coded = coded.select(part(1).alias("round"), part(2).alias("shard"), "h", "s")
    return materialize(coded if cells == 1 else coded.repartition("round", "shard").sortWithinPartitions("round"), "shards")


ROWS = "kind int, i int, met double, total float, v array<float>"


def train(docs: DataFrame, tables: Tables) -> Model:
    """As many rounds as shards, and each shard of a round in a task: the square root of the corpus in cells of CELL tokens.

    A corpus below one cell is gone over up to MOST_PASSES times.
    """
    spark = docs.sparkSession
    cells = int(np.ceil(np.sqrt(tables.tokens / CELL)))
    rounds = cells if cells > 1 else int(np.clip(CELL // tables.tokens, 1, MOST_PASSES))
    batch_tokens = int(np.clip(tables.tokens // 64, 1024, BATCH))
    sent = spark.sparkContext.broadcast(tables)
    parts = shards_of(docs, sent, cells)
    model = Model.start(tables.prior)
    sums = Trainer(model, Noise.of(tables.prior), 0).sums
    names = [f.name for f in fields(Model)]
    for number in range(rounds):
        taught = spark.sparkContext.broadcast((model, sums))

        def run(batches, taught=taught, number=number):
            t, noise, own, shard, held, size = sent.value, Noise.of(sent.value.prior), None, None, [], 0
            let_go()
            for batch in batches:
                for which, data in zip(batch.column("shard").to_pylist(), batch.column("s").to_pylist(), strict=True):
                    if which != shard:
                        if own is not None:
                            yield from learned(own, held, t.context)
                        start, before = taught.value
                        own, shard, held, size = Trainer(start.copy(), noise, number * 1_000_003 + which, before.copy(), batch_tokens), which, [], 0
                    held.append(data)
                    size += len(data)
                    if size >= 16 * BATCH:  # whole steps
                        stream = np.frombuffer(b"".join(held), "<i4").astype(np.int64)
                        own.run(stream, t.context)
                        held, size = [], 0
            if own is not None:
                yield from learned(own, held, t.context)

        def learned(own: Trainer, held: list[bytes], context: np.ndarray):
            if held:
                own.run(np.frombuffer(b"".join(held), "<i4").astype(np.int64), context)
            for kind, name in enumerate(names):
                met = getattr(own.met, name)
                at = np.flatnonzero(met)
                rows = getattr(own.model, name)[at]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int32()), pa.array(met[at].astype(np.float64)), pa.array(getattr(own.sums, name)[at]),
                    pa.array(list(rows.reshape(len(at), -1)), pa.list_(pa.float32())),
                ], names=[x.split()[0] for x in ROWS.split(", ")])

        mine = parts if cells == 1 else parts.filter(F.col("round") == number)
        dealt = mine.repartitionByRange(cells, "shard") if cells > 1 else mine.coalesce(1)
        found = in_arrow(dealt.sortWithinPartitions("shard", "h", "s").select("shard", "s"), run, ROWS)
        v = [F.get("v", F.lit(k)) for k in range(WIDTH)]
        mean = found.groupBy("kind", "i").agg(F.max("total").alias("total"), *[(F.sum(x * F.col("met")) / F.sum("met")).alias(f"v{k}") for k, x in enumerate(v)]).toPandas()
        model, sums = model.copy(), sums.copy()
        for kind, some in mean.groupby("kind"):  # at most a row for each row of the model
            name, at = names[kind], some["i"].to_numpy()
            getattr(sums, name)[at] = some["total"].to_numpy(np.float32)
            into = getattr(model, name)
            values = some[[f"v{k}" for k in range(WIDTH)]].to_numpy(np.float32)
            into[at] = values if into.ndim == 2 else values[:, 0]
    return model


def score(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of `docs`.

    Rows where `held_out` (default: crc32 of the id modulo 5 is 1) is true teach nothing. A null text is empty: its only token is the end.
    Rows with a null id are scored and teach. Repeated rows count each time. Without training text, N and V are zero, base scores have
    c = 0 throughout, and score equals base_score.
    """
    spark = docs.sparkSession
    held = F.coalesce(crc_fold("doc_id", 5) == 1 if held_out is None else held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    learn = rows.filter(~F.col("held_out"))
    counts = materialize(count_words(learn), "counts")
    tables = tables_of(counts)
    if tables is None:
        words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")) + 1
        zero = (words * float(np.log10(0.5 / 0.5))).cast("double")
        return rows.select("doc_id", "held_out", words.cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), zero.alias("base_score"), zero.alias("score"))
    model = train(learn, tables)
    sent, taught = spark.sparkContext.broadcast(tables), spark.sparkContext.broadcast(model)

    def run(batches):
        t, m = sent.value, taught.value
        let_go()
        reader = Reader(t)
        ends = int(t.counts[np.flatnonzero(t.head == END_HASH)[0]]) if (t.head == END_HASH).any() else 0
        end_base = np.log10(ends + 0.5) - t.base
        for whole in batches:
            for batch in slices(whole, "t"):
                flat, sizes, symbols = reader.read(binary_texts(batch.column("t")))
                n = len(sizes)
                first, second = contexts(symbols, t.context)
                full = np.repeat(np.arange(n), sizes + 1)
                logp = m.logp(first, second, symbols) / np.log(10) - t.share[symbols]
                own = np.bincount(full, logp, n)
                owner, count = np.repeat(np.arange(n), sizes), reader.count[flat]
                seen = count >= 0
                log_count = np.where(seen, np.log10(np.maximum(count, 0) + 0.5), 0.0)
                whole_word = reader.symbol[flat] > CLASSES
                own += np.bincount(owner, np.where(whole_word, 0.0, log_count), n)
                base = np.bincount(owner, log_count - t.base, n) + end_base
                known = np.bincount(owner, (count > 0).astype(np.int64), n).astype(np.int64) + (ends > 0)
                far_at, far_hash = owner[~seen], reader.hash[flat[~seen]]
                order = np.lexsort((far_hash, far_at))
                a, h = far_at[order], far_hash[order]
                new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (h[1:] != h[:-1])]) if len(a) else np.empty(0, np.int64)
                times = np.diff(np.r_[new, len(a)])
                bounds = np.searchsorted(a[new], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("rid"), batch.column("k"), batch.column("h"), pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(own),
                    pa.ListArray.from_arrays(pa.array(bounds), pa.array(h[new])), pa.ListArray.from_arrays(pa.array(bounds), pa.array(times.astype(np.int32))),
                ], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "own", "far", "times"])

    columns = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, far array<long>, times array<int>"
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").alias("k"), F.col("held_out").alias("h"), F.col("text").alias("t"))
    part = materialize(in_arrow(numbered, run, columns), "scores")
    rare = part.select("rid", F.explode(F.arrays_zip("far", "times")).alias("x")).select("rid", F.col("x.far").alias("h"), F.col("x.times").alias("times"))
    rare = rare.join(counts.select("h", "n"), "h", "left").select("rid", "times", F.coalesce("n", F.lit(0)).alias("n"))
    sums = rare.groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("logs"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("met"))
    out = part.drop("far", "times").join(sums, "rid", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("met", F.lit(0))).cast("long").alias("n_known"), F.lit(tables.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("own") + logs).alias("score"),
    )
