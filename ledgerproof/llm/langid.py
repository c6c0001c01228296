"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of its byte n-grams (letters in lower case, all else one blank,
so that n-grams see where words begin and end). Embeddings and softmax are trained together by stochastic gradient descent in
numpy on a bounded sample of labelled rows, in one task; a held-back part of the sample gives the temperature of the softmax and what is
rejected. A text of an unlearned language may lean to one label, and one of several learned languages to none, so two limits are calibrated: the
confidence (over held-back texts and mixtures of them) and how usual the n-grams are in the training sample, whatever the label.
As both layers are linear, scoring adds up one row of class scores per n-gram: with few languages the table (embeddings @ weights) has a column
for each, and with more than WIDTH it stays the embeddings, whose mean is then multiplied by the weights; one more column holds log frequencies. So
what is broadcast has BUCKETS x (WIDTH + 1) numbers at most, and WIDTH for each language.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, in_arrow, in_one_task, let_go, slices, where_text
from .hashing import byte_grams

#: n-gram lengths in bytes, hash buckets and embedding width.
SIZES, BUCKETS, WIDTH = (2, 3, 4, 5), 1 << 16, 16
#: Rows a language may give to the training sample, rows of all languages, and characters of a window of a sampled text; windows cover
#: long texts at a fixed stride. Fitting alone is bounded: predictions read whole texts.
MOST_ROWS, ALL_ROWS, WINDOW, WINDOWS = 800, 40_000, 1200, 3
#: Distinct labels that can be languages; a column with more is refused.
MOST_LABELS = 10_000
#: Places of a text whose n-grams are looked up at once.
PLACES = 1 << 17
EPOCHS, LEAST_STEPS, RATE, BATCH = 3, 600, 20.0, 64
#: Share of right held-back predictions that calibration may reject by each limit.
REJECTED = 0.001
#: Bytes of the pieces of held-back texts that tell how short texts vary.
PIECES = (40, 160)
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def plain(text: str) -> bytes:
    """Letters in lower case, each run of anything else as one blank, with blanks around."""
    return f" {OTHER.sub(' ', text).lower().strip()} ".encode()


def grams(data: bytes) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8)
    return np.concatenate([byte_grams(flat, n, BUCKETS) for n in SIZES])


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # buckets x (labels or embedding, and the log frequency)
    weights: np.ndarray | None = None  # embedding x labels, where the table holds embeddings
    temperature: float = 1.0
    limit: float = 0.0
    usual: float = 0.0  # mean log frequency of the n-grams of learned texts
    spread: tuple[float, float] = (1.0, 0.0)  # its variance: a part of each text's own, and one by n-gram
    least_usual: float = -np.inf  # deviations below which a text is rejected

    def means(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Mean scores of each text's n-grams (the log frequency in the last column) and their number, all texts of a batch together."""
        flat = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        starts = np.r_[0, ends[:-1]]
        total, count = np.zeros((len(texts), self.scores.shape[1])), np.zeros(len(texts))
        for n in SIZES:
            stops = np.maximum(starts, ends - n + 1)  # n-grams that end within the text
            count += stops - starts
            for at in range(0, max(0, len(flat) - n + 1), PLACES):  # also within a text: memory doesn't grow with it
                rows = self.scores[byte_grams(flat[at: at + PLACES + n - 1], n, BUCKETS)].astype(np.float64)
                sums = np.vstack([np.zeros((1, rows.shape[1])), np.cumsum(rows, axis=0)])
                total += sums[np.clip(stops - at, 0, len(rows))] - sums[np.clip(starts - at, 0, len(rows))]
        means = total / np.maximum(count, 1)[:, None]
        if self.weights is not None:
            means = np.c_[means[:, :-1] @ self.weights, means[:, -1]]
        return means, np.maximum(count, 1)

    def deviations(self, usual: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (usual - self.usual) / np.sqrt(self.spread[0] + self.spread[1] / count)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[bool]]:
        """(label, probability of it, less for unusual n-grams, rejected) of each whole text: und with 0, rejected, where it has no letter."""
        known = [bool(t and LETTER.search(t)) for t in texts]
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), [True] * len(texts)
        means, count = self.means([plain(t) if k else b"  " for t, k in zip(texts, known, strict=True)])
        p = softmax(means[:, :-1] / self.temperature)
        best = p.argmax(axis=1)
        beyond = np.minimum(0, self.deviations(means[:, -1], count) - self.least_usual)  # below 0: too unusual, and the score is discounted
        score = np.where(known, p[np.arange(len(p)), best] * np.exp(beyond), 0.0)
        rejected = ~np.array(known, bool) | (score < self.limit) | (beyond < 0)
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], score, rejected.tolist()

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(label, probability of it) of each whole text: und with 0 where it has no letter."""
        return self.decide(texts)[:2]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def fit(texts: list[str], labels: list[str], seed: int = 1) -> Model:
    """Train on labelled texts. Every fifth one is held back for the temperature and the rejection limit."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((BUCKETS, 1), np.float32))
    x, y, back = [], [], []
    for n, (text, label) in enumerate(zip(texts, labels, strict=True)):
        step = max(WINDOW, len(text) // WINDOWS)
        for at in range(0, max(1, len(text)), step):
            if LETTER.search(part := text[at: at + WINDOW]):
                x.append(plain(part))
                y.append(names.index(label))
                back.append(n % 5 == 4)
    y, back = np.array(y, np.int64), np.array(back, bool)
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (BUCKETS, WIDTH)).astype(np.float32) / WIDTH
    w = np.zeros((WIDTH, len(names)), np.float32)
    train = np.flatnonzero(~back) if (~back).any() else np.arange(len(y))
    found = []  # small types: the sample's n-grams stay on the driver while it trains
    for t in x:
        ids, counts = np.unique(grams(t), return_counts=True)
        found.append((ids.astype(np.int32), (counts / counts.sum()).astype(np.float16)))
    weight = len(train) / (len(names) * np.maximum(1, np.bincount(y[train], minlength=len(names))))
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(train) // BATCH)))  # small samples are gone over more often
    steps, step = epochs * -(-len(train) // BATCH), 0
    seen = np.zeros(BUCKETS, bool)
    for _ in range(epochs):
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            part = order[at: at + BATCH]
            ids = np.concatenate([found[i][0] for i in part])
            counts = np.concatenate([found[i][1] for i in part]).astype(np.float32)
            starts = np.r_[0, np.cumsum([len(found[i][0]) for i in part])[:-1]]
            h = np.add.reduceat(e[ids] * counts[:, None], starts, axis=0)
            g = softmax((h @ w).astype(np.float64)).astype(np.float32)
            g[np.arange(len(part)), y[part]] -= 1
            g *= weight[y[part], None].astype(np.float32) / len(part)
            rate = RATE * (1 - step / steps)
            back_h = np.repeat(g @ w.T, np.diff(np.r_[starts, len(ids)]), axis=0) * counts[:, None]
            w -= rate * (h.T @ g)
            touched, slot = np.unique(ids, return_inverse=True)
            for k in range(WIDTH):
                e[touched, k] -= rate * np.bincount(slot, back_h[:, k])
            seen[touched] = True
            step += 1
    e[~seen] = 0  # n-grams never met say nothing
    times = np.ones(BUCKETS)
    for i in train:
        times += np.bincount(found[i][0], found[i][1].astype(np.float64) * len(x[i]) * weight[y[i]], BUCKETS)  # each language counts alike
    folded = len(names) <= WIDTH
    model = Model(names, np.c_[e @ w if folded else e, np.log(times / times.mean())].astype(np.float32), None if folded else w.astype(np.float64))
    check = np.flatnonzero(back) if back.any() else train
    if len(check):
        calibrate(model, [x[i] for i in check], y[check], rng)
    return model


def calibrate(model: Model, texts: list[bytes], y: np.ndarray, rng: np.random.Generator) -> None:
    """Temperature and limits from held-back texts, mixtures of the learned languages, and pieces of both."""

    def means(some):
        got = [model.means(some[at: at + 200]) for at in range(0, len(some), 200)]
        return np.vstack([m for m, _ in got]), np.concatenate([c for _, c in got])

    whole, count = means(texts)
    logits = whole[:, :-1]
    losses = {t: -np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.5, 5, 30)}
    model.temperature = float(min(losses, key=losses.get))
    mixed = []
    present = np.unique(y)
    for n in range(2, len(present) + 1):
        for _ in range(max(1, len(texts) // (len(present) - 1))):
            chosen = [texts[rng.choice(np.flatnonzero(y == c))] for c in rng.choice(present, n, replace=False)]
            mixed.append(b" ".join(t.strip() for t in chosen))
    p = softmax(logits / model.temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == y]
    if len(model.labels) > 1:
        if mixed:
            blended, _ = means(mixed)
            right = np.r_[right, softmax(blended[:, :-1] / model.temperature).max(axis=1)]
        model.limit = float(np.quantile(right, REJECTED)) if len(right) else 0.0
    model.usual = float(whole[:, -1].mean())
    own = max(float(whole[:, -1].var()), 1e-4)
    pieces = [t[at: at + size] for t in texts for size in PIECES for at in range(0, max(1, len(t) - size + 1), max(size, len(t) // 2))]
    short, few = means(pieces)
    each = max(0.0, float((((short[:, -1] - model.usual) ** 2 - own) * few).mean()))
    model.spread = (own, each)
    every, n = np.r_[whole[:, -1], short[:, -1]], np.r_[count, few]
    model.least_usual = float(np.quantile(model.deviations(every, n), REJECTED)) - 1.0  # a standard deviation beyond: few texts give the quantile


def sample(docs: DataFrame, most: int = MOST_ROWS) -> tuple[DataFrame, int]:
    """(lang, h, text, place) of labelled rows outside the held-out fold, at most `most` different texts for each lang (fewer with many langs: ALL_ROWS in all), and that number.

    Texts are counted by lang (approximately, so hashes aren't shuffled); then rows whose hash of id and text lies below a threshold are
    taken, which needs no sort, and equal texts count once. So neither a repeated id nor a repeated text makes the sample
    larger or empty. Rows without an id are in no held-out fold and teach. Of a long text there are windows: WINDOWS x WINDOW characters at most.
    """
    held = F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False))
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held).select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n")).limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"lang has more than {MOST_LABELS} values: these are no languages")
    most = max(1, min(most, ALL_ROWS // max(1, len(counts))))
    shares = [(r.lang, min(1 << 30, int((1 << 30) * 0.85 * most / r.n)) if r.n > most else 1 << 30) for r in counts]
    limits = docs.sparkSession.createDataFrame(shares, "lang string, upto long")  # at most MOST_LABELS rows
    rows = rows.withColumn("lang", F.col("lang").cast("string")).withColumn("place", F.pmod(F.xxhash64("h", F.lit("sample")), F.lit(1 << 30)))
    n = F.char_length("text")
    step = F.greatest(F.lit(WINDOW), F.floor(n / WINDOWS)).cast("int")
    windows = F.concat_ws(" ", *[F.substr("text", (step * k + 1).cast("int"), F.lit(WINDOW)) for k in range(WINDOWS)])
    short = F.when(n <= WINDOW * WINDOWS, F.col("text")).otherwise(windows)
    some = rows.join(F.broadcast(limits), "lang").filter("place < upto").groupBy("lang", "h").agg(F.first(short).alias("text"), F.first("place").alias("place"))
    return some.orderBy("place", "h", "lang").limit(2 * ALL_ROWS), most


def learn(docs: DataFrame) -> Model:
    """Fit on the sample, in a task."""
    rows, most = sample(docs)

    def make(batches: list[pa.RecordBatch]) -> Model:
        if not batches:
            return fit([], [])
        got = pa.Table.from_batches(batches).to_pandas().sort_values(["place", "h", "lang"], kind="stable")
        got = got.groupby("lang", sort=False).head(most)
        return fit(got["text"].tolist(), got["lang"].tolist())

    return in_one_task(rows, make)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of `docs` (text and doc_id are read, lang only to learn).

    lang_pred is a learned label, or und (score 0, rejected) for texts that are null or have no letter. rejected also marks scores
    below the model's calibrated limit, and texts whose n-grams are too unusual in the learned languages. Repeated rows are scored alike; without any labelled row all are und.
    """
    spark = docs.sparkSession
    model = learn(docs) if model is None else model
    sent = spark.sparkContext.broadcast(model)  # of a fixed size, see above

    def run(batches):
        let_go()
        own = sent.value
        for whole in batches:
            for batch in slices(whole, "t", 1 << 19):
                label, score, rejected = own.decide(batch.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("h"), pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.coalesce(crc_fold("doc_id", 3) == 1, F.lit(False)).alias("h"), F.col("text").alias("t"))
    return in_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def kept(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of `docs` that aren't rejected, with all their columns, whatever their names. Decided row by row in one scan."""
    model = learn(docs) if model is None else model
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return where_text(docs, lambda texts: [not x for x in sent.value.decide(texts)[2]])
