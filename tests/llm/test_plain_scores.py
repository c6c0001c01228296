"""The learned operators against plain versions of their scores, and samples of awkward labelled rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerproof.llm import langid, toxicity
from ledgerproof.llm.hashing import byte_grams


def words(rng, lang, n=30):
    known = {"aa": "the thing over water stone with light".split(), "bb": "der auch nicht schön über wasser licht".split()}[lang]
    return " ".join(rng.choice(known) + rng.choice(["", "er", "ing", "en"]) for _ in range(n))


def test_language_scores_equal_loops(monkeypatch):
    """Means, softmax, discount and limits by loops over n-grams, also where a text is read in pieces and where the table holds embeddings."""
    rng = random.Random(2)
    labels = ["aa" if i % 2 else "bb" for i in range(200)]
    model = langid.fit([words(rng, x) for x in labels], labels)
    texts = ["", None, "12 3", words(rng, "aa"), words(rng, "bb", 400), "x", "日本語 text", words(rng, "aa", 3) + words(rng, "bb", 3)]

    def plain(text):
        if not text or not langid.LETTER.search(text):
            return "und", 0.0, True
        data = langid.plain(text)
        rows = [model.scores[g].astype(np.float64) for n in langid.SIZES for g in byte_grams(np.frombuffer(data, np.uint8), n, langid.BUCKETS)]
        mean = sum(rows) / max(len(rows), 1)
        logits = mean[:-1] if model.weights is None else mean[:-1] @ model.weights
        e = [math.exp(x / model.temperature) for x in logits]
        best = max(range(len(e)), key=e.__getitem__)
        away = (mean[-1] - model.usual) / math.sqrt(model.spread[0] + model.spread[1] / max(len(rows), 1))
        beyond = min(0.0, away - model.least_usual)
        score = e[best] / sum(e) * math.exp(beyond)
        return model.labels[best], score, score < model.limit or beyond < 0

    for pieces in (1 << 17, 7):
        monkeypatch.setattr(langid, "PLACES", pieces)
        for text, label, score, rejected in zip(texts, *model.decide(texts), strict=True):
            want = plain(text)
            assert label == want[0] and abs(score - want[1]) < 1e-6 and rejected == want[2], text
    many = sorted({"".join(chr(97 + (i * 7 + j * j * 5) % 26) for j in range(4)) for i in range(20)})
    wide = langid.fit([f"{x} {x}qu {x}zy" for x in many for _ in range(6)], [x for x in many for _ in range(6)])
    assert wide.weights is not None and wide.scores.shape[1] == langid.WIDTH + 1
    model = wide
    two = [f"{many[3]} {many[3]}qu", f"{many[19]}zy {many[19]}"]
    for text, label, score, _ in zip(two, *wide.decide(two), strict=True):
        assert label == plain(text)[0] and abs(score - plain(text)[1]) < 1e-6
    assert wide.decide(two)[0] == [many[3], many[19]]


def test_toxicity_scores_equal_loops():
    """Bias, linear weights and every pair's product by loops over a text's terms."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["good", "bad", "group", "idiotic", "fine", "day", "night"], 8)) for _ in range(400)]
    machine = toxicity.fit([toxicity.buckets_of(t) for t in texts], np.array([int("idiotic" in t and "group" in t) for t in texts]))
    assert len(machine.chosen) > 0
    at = {int(b): k for k, b in enumerate(machine.chosen)}
    for text, got in zip([*texts[:20], "", "unknown words"], machine.score([*texts[:20], "", "unknown words"]), strict=True):
        mine = sorted(at[int(b)] for b in toxicity.buckets_of(text) if int(b) in at)
        raw = machine.bias + sum(machine.linear[i] for i in mine) + sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(mine) for j in mine[n + 1:])
        assert abs(got - 1 / (1 + math.exp(-raw))) < 1e-9


def test_languages_of_repeated_and_missing_ids(spark):
    """Thousands of rows of one id, equal texts and rows without an id neither swell the sample nor make it empty."""
    rng = random.Random(3)
    rows = [(7, words(rng, "aa"), "aa") for _ in range(3000)] + [(None, words(rng, "bb"), "bb") for _ in range(50)] + [(9, "einer und immer derselbe text", "cc")] * 2000 + [(None, "long " * 30_000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"h": F.lit(1), "place": F.lit(2), "n": F.lit(3), "upto": F.lit(4)})
    sample, most = langid.sample(docs)
    counts = {r.lang: r.n for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert most == langid.MOST_ROWS and set(counts) == {"aa", "bb", "cc"} and 400 < counts["aa"] <= 1000 and counts["bb"] == 50 and counts["cc"] == 1
    assert langid.learn(docs).labels == ["aa", "bb", "cc"]
    got = langid.identify(docs.limit(5), langid.learn(docs)).collect()
    assert len(got) == 5


def test_toxicity_of_repeated_ids_and_long_texts(spark, monkeypatch):
    """Of an id that repeats one row teaches, and with many terms fewer ids do."""
    rng = random.Random(4)
    rows = [(1, words(rng, "aa")) for _ in range(500)] + [(i, words(rng, "aa") + (" idiotic" if i % 2 else "")) for i in range(2, 300)] + [(2, "w " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit(9), "place": F.lit(9), "terms": F.lit(9), "h": F.lit(9)})
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 300)] + [(None, 1), (5, 0)], "doc_id long, toxic int")
    sample, counts = toxicity.sample(docs, labels)
    ids = [r.doc_id for r in sample.collect()]
    assert len(ids) == len(set(ids)) and 150 < len(ids) < 300 and sum(counts.values()) == len(ids)
    monkeypatch.setattr(toxicity, "MOST_TERMS", 1000)
    few, _ = toxicity.sample(docs, labels)
    assert 0 < few.count() < len(ids) and few.agg(F.sum(F.size("terms"))).first()[0] <= 1000
