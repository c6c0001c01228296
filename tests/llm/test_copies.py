import random

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerproof.llm import copies

SCHEMA = "doc_id long, text string"


def brute(rows, share=0.8):
    sets = {i: set(copies.shingles((t or "").encode(), 5).tolist()) for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                union = sets[i] | sets[j]
                near = not union or len(sets[i] & sets[j]) >= share * len(union)
                if near and label[j] > label[i]:
                    label[j], changed = label[i], True
    return label


def test_near_copies_by_jaccard(spark):
    """All chains of 5-word Jaccard 0.8 are found, far beyond 2 bits of a fingerprint, and nothing below."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(150)] + passage
        for k in range(6):
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(text)))
    rows += [(900, ""), (901, None), (902, "short text"), (903, "Short  TEXT")]
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 20
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r.component_id for r in copies.classes(docs).collect()}
    assert got == want
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == sorted(set(want.values()))


def test_near_copies_of_odd_rows(spark, odd, none):
    kept = copies.kept(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1, 3, 6, 7, 8, 9]  # both texts of id 1
    assert copies.kept(none).count() == 0
    assert copies.kept(odd.filter(F.col("doc_id").isNull())).count() == 1


def test_texts_that_share_an_id(spark):
    """Each row stands for its own text: a class is named by the least id in it, and one of its own rows is kept."""
    long = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows = [(1, long[0]), (1, long[1]), (2, long[1]), (3, long[2]), (0, long[2] + " more"), (3, long[2])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = sorted((r.doc_id, r.component_id) for r in copies.classes(docs).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 0), (3, 0)]
    assert sorted((r.doc_id, r.text) for r in copies.kept(docs).collect()) == sorted([(0, long[2] + " more"), (1, long[0]), (1, long[1])])


def test_sketches_never_rule_out_a_similar_pair():
    """Two sketches differ in at most as many bits as their sets do in shingles."""
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        both, a, b = (rng.integers(-(2**62), 2**62, n) for n in rng.integers(0, 300, 3))
        x, y = np.unique(np.r_[both, a]), np.unique(np.r_[both, b])
        one, two = sorted((copies.sketch(x), copies.sketch(y)), key=len)
        while len(two) > len(one):
            two = two[: len(two) // 2] ^ two[len(two) // 2:]
        assert np.bitwise_count((one ^ two).view(np.uint64)).sum() <= len(np.setxor1d(x, y))


def test_large_stars_and_all_steps(spark, monkeypatch):
    """Stars in several tasks, with shuffled instead of sent tables, and long texts with sketches of several sizes: equal to brute force."""
    monkeypatch.setattr(copies, "STAR", 3)
    monkeypatch.setattr(copies, "FEW_ROWS", 0)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(4):
        base = [rng.choice(words) for _ in range(rng.choice([40, 260, 700]))]
        for k in range(12):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 70))):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.5:
                text += [rng.choice(words) for _ in range(rng.randint(0, len(text) // 9))]
            rows.append((g * 100 + k, " ".join(text)))
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in copies.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want and 4 < len(set(want.values())) < len(rows)


def test_a_hot_shingle_in_blocks(spark, monkeypatch):
    """Sets that all share a common opening meet in blocks of three; chains across blocks and sketch sizes are found, and no pair of a class is a row."""
    monkeypatch.setattr(copies, "BLOCK", 3)
    monkeypatch.setattr(copies, "DENSE", 2)
    monkeypatch.setattr(copies, "SAMPLED", 0)  # no order: every shared shingle counts
    rng = random.Random(21)
    words = [f"w{i}" for i in range(500)]
    opening = [rng.choice(words) for _ in range(9)]
    rows = []
    for g in range(9):
        base = opening + [rng.choice(words) for _ in range(rng.choice([12, 30, 300]))]
        for k in range(4):
            text = list(base)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(9, len(text))] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(text)))
    want = brute(rows)
    got = {r.doc_id: r.component_id for r in copies.classes(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == want and len(set(want.values())) > 9


def test_the_stage_links_by_fingerprints_too(spark):
    """Texts that SimHash links, though few of their different shingles agree, are near copies to the pipeline; an id that they share with another text links nothing."""
    from ledgerproof.llm.simhash import fingerprint

    cycle = "one two three four five six seven " * 300
    rows = [(k, cycle + " ".join(f"{c}{n}" for n in range(14))) for k, c in ((4, "a"), (5, "b"), (6, "c"))] + [(5, "another text of the same id"), (7, "another text of the same id, with more words in it")]
    a, b = (fingerprint(rows[k][1].encode(), 3) for k in (0, 1))
    assert (a ^ b).bit_count() <= 2 and brute(rows[:2]) == {4: 4, 5: 5}
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(tuple(r) for r in corpus_pipeline.near_copies(spark, docs, "").collect()) == sorted([rows[0], rows[3], rows[4]])
