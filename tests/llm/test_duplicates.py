import itertools
import random

import numpy as np
from pyspark.sql import functions as F
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerproof.llm import components, embeddings, simhash


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i: i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    parent = {i: i for i in ids}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if linked(a, b) and top(a) != top(b):
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    return {i: top(i) for i in ids}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=200), st.integers(0, 5), st.integers(1, 70))
def test_bit_planes(values, radius, run):
    bits = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15) & np.uint64(0x0F0F)
    last = np.array([min(len(bits), (i // run + 1) * run) for i in range(len(bits))])
    i, j = simhash.near_in_words(bits, last, radius)
    want = {(a, b) for a in range(len(bits)) for b in range(a + 1, last[a]) if bin(int(bits[a] ^ bits[b])).count("1") <= radius}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


@pytest.mark.parametrize("most", [2, 4096])
def test_fingerprint_links_are_whole(spark, most):
    """Small keys force the finer levels; chains and groups must come out as by brute force."""
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = set()
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
    fps = {n: v for n, v in enumerate(sorted(values))}
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, n) for n, v in fps.items()], "fp long, rep long")
    links = components.components(simhash.near_fingerprints(rows, 2, most))
    got = {r.node: r.component for r in links.collect()}
    want = brute_components(list(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    assert {n: got.get(n, n) for n in fps} == want


def test_near_duplicate_texts(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(rows)
    prints = {t: brute_fingerprint(t, 3) for _, t in rows}
    least = {}
    for i, t in rows:
        if i is not None:
            least[prints[t]] = min(i, least.get(prints[t], i))
    assert sorted(r.fingerprint for r in got) == sorted(f"{prints[t]:016x}" for _, t in rows)
    for r in got:
        if int(r.fingerprint, 16) in least:
            assert r.component_id <= least[int(r.fingerprint, 16)]
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3} and {r.component_id for r in got if r.doc_id == 2} == {1}
    kept = simhash.kept(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 3, 6, 7, 8, 9]
    assert simhash.near_duplicates(none).count() == 0 and simhash.kept(none).count() == 0


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1200)] + [(5000, 5000 + i) for i in range(300)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "u long, v long").repartition(5)).collect()}
    ids = sorted({x for p in pairs if None not in p and p[0] != p[1] for x in p})
    edges = {tuple(sorted(p)) for p in pairs if None not in p}
    assert got == brute_components(ids, lambda a, b: (a, b) in edges)
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MOST_IN_LIST", 16)  # long lists are dealt in blocks
    rng = np.random.default_rng(8)
    base = rng.normal(size=(300, 32))
    group = base[0] + rng.normal(size=(60, 32)) * 0.12
    x = np.vstack([base, group, base[5] * 3, base[5], base[6] + rng.normal(size=32) * 0.05]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(1000, None, 1), (1001, [0.0] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [None] + [1.0] * 31, 1), (1004, [1.0, 2.0], 1), (1005, [2.0, 4.0], 1), (1006, [], 1), (None, [1.0] * 32, 1)]
    got = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert len(got) == len(rows)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    true = near.sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum()
    assert got[len(x) - 3].n_links >= 2 and got[len(x) - 3].component_id == 5
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1006))
    assert got[1005].n_links == 1 and got[1005].component_id == 1004 and not got[1005].kept and not got[None].kept
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert embeddings.enough(64, 0.9) >= 2


def test_embeddings_of_one_direction(spark):
    """Scaled copies are one node whatever their number, repeated ids stay rows, and columns with names of the operator do no harm."""
    rng = np.random.default_rng(3)
    base, other = rng.normal(size=16), rng.normal(size=16)
    rows = [(i, (base * 2.0 ** (i % 5)).tolist()) for i in range(40)] + [(3, (base * 2).tolist()), (100, other.tolist()), (101, (-other).tolist()), (102, [0.0] * 16), (102, None)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("h1", "h2", "rep", "copies", "a", "n_links")})
    got = embeddings.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert all(r.n_links == 40 and r.component_id == 0 for r in got if r.vec_id < 100)
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id >= 100)


def test_kept_row_of_a_class(spark):
    """The row that stays is one of the class, and the same one in every run."""
    rows = [(1, "a b c d e f g", k) for k in (3, 1, 2)] + [(2, "A b  c d e f g", 0), (0, "something else entirely", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark int")
    runs = {tuple(sorted((r.doc_id, r.mark) for r in simhash.kept(docs.repartition(n)).collect())) for n in (1, 3, 5)}
    assert len(runs) == 1 and {i for i, _ in next(iter(runs))} == {0, 1}
