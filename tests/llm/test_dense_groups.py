"""Groups of many different near vectors: rows in proportion to the vectors, links as brute force has them."""

import numpy as np

from ledgerproof.llm import embeddings


def test_dense_groups_make_no_row_for_each_pair(spark):
    rng = np.random.default_rng(12)
    x = (rng.normal(size=(3, 1, 64)) + rng.normal(size=(3, 500, 64)) * 0.1).reshape(-1, 64)  # 374,250 near pairs
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reps = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "rep long, copies long, embedding array<double>")
    found = embeddings._met(reps, 0.9)
    assert found.count() < 60 * len(x)
    docs = reps.selectExpr("rep as vec_id", "embedding")
    got = {r.vec_id: r for r in embeddings.near_duplicates(docs).collect()}
    true = (x @ x.T >= 0.9).sum(axis=1) - 1
    links = np.array([got[i].n_links for i in range(len(x))])
    assert (links <= true).all() and links.sum() >= 0.999 * true.sum()
    assert {got[i].component_id for i in range(len(x))} == {0, 500, 1000}


def test_pairs_keep_their_cosine(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 48))
    x = np.vstack([x, x + rng.normal(size=x.shape) * np.linspace(0.05, 0.7, 40)[:, None]])
    reps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rep long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.a, r.b): r.cosine for r in embeddings.near_pairs(reps).collect()}
    cosine = x @ x.T
    true = {(i, j) for i in range(80) for j in range(i + 1, 80) if cosine[i, j] >= 0.9}
    assert set(got) <= true and len(got) >= 0.9 * len(true)
    assert all(abs(cosine[k] - c) < 1e-12 for k, c in got.items())
