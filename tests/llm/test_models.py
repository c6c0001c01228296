import math
import zlib
from collections import Counter

import numpy as np

from ledgerproof.llm import langid, lm, toxicity


def test_language(spark, clean, odd, none):
    got = {r.doc_id: r for r in langid.identify(clean).collect()}
    rows = clean.collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert not any(r.rejected for r in got.values())
    model = langid.learn(clean)
    label, score = model.predict(["", None, "12 3", "the thing over water", "日本語のテキスト"])
    assert label[:4] == ["und", "und", "und", "aa"] and score[0] == 0 and score[4] < model.limit < score[3]
    some = langid.identify(odd).collect()
    assert len(some) == odd.count() and all((r.lang_pred == "und") == (r.doc_id in (3, 4, 5, 6)) for r in some)
    assert langid.kept(odd, model).columns == odd.columns and langid.kept(odd, model).filter("doc_id in (3, 4, 5, 6)").count() == 0
    assert langid.identify(none).count() == 0
    unlabelled = clean.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_toxicity(spark, clean, odd, none):
    labels = clean.select("doc_id", "toxic")
    got = {r.doc_id: r for r in toxicity.score(clean.drop("toxic"), labels).collect()}
    rows = clean.collect()
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.toxic for r in held]) > 0.95
    machine = toxicity.learn(clean.drop("toxic"), labels)
    again = toxicity.score(odd, machine=machine).collect()
    assert len(again) == odd.count() and all(0 <= r.score < 0.5 and r.predicted == 0 for r in again)
    assert toxicity.kept(odd, machine=machine).count() == odd.count() and toxicity.kept(odd, machine=machine).columns == odd.columns
    assert toxicity.score(none, labels).count() == 0
    assert {r.predicted for r in toxicity.score(odd, labels.filter("false")).collect()} == {0}


def test_pairs_beat_linear_weights():
    """An insult and a group are harmless alone and toxic together, which no sum of weights says."""
    rng = np.random.default_rng(1)
    rows, y = [], []
    for _ in range(1200):
        insult, group = rng.random(2) < 0.4
        rows.append(np.unique(np.r_[rng.integers(100, 400, 12), [1] * int(insult), [2] * int(group)]).astype(np.int64))
        y.append(int(insult and group))
    machine = toxicity.fit(rows[:1000], np.array(y[:1000]))
    test = [np.searchsorted(machine.chosen, r[np.isin(r, machine.chosen)]) for r in rows[1000:]]
    assert np.mean((machine.raw(test) > 0) == np.array(y[1000:])) > 0.98
    assert machine.factors[np.searchsorted(machine.chosen, 1)] @ machine.factors[np.searchsorted(machine.chosen, 2)] > 0


def test_language_model(spark, clean, odd, none):
    got = {r.doc_id: r for r in lm.score(clean).collect()}
    tokens = {r.doc_id: [*r.text.encode().lower().split(), b""] for r in clean.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    counts = Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert abs(got[i].base_score - base) < 1e-6 and got[i].n_tokens == len(t) and got[i].n_known == sum(counts[w] > 0 for w in t)
        assert got[i].held_out == held[i] and got[i].train_tokens == n
    apart = [i for i in tokens if held[i]]
    assert sum(got[i].score for i in apart) > sum(got[i].base_score for i in apart)
    some = lm.score(odd).collect()
    assert len(some) == odd.count() and all(r.score < 0 and math.isfinite(r.score) for r in some)
    assert {r.n_tokens for r in some if r.doc_id in (3, 4, 5)} == {1}
    assert lm.score(none).count() == 0


def test_probabilities_are_normalised():
    prior = np.full(40, 1 / 40)
    model = lm.Model.start(prior)
    trainer = lm.Trainer(model, lm.Noise.of(prior), 1)
    for _ in range(60):
        trainer.run(np.tile(np.array([0, 5, 6, 7]), 3000), np.arange(40))
    every = np.arange(40)
    p = np.exp(model.logp(np.full(40, 5), np.full(40, 0), every))
    assert abs(p.sum() - 1) < 1e-4 and p.argmax() == 6 and p[6] > 0.8


def test_groups_are_normalised(monkeypatch):
    """Probabilities over several groups add up to one, equal plain sums, and follow what was taught."""
    monkeypatch.setattr(lm, "CONTEXTS_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    n = 3 * lm.GROUP + 17
    prior = 1 / np.arange(1, n + 1)
    prior /= prior.sum()
    model = lm.Model.start(prior)
    trainer = lm.Trainer(model, lm.Noise.of(prior), 1)
    context = np.where(np.arange(n) < len(model.inputs), np.arange(n), 1)
    for _ in range(30):
        trainer.run(np.tile(np.array([0, 5, 600, 7, 300]), 2000), context)
    contexts = [(0, 5), (5, 600), (600, 7), (3, 4)]
    first, second = (np.repeat([c[k] for c in contexts], n) for k in (1, 0))
    p = np.exp(model.logp(first, second, np.tile(np.arange(n), 4))).reshape(4, n)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4) and p[0].argmax() == 600 and p[0, 600] > 0.5
    h = model.hidden(np.array([5]), np.array([0]))[0].astype(np.float64)
    groups = np.exp(model.groups @ h + model.group_bias)
    for g in range(4):
        own = np.exp(model.outputs[g * lm.GROUP: (g + 1) * lm.GROUP] @ h + model.bias[g * lm.GROUP: (g + 1) * lm.GROUP])
        assert np.allclose(p[0, g * lm.GROUP: (g + 1) * lm.GROUP], own / own.sum() * groups[g] / groups.sum(), rtol=1e-3, atol=1e-9)
    some = rng.integers(0, n, 500)
    assert np.allclose(model.logp(np.full(500, 5), np.zeros(500, np.int64), some), np.log(p[0][some]), atol=1e-4)


def test_scores_do_not_depend_on_partitions(spark, clean, monkeypatch):
    """Rounds and shards are dealt by content: equal scores for one partition and eight, and for one shard and several rounds."""
    monkeypatch.setattr(lm, "CELL", 1500)
    one, eight = ({r.doc_id: r.score for r in lm.score(clean.repartition(n)).collect()} for n in (1, 8))
    assert all(abs(one[i] - eight[i]) < 1e-6 * abs(one[i]) for i in one)


def test_rare_words_are_joined(spark, clean, monkeypatch):
    whole = {r.doc_id: r.base_score for r in lm.score(clean).collect()}
    monkeypatch.setattr(lm, "HEAD", 8)
    part = {r.doc_id: r.base_score for r in lm.score(clean).collect()}
    assert all(abs(whole[i] - part[i]) < 1e-6 for i in whole)
