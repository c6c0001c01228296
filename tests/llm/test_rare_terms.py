import numpy as np

from ledgerproof.llm import toxicity


def test_many_rare_insults():
    """Each insult stands in 1 % of the toxic rows at most, and in no other row."""
    rng = np.random.default_rng(2)

    def make(n):
        y = np.arange(n) % 2
        return [np.unique(np.r_[rng.integers(1000, 1400, 12), [rng.integers(0, 120)] * int(t)]).astype(np.int64) for t in y], y

    machine = toxicity.fit(*make(3000))
    test, y = make(600)
    at = [np.searchsorted(machine.chosen, r[np.isin(r, machine.chosen)]) for r in test]
    assert np.mean((machine.raw(at) > 0) == y) > 0.95


def test_pairs_without_marginal_effect():
    """Two terms are toxic together or harmless together, each equally common in both classes."""
    rng = np.random.default_rng(3)

    def make(n):
        rows, y = [], []
        for _ in range(n):
            one, two = rng.random(2) < 0.5
            rows.append(np.unique(np.r_[rng.integers(100, 400, 8), 1 if one else 2, 3 if two else 4]).astype(np.int64))
            y.append(int(one == two))
        return rows, np.array(y)

    machine = toxicity.fit(*make(2000))
    test, y = make(400)
    at = [np.searchsorted(machine.chosen, r[np.isin(r, machine.chosen)]) for r in test]
    assert np.mean((machine.raw(at) > 0) == y) > 0.95
