"""Suggestions at scale against the search through all names."""

import random

import pytest

from ledgerproof.operators import names
from ledgerproof.plans.graph import closest, levenshtein


def edited(rng, word, letters, n):
    word = list(word)
    for _ in range(n):
        at = rng.randrange(len(word) + 1)
        how = rng.randrange(3)
        if how == 0:
            word.insert(at, rng.choice(letters))
        elif word and how == 1:
            del word[min(at, len(word) - 1)]
        elif word:
            word[min(at, len(word) - 1)] = rng.choice(letters)
    return "".join(word)


@pytest.mark.parametrize("most", [1, 2])
@pytest.mark.parametrize("short", [4, 40])
def test_equal_to_all_pairs(spark, monkeypatch, most, short):
    """Names of all lengths around the limit, with many ties; nulls, repeats and empty names."""
    monkeypatch.setattr(names, "SHORT", short)
    rng = random.Random(most)
    known = {"".join(rng.choice("abé") for _ in range(rng.randrange(0, 9))) for _ in range(60)} | {"".join(rng.choice("abcdefgh") for _ in range(rng.choice([12, 39, 41, 42, 60]))) for _ in range(40)}
    asked = [edited(rng, rng.choice(sorted(known)), "abcé", rng.randrange(0, 4)) for _ in range(150)]
    frame = lambda rows: spark.createDataFrame([(r, 1) for r in rows], "name string, q int").repartition(3)
    got = {r.name: (r.nearest, r.distance) for r in names.suggestions(frame([*asked, asked[0], None]), frame([*known, None]), most).collect()}
    want = {a: closest(a, known, most) for a in asked}
    assert got == {a: (w, None if w is None else levenshtein(a, w)) for a, w in want.items()}
    assert sum(w is not None for w in want.values()) > 60 and None in want.values()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "name string")
    some = spark.createDataFrame([("ab",)], "name string")
    assert names.suggestions(none, some).collect() == []
    assert [tuple(r) for r in names.suggestions(some, none).collect()] == [("ab", None, None)]
