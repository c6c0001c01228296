"""Spelling variants against every pair of words, by definition."""

import random
import re
import zlib
from collections import Counter

import pytest

from ledgerproof.llm import queries, spellings
from ledgerproof.llm.common import table


def plain_counts(rows):
    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            found[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}




def plain_near(words):
    """Words within one edit: by deletions of one code point on either side, checked by definition."""
    by_key = {}
    for w in words:
        for i in range(len(w)):
            by_key.setdefault((i, w[:i] + w[i + 1:]), set()).add(w)  # replaced at i
    near = {w: set() for w in words}
    for group in by_key.values():
        for w in group:
            near[w] |= group - {w}
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1:]
            if less in near:
                near[w].add(less)
                near[less].add(w)
    return near


def plain(rows):
    words = plain_counts(rows)
    near, form = plain_near(words), {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_the_query_equals_all_pairs(spark):
    got = queries.op12_spelling_variants(spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    rows = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()
    assert rows_of(got) == plain(rows)


@pytest.mark.parametrize("held", [3, 2000])
def test_chains_ties_and_hot_halves(spark, monkeypatch, held):
    """Short words over few letters: every half is shared, many pairs match by both halves, forms chain."""
    monkeypatch.setattr(spellings, "HALF_WORDS", held)
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("aabÀ") for _ in range(rng.choice([5, 5, 6, 7, 9]))) for _ in range(80))) for i in range(60)]
    for word, n in (("chaine", 3), ("chained", 6), ("chainer", 12), ("chainers", 24), ("chainerÿ", 24)):
        rows += [(1000 + i, word) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert len({r[2] for r in want if r[1]}) > 3 and any(r[1] != r[2] for r in want if r[1])
    assert rows_of(spellings.variants(docs)) == want


def test_the_table_of_a_task_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(spellings, "MOST_WORDS", 3)
    rows = [(i, "alpha beta gamma delta epsilon zeta theta kappa " * 3) for i in range(20)]
    got = spellings.counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.word: r.n for r in got} == plain_counts(rows)


def test_runs_of_letters():
    text = "Übung×Maß÷É é_Zed3x Ābcıd naïve’s ÀÉ"
    want = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]
    assert [w.decode("latin-1") for w in spellings.runs(text)] == want


def test_odd_rows_and_none(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows_of(spellings.variants(odd)) == plain(rows)
    assert spellings.variants(none).collect() == []
