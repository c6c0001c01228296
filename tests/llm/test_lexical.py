"""Ranked lexical search against a loop over all items and documents."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest

from ledgerproof.llm import lexical, queries
from ledgerproof.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10, once=True):
    docs = [(key, Counter(terms(text))) for key, text in docs if terms(text)]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for key, text in items:
        asked.setdefault(key, Counter()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        scores = []
        for key, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            parts = [(1 if once else times) * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in wanted.items() if t in c]
            if sum(parts) > 0:
                scores.append((-sum(parts), key is None, key))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i + 1, key, -s) for i, (s, _, key) in enumerate(scores[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")


def test_the_query_equals_the_loop_and_its_sql(spark):
    got = queries.op13_lexical_search(spark, SF)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    docs, items = (list(map(tuple, table(spark, SF, name).select(key, "text").collect())) for name, key in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = plain(docs, items)
    assert rows_of(got) == want
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    assert sorted(con.sql(queries.ORACLE_SQL["op13_lexical_search"]).fetchall(), key=repr) == want


@pytest.mark.parametrize("bound", [{}, {"BLOCK_DOCS": 3, "CELLS": 7}, {"BLOCK_TERMS": 8, "BLOCK_DOCS": 5}])
@pytest.mark.parametrize("once", [True, False])
def test_ties_repeats_and_blocks(spark, monkeypatch, bound, once):
    """Few words, so scores tie; repeated and missing ids; blocks of documents, items and cells of any size."""
    for name, value in bound.items():
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(7)
    words = ["Aa", "bb", "ÇÇ", "7", "日本", "x1y", "éa"]
    docs = [(None if i % 19 == 0 else i % 70, " ".join(rng.choices(words, k=rng.randrange(0, 6)))) for i in range(90)] + [(500 - i, "bb aa") for i in range(15)]
    items = [(1, "aa bb"), (2, "bb, bb; ÇÇ"), (2, "7"), (3, None), (4, "nothing here"), (None, "日本 x1y"), (5, "éa éa 7 aa")]
    assert rows_of(lexical.search(*tables(spark, docs, items), once=once)) == plain(docs, items, once=once)


def test_a_term_of_every_document(spark):
    docs = [(i, "the the" if i % 2 else "the cat") for i in range(4)]
    assert rows_of(lexical.search(*tables(spark, docs, [(1, "THE"), (2, "cat")]))) == plain(docs, [(1, "THE"), (2, "cat")])


def test_odd_rows_and_none(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    items = [(1, "quick BROWN fox"), (2, "word 12 日本"), (3, "an id"), (4, "")]
    asked = tables(spark, [], items)[1]
    assert rows_of(lexical.search(odd, asked)) == plain(docs, items)
    assert lexical.search(none, asked).collect() == []
    assert lexical.search(odd, asked.limit(0)).collect() == []
    wide = asked.selectExpr("item_id", "text", "1 as k", "2 as term", "3 as t", "4 as rank", "5 as doc_id")
    assert rows_of(lexical.search(odd, wide)) == plain(docs, items)
