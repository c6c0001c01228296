"""Byte-level merges against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import PATTERN, path

from ledgerproof.llm import bytepairs, queries
from ledgerproof.llm.common import table

FILE = path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def own():
    return bytepairs.RankEncoder(FILE, PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(own, text):
    coded = own.encode([text])
    assert bytes(own.decode(coded)[0]) == text.encode()
    return np.frombuffer(coded[0], "<u4").tolist()


def expected(library, rows):
    out = []
    for key, text in rows:
        x = library.encode_ordinary(text or "")
        out.append((key, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    return out


@settings(max_examples=300, deadline=None)
@given(text=st.text(st.sampled_from("abdehnorst ABé'12\n\t 日本語😀ß-_."), max_size=80))
def test_texts_of_any_kind(own, library, text):
    assert ids(own, text) == library.encode_ordinary(text)


def test_long_pretokens(own, library):
    rng = random.Random(5)
    for text in ("a" * 30_000, "".join(rng.choice("aehinorst") for _ in range(20_000)), " " * 9000 + "x", "語" * 9000, "<|endoftext|>" * 3):
        assert ids(own, text) == library.encode_ordinary(text)
    long = "".join(rng.choice("abcdefghij") for _ in range(2_000_000))  # past LISTED: the links are arrays
    assert bytes(own.decode(own.encode([long]))[0]) == long.encode()


def test_lists_and_arrays_agree(own, monkeypatch):
    words = [w.encode() for w in "unbelievable reinterpretations ononononon éclairs zzzzzzz".split()]
    some = own.merge(words)
    monkeypatch.setattr(bytepairs, "LISTED", 0)
    assert own.merge(words) == some == [own.merge([w])[0] for w in words]


def test_lower_ranks_that_a_merge_makes_come_first(tmp_path):
    """A vocabulary where joining two symbols opens a pair of a lower rank."""
    tokens = {bytes([b]): b + 10 for b in range(256)} | {b"ab": 300, b"abc": 5, b"cd": 301, b"ba": 302}
    file = tmp_path / "ranks"
    file.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in tokens.items()))
    own = bytepairs.RankEncoder(str(file), r"\S+|\s+")
    library = tiktoken.Encoding("odd", pat_str=r"\S+|\s+", mergeable_ranks=tokens, special_tokens={})
    rng = random.Random(2)
    for text in ["abcd", "ababcdabc"] + ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))) for _ in range(500)]:
        assert ids(own, text) == library.encode_ordinary(text)


def test_the_tables_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bytepairs, "MOST_WORDS", 5)
    own = bytepairs.RankEncoder(FILE, PATTERN)
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join("".join(rng.choice("abc") for _ in range(4)) for _ in range(6))
        assert ids(own, text) == library.encode_ordinary(text)
    assert len(own.words) <= 12 and len(own.older) <= 12


def test_the_queue_gives_ranks_in_order():
    queue = bytepairs.RankQueue(300_000)
    ranks = np.array([299_999, 7, 70_000, 7, 4096, 64])
    queue.fill(np.arange(6), ranks)
    got = []
    while queue.top:
        r = queue.first()
        got += [(r, p) for p in queue.buckets[r]]
        queue.drop(r)
    assert got == [(7, 1), (7, 3), (64, 5), (4096, 4), (70_000, 2), (299_999, 0)]


def test_odd_rows_and_none(odd, none, library):
    got = bytepairs.encode_documents(odd, FILE, PATTERN).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(library, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]), key=repr)
    assert bytepairs.encode_documents(none, FILE, PATTERN).collect() == []
    row = bytepairs.encode_documents(odd.filter("doc_id = 7"), FILE, PATTERN, with_ids=True).first()
    assert row.ids == library.encode_ordinary("naïve ▁x  日本 😀\r\nend")


def test_the_query_equals_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    got = queries.op11_rank_queue_bpe(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(expected(library, rows))
