import functools
import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerproof.llm import records, sentencepieces
from ledgerproof.llm.common import scratch
from ledgerproof.llm.queries import PIECES, WORDS

texts = st.lists(st.one_of(st.sampled_from(["the ", "  ", "\n", "▁", "<s>", "<0x0A>", "naïve", "日本", "😀", "'s ", "12", ".,"]), st.text(max_size=8)), max_size=12).map("".join).map(lambda t: t.encode("utf-8", "ignore").decode())


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=5))
def test_merges_equal_the_library(batch):
    own = sentencepieces.encoder(PIECES)
    ids = [i for i, _ in own.encode(batch)]
    assert ids == own.library.encode(batch)
    assert [own.decode(i) for i in ids] == own.library.decode(ids)


def test_sentencepiece_rows(spark, odd, none):
    own = sentencepieces.encoder(PIECES)
    for check in ("words", "texts"):
        got = sentencepieces.encode_documents(odd, PIECES, check=check, with_ids=True).collect()
        assert len(got) == odd.count()
    want = sorted((r.doc_id or -1, len(i := own.library.encode(r.text or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(own.library.decode(i).encode()).hexdigest()) for r in odd.collect())
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert sentencepieces.encode_documents(none, PIECES).count() == 0
    with pytest.raises(ValueError):
        sentencepieces.encode_documents(odd, PIECES, check="no")


def test_crc32c():
    def slow(message):
        crc = 0xFFFFFFFF
        for b in message:
            crc ^= b
            for _ in range(8):
                crc = crc >> 1 ^ (records.POLYNOMIAL if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    rng = np.random.default_rng(1)
    messages = [rng.bytes(n) for n in (0, 1, 127, 128, 129, 255, 256, 257, 1000, 3)]
    assert records.crc32c(messages).tolist() == [slow(m) for m in messages]
    assert records.crc32c([b"123456789"])[0] == 0xE3069283


def test_frames():
    framed = b"".join(records.frames([b"", b"abc", b"x" * 300]))
    assert records.parse(framed + b"\x01")[0] == [b"", b"abc", b"x" * 300]
    for at in (0, 9, 20, len(framed) - 1):
        broken = bytearray(framed)
        broken[at] ^= 1
        with pytest.raises((ValueError, struct.error)):
            payloads, used = records.parse(bytes(broken))
            assert used == len(framed), "cut short"


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, min_size=1, max_size=4))
def test_words_equal_the_library(batch):
    own = records.word_encoder(WORDS)
    want = [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in own.library.encode_batch(batch, add_special_tokens=False)]
    assert own.encode([t.encode() for t in batch]) == want


def test_records_round_trip(spark, odd, none):
    folder = scratch(spark, "test-records")
    index = records.write(odd, WORDS, folder, end_id=2, parts=3)
    got = records.read(spark, folder).collect()
    library = records.word_encoder(WORDS).library
    rows = sorted(((-(2**63) if r.doc_id is None else r.doc_id, r.text or "", [*library.encode(r.text or "", add_special_tokens=False).ids, 2]) for r in odd.collect()), key=lambda r: r[:2])
    start, want = 0, []
    for k, _, ids in rows:
        want.append((k, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert sorted(((-(2**63) if r.doc_id is None else r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    one = index.filter("doc_id = 7").first()
    assert records.fetch(folder, one.file, one.offset, one.length) == (7, next(i for k, _, i in rows if k == 7))
    assert records.roundtrip(none, WORDS, scratch(spark, "test-empty"), 2).count() == 0


def test_keys_at_the_edges(spark):
    """The least key and no key are told apart, rows of one key go to several tasks, and a very long text is one record."""
    rows = [(-(2**63), "least"), (None, "no key"), (None, None), (2**63 - 1, "most"), (5, "long words " * 60_000)] + [(7, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("first", F.lit(1)).withColumn("same", F.lit(2)).repartition(4)
    folder = scratch(spark, "test-records")
    index = records.write(docs, WORDS, folder, end_id=2, parts=5)
    got = records.read(spark, folder).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in rows)
    assert index.filter("doc_id = 7").select("part").distinct().count() > 1
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in got)
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    known = [k for _, _, k in starts if k is not None]
    assert known == sorted(known)
    one = index.filter(f"doc_id = {-(2**63)}").first()
    assert records.fetch(folder, one.file, one.offset, one.length)[0] == -(2**63)


def test_every_kind_of_cut_is_checked():
    """Words after line ends, line ends and runs of marks are compared with the library too: a wrong merge of any of them is refused."""
    own = sentencepieces.MergeEncoder(PIECES)
    merge, own.merge = own.merge, lambda words: [[*ids[:-1], (ids[-1] + 1) % 32000] if w == bad else ids for w, ids in zip(words, merge(words), strict=True)]
    for bad in ("\n", "begun", "▁▁", "▁word"):
        own.words.clear()
        with pytest.raises(AssertionError):
            own.encode(["word\nbegun word  \n"])
    bad = None
    own.words.clear()
    assert own.encode(["word\nbegun word  \n"])[0][0] == own.library.encode("word\nbegun word  \n")


def test_words_in_lines_have_the_ids_of_words_alone():
    """Words of letters and marks go through the library many at a time; letters that normalising takes apart and words that need it go alone."""
    import random
    import struct

    from ledgerproof.llm import records

    rng, letters = random.Random(3), "abcdeEXZéèñßİǅΣςˀ中한²Ⅷ́'s"
    words = list({"".join(rng.choices(letters, k=rng.randrange(1, 9))) + rng.choice(["", "", ".", "...", ",", "$$$", "'s", "'.", "́", "!́", "_", "≠"]) for _ in range(20_000)})
    own = records.WordEncoder("word_bpe_49k.json")
    assert own.last is not None and own.marked
    lines, passed = own._lines, []
    own._lines = lambda texts, needs: passed.extend(texts) or lines(texts, needs)
    text = " ".join(words)
    (got,) = own.encode([text.encode()])
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == own.library.encode(text, add_special_tokens=False).ids
    own.words.clear()
    own.learn([w.encode() for w in words])
    for w in words[:3000]:
        ids = own.library.encode(w, add_special_tokens=False).ids
        assert own.words[w.encode()] == struct.pack(f"<{len(ids)}I", *ids), w
    assert len(passed) > 5000


def test_frequent_pieces_are_merged_once_when_a_table_is_full(monkeypatch):
    """A full table isn't thrown away: words that every batch holds aren't merged again, and both tables are bounded."""
    monkeypatch.setattr(sentencepieces, "MOST_WORDS", 40)
    own = sentencepieces.MergeEncoder(PIECES)
    merge, merged = own.merge, []
    own.merge = lambda words: merged.extend(words) or merge(words)
    for k in range(60):
        text = f"common words stay {' '.join(f'rare{k}x{i}' for i in range(12))}"
        assert own.encode([text])[0][0] == own.library.encode(text)
    assert merged.count("▁common") == merged.count("▁words") == merged.count("▁stay") == 1
    assert len(own.words) <= 56 and len(own.older) <= 56


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab \n\r\t▁é中😀\x00\x85 "), max_size=12), min_size=1, max_size=5))
def test_cuts_are_runs_of_marks_and_what_follows(batch):
    import re

    own = common_pieces()
    alone = "".join(map(chr, own.alone))
    rule = re.compile(f"[{re.escape(alone)}]|▁*[^▁{re.escape(alone)}]+|▁+")
    want = [rule.findall("▁" + t.replace(" ", "▁")) if t else [] for t in batch]
    words, numbers, stops = own.cuts(batch)
    got = [words[i].decode().replace(" ", "▁") for i in numbers]
    assert [got[a:b] for a, b in zip([0, *stops], stops, strict=False)] == want
    assert len(set(words)) == len(words)
    assert own.encode(batch) == [(x, ",".join(map(str, x))) for x in own.library.encode(batch)]


@functools.lru_cache(maxsize=1)
def common_pieces():
    return sentencepieces.MergeEncoder(PIECES)
