import hashlib

from ledgerproof.llm import warc
from ledgerproof.llm.common import scratch


def test_round_trip(spark):
    long, other = "<p>" + "x" * 200 + "é</p>", "y" * 150
    rows = [(5, "http://a/1", long), (3, None, long), (9, "http://b/ü?q=1\n2", long), (4, "u", other), (6, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "u", ""), (None, "u", long), (3, "u", long), (11, "u", "z" * 300_000)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload_digest string").repartition(4)
    folder = scratch(spark, "test-warc")
    index = warc.write(pages, folder)
    got = warc.read(spark, folder).collect()
    assert len(got) == len(rows) == index.count()
    want = sorted((-1 if i is None else i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == long and i not in (3, None) else "response", 3 if h == long and i not in (3, None) else -1) for i, _, h in rows)
    assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in got) == want
    assert all("\n" not in r.target_uri for r in got)
    one = index.filter("page_id = 4").first()
    fs, path = warc.file_system(folder)
    with fs.open_input_file(f"{path}/{one.file}") as data:
        (raw,) = warc.members(__import__("io").BytesIO(data.read_at(one.length, one.offset)))
    fields, block = warc.parse_record(raw)
    assert block == other.encode() and fields["WARC-Record-ID"].startswith("<urn:page:4:") and warc.page_of(fields["WARC-Record-ID"]) == 4


def test_empty(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.roundtrip(empty, scratch(spark, "test-warc")).count() == 0


def test_ranges_and_repeated_ids(spark, monkeypatch):
    """Archives are read in ranges of whole records by several tasks, and pages of one id and different payloads have records of their own."""
    monkeypatch.setattr(warc, "RANGE_BYTES", 2000)
    rows = [(i // 2, "u", f"page {i} " * 200) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    folder = scratch(spark, "test-warc")
    index = warc.write(pages, folder)
    got = warc.read(spark, folder)
    assert got.rdd.getNumPartitions() > index.select("file").distinct().count()
    found = got.collect()
    assert sorted((r.page_id, r.payload_digest) for r in found) == sorted((i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows)
    assert len({warc.record_id(i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows}) == len(rows)


def test_revisits_name_the_original_and_the_time_of_writing(spark):
    import io
    import re

    text = "same payload " * 3_000_000  # far beyond what is read at once
    pages = spark.createDataFrame([(7, "http://b/2", text), (4, "http://a/1?q=ü", text)], "page_id long, url string, html string").repartition(2)
    for date in (None, "2020-02-03T04:05:06Z"):
        folder = scratch(spark, "test-warc")
        index = {r.page_id: r for r in warc.write(pages, folder, date=date).collect()}
        fs, path = warc.file_system(folder)
        with fs.open_input_file(f"{path}/{index[7].file}") as data:
            (raw,) = warc.members(io.BytesIO(data.read_at(index[7].length, index[7].offset)))
        fields, block = warc.parse_record(raw)
        assert block == b"" and fields["WARC-Refers-To-Target-URI"] == "http://a/1?q=%C3%BC" and fields["WARC-Refers-To-Date"] == fields["WARC-Date"]
        assert fields["WARC-Date"] == date if date else re.fullmatch(r"20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and fields["WARC-Date"] > "2021"
        got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(spark, folder).collect()}
        assert got == {4: ("response", None, len(text)), 7: ("revisit", 4, len(text))}
