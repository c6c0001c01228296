import os

import pytest

import corpus_pipeline
from ledgerproof.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_stages(spark):
    """Each stage keeps columns and drops what its operator decides; the last encodes all that is left."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert 0.75 * n < docs.count() <= n, name
        n = docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == n
    assert corpus_pipeline.run(spark, SF).count() == n


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


def plain_version(spark, docs, labels, items):
    """The five stages by loops over rows; only the two models are learned by the operators (on what each stage is given)."""
    import sentencepiece
    import xxhash

    from ledgerproof.llm import langid, toxicity
    from ledgerproof.llm.common import vocabulary
    from tests.llm.test_copies import brute
    from tests.llm.test_templates import leaks

    frame = lambda rows: spark.createDataFrame(rows, docs.schema)
    rows = docs.collect()
    model = langid.learn(docs)
    rows = [r for r in rows if not model.decide([r.text])[2][0]]
    machine = toxicity.learn(frame(rows), labels)
    rows = [r for r in rows if machine.score([r.text or ""])[0] < 0.5]

    def h(text):
        v = xxhash.xxh64_intdigest(text.encode(), 42)
        return v - (1 << 64) if v >> 63 else v

    texts = sorted({(r.doc_id, h(r.text), r.text) for r in rows if r.doc_id is not None})
    label = brute([(n, t) for n, (_, _, t) in enumerate(texts)])
    first = {}
    for n, (i, key, _) in enumerate(texts):
        first[label[n]] = min(first.get(label[n], (i, key)), (i, key))
    wanted, kept, done = set(first.values()), [], set()
    for r in rows:
        key = None if r.doc_id is None else (r.doc_id, h(r.text))
        if key is None or key in wanted and key not in done:
            kept.append(r)
            done.add(key)
    bad = {i for i, _ in leaks([(n, r.text) for n, r in enumerate(kept)], items)}
    kept = [r for n, r in enumerate(kept) if n not in bad]
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary(corpus_pipeline.PIECES))
    return sorted((-1 if r.doc_id is None else r.doc_id, len(ids := library.encode(r.text or "")), library.decode(ids)) for r in kept), len(docs.collect()) - len(rows), len(bad)


def test_equal_to_plain_version(spark, tmp_path):
    """All stages on a small corpus with nulls, repeats, near copies, copies of benchmark items and columns that operators name inside."""
    import hashlib
    import random

    from pyspark.sql import functions as F

    rng = random.Random(1)
    some = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(110).collect() if len(r.text or "") < 6000]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").limit(8).collect()] + [(900, "Compute 45 * 12."), (901, None)]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in some]
    rows += [(5000 + k, f"{some[k].text} {items[k % 3][1]} {some[k + 1].text}", "en", "s", 1) for k in range(5)]
    for k in range(6):
        words = some[20 + k].text.split()
        if len(words) > 80:
            words[rng.randrange(len(words))] = "changed"
        rows.append((6000 + k, " ".join(words), some[20 + k].lang, "s", 1))
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1], "en", "s", 2), (None, rows[6][1], "en", "s", 3), (None, None, None, None, None), (7000, None, "en", "s", 0), (7001, "", "en", "s", 0), (7002, "123 --", "en", "s", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(n) for n, c in enumerate(("h", "row", "node", "first", "n", "template", "place", "c"))})
    folder = str(tmp_path)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want, dropped, leaked = plain_version(spark, docs, spark.read.parquet(f"{folder}/labels.parquet"), items)
    assert dropped >= 4 and leaked >= 3 and len(want) > 60
    got = corpus_pipeline.run(spark, folder).collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.decoded_sha256) for r in got) == sorted((i, n, digest(t)) for i, n, t in want)


def test_stages_on_an_empty_table(spark, none):
    """No rows give no rows, with the columns as they were."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, SF)
        assert out.columns == none.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, SF).count() == 0
