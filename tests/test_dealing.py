"""How documents are dealt over tasks, and what a task holds of them."""

import pandas as pd

from ledgerproof.operators import documents
from ledgerproof.sources.markdown import split_row


def test_documents_of_one_partition_are_dealt(spark):
    docs = spark.createDataFrame([(str(k), f"| A |\n|--|\n| {k} |\n") for k in range(200)], "doc_id string, text string").coalesce(1)
    got = documents.per_document(docs, lambda text: [{"n": len(text)}], "n int")
    held = got.rdd.glom().map(len).collect()
    assert sum(held) == 200 and max(held) < 200


def test_rows_are_handed_on_in_pieces():
    pdf = pd.DataFrame({"doc_id": range(50), "path": None, "text": "x"})
    pieces = list(documents._each(iter([pdf]), lambda text: [{"n": 1}] * 1000, ["doc_id", "path", "n"]))
    assert sum(map(len, pieces)) == 50_000 and max(map(len, pieces)) < 2 * documents.ROWS_AT_ONCE


def test_rows_without_escapes_have_the_same_cells():
    cells = lambda line: [(c.text, c.start - 5, c.end - 5) for c in split_row(line, 5)]
    for line in ("| a | b_c |", "a|b", "|a||  |", " | **x** | _y_ |  ", "||", "|", "a |", "| a"):
        # an escape after the row takes the slow way; its own cell is left out
        slow = [c for c in cells(line.rstrip() + ("" if line.rstrip().endswith("|") else "|") + " \\x |")][:-1]
        assert cells(line) == slow


def test_batches_are_bounded_by_bytes(spark):
    from pyspark.sql import functions as F

    from ledgerproof.sources import corpus

    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([("1", "| A |\n|--|\n| 1 |\n")], "doc_id string, text string")
    for step in (lambda: documents.per_document(docs, lambda text: [{"n": 1}], "n int"), lambda: docs.select(corpus.mask(F.col("text")))):
        spark.conf.unset(limit)
        step()
        assert int(spark.conf.get(limit)) <= 8 << 20
