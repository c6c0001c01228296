"""Checking documents again as they change: a stream of document versions into the latest findings of each document.

Each document has a small state: when its newest version was written, a digest of that text, and how many texts it has had; documents share groups by
their id, and a group's states are kept together. A version that is older than the state is passed over, a
text that is the same is not checked again, and one without a text forgets the document. What changes goes out as rows, one for the version itself and
one for each finding, so reading the newest version of each document is enough; `compact` folds what is read into one table and drops what it replaces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.documents import ROWS_AT_ONCE, _finding_rows
from ..plans.findings import SCHEMA

#: A row of a version: `version` counts a document's different texts; `gone` says that it was deleted. Findings' columns are null in the row of the version itself.
ROWS = f"doc_id string, path string, at timestamp, version long, gone boolean, {SCHEMA}"
STATE = "ids array<string>, at array<long>, digest array<string>, version array<long>"
#: Groups that documents are dealt to by their id; a group has one state. What Spark spends on a group costs more than to check some documents, so there are far fewer groups than documents in a large corpus.
GROUPS = 1 << 14
#: Older than any version.
_NEVER = (float("-inf"), "")
_FINDING = [part.split()[0] for part in SCHEMA.split(", ")]
_COLUMNS = ["doc_id", "path", "at", "version", "gone", *_FINDING]


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*.md", every: str | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Check Markdown files of `folder` as they arrive or change name; see `recheck`."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", glob).load(folder)
    docs = files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"), F.col("value").alias("text"))
    return recheck(docs.withColumn("doc_id", F.sha2("path", 256)), out, checkpoint, every, after)


def watch_table(spark: SparkSession, folder: str, out: str, checkpoint: str, every: str | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Check the documents (doc_id, path, at, text) of Parquet files as they are added to `folder`; a null text deletes its document."""
    schema = "doc_id string, path string, at timestamp, text string"
    return recheck(spark.readStream.schema(schema).parquet(folder), out, checkpoint, every, after)


def _advance(key: tuple, versions: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The rows of the newest version of each document of a group, where it is news. Of several versions of one in a batch only the newest counts; of those written at one time the one whose digest is greatest."""
    known = {i: (at, digest, version) for i, at, digest, version in zip(*state.get, strict=True)} if state.exists else {}
    newest: dict = {}
    for pdf in versions:
        for doc_id, when, path, text in zip(pdf["doc_id"], pdf["at"], pdf["path"], pdf["text"], strict=True):
            stamp = -1 if pd.isna(when) else when.value
            mine = "" if text is None else hashlib.sha256(text.encode()).hexdigest()
            # older than the state, or the same again, or not the newest of this batch
            if (stamp, mine) > max(known.get(doc_id, _NEVER)[:2], newest.get(doc_id, _NEVER)[:2]):
                newest[doc_id] = stamp, mine, when, path, text
    if not newest:
        return
    news = []
    for doc_id, (stamp, mine, when, path, text) in newest.items():
        _, digest, version = known.get(doc_id, (None, None, 0))
        known[doc_id] = stamp, mine, version + (mine != digest)
        if mine != digest:  # else written again without a change: its findings stand
            news.append(([doc_id, path, when, version + 1, text is None], text))
    newest.clear()
    state.update(([*known], *([x[k] for x in known.values()] for k in range(3))))
    rows = []
    for head, text in news:
        found = _finding_rows(text) if text is not None else []
        rows += [head + [r.get(c) for c in _FINDING] for r in [{}, *found]]
        if len(rows) >= ROWS_AT_ONCE:
            yield _frame(rows)
            rows = []
    if rows:
        yield _frame(rows)


def _frame(rows: list[list]) -> pd.DataFrame:
    # objects as they are: to find and change the type of each column would cost more than the check itself
    return pd.DataFrame(rows, columns=_COLUMNS, dtype=object)


def recheck(docs: DataFrame, out: str, checkpoint: str, every: str | None = None, after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Check a stream of document versions (doc_id, path, at, text). Each micro-batch overwrites its own folder of `out`/batch=N, so a repeated batch is harmless.

    `every`: a trigger interval such as "5 seconds"; without it the stream takes what is there and stops. Texts whose content is known aren't checked again. Rows without an id are one document.
    """
    def one(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        if after:
            after(batch.sparkSession.read.parquet(f"{out}/batch={n}"), n)

    versions = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("at").cast("timestamp").alias("at"), "text")
    dealt = versions.withColumn("of", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS)))
    rows = dealt.groupBy("of").applyInPandasWithState(_advance, ROWS, STATE, "update", GroupStateTimeout.NoTimeout)
    writer = rows.writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _folders(spark: SparkSession, out: str) -> tuple[list[int], list[int]]:
    """(bases, batches) that are written whole, by number; a base holds the newest versions up to its batch."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    whole = lambda name: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}/_SUCCESS"))
    return tuple(sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}=") and whole(n)) for kind in ("base", "batch"))


def _newest(spark: SparkSession, out: str) -> tuple[DataFrame, int, list[str]]:
    """(all rows of each document's newest version, the last batch among them, the folders they come from)."""
    bases, batches = _folders(spark, out)
    last = bases[-1] if bases else -1
    paths = [f"{out}/base={last}"] * bool(bases) + [f"{out}/batch={n}" for n in batches if n > last]
    fields = spark.createDataFrame([], ROWS).schema
    rows = spark.read.schema(fields).parquet(*paths) if paths else spark.createDataFrame([], fields)
    newest = rows.groupBy("doc_id").agg(F.max("version").alias("version"))
    found = rows.join(newest, (rows.doc_id.eqNullSafe(newest.doc_id)) & (rows.version == newest.version), "left_semi")
    return found, max([last, *batches]), paths


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The findings of each document's newest version; a document without findings has no row, nor has one that was deleted."""
    return _newest(spark, out)[0].filter("code is not null")


def compact(spark: SparkSession, out: str) -> int:
    """Fold all batches into one base of newest versions and delete what it replaces; the number of its rows. Deleted documents keep one row, so that a base is enough.

    Readers of the folder find either the old folders or the base, which counts once it is written whole.
    """
    rows, last, paths = _newest(spark, out)
    target = f"{out}/base={last}"
    if not paths or paths == [target]:
        return rows.count()
    rows.write.mode("overwrite").parquet(target)
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(out).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for path in paths:
        fs.delete(fs_path(path), True)
    return spark.read.parquet(target).count()
