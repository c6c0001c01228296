"""Shared helpers: tables, scratch folders all executors can see, and Arrow text columns."""

from __future__ import annotations

import ctypes
import gc
import pickle
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

#: Used only where the session names no checkpoint folder and runs on one machine (tests).
LOCAL_SCRATCH = "file:///tmp/checkpoints/ledgerproof"
#: Rows and bytes of an Arrow batch that Spark hands to Python at once (a single larger text still comes whole).
BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the data folder, read by Spark (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not folder and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (folder or LOCAL_SCRATCH).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(where)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write the rows as Parquet to the shared folder and read them back.

    Losing an executor afterwards costs nothing, as the files have no lineage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """From here on the session hands Python batches bounded by rows and bytes, so a task's memory doesn't depend on row sizes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def in_arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow over small batches. What a task has freed goes back to the system at its end, not to the next task of its process."""
    small_batches(rows.sparkSession)

    def whole(batches):
        yield from run(batches)
        give_back()

    return rows.mapInArrow(whole, schema)


def where_text(docs: DataFrame, decide) -> DataFrame:
    """The rows of `docs` for which `decide` (texts of a small batch to booleans) says yes, whatever their columns.

    Only the texts go to Python; the rows themselves stay where Spark keeps them, and a filter there drops what was refused.
    """
    small_batches(docs.sparkSession)

    def good(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        let_go()
        for texts in batches:
            parts = [decide(part.column("t").to_pylist()) for part in slices(pa.RecordBatch.from_arrays([texts], names=["t"]), "t", 1 << 19)]
            yield pa.array([bool(x) for part in parts for x in part], pa.bool_())
        give_back()

    return docs.filter(F.arrow_udf(good, "boolean")(F.col("text")))


def in_one_task(rows: DataFrame, make):
    """What `make` builds from the Arrow batches of a bounded sample, in one task: the driver receives the result alone."""

    def run(batches):
        let_go()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(make(list(batches)))], pa.binary())], names=["made"])

    got = in_arrow(rows.coalesce(1), run, "made binary").first()
    return make([]) if got is None else pickle.loads(got.made)


def file_system(uri: str):
    """(pyarrow file system, path) of a Hadoop-style URI, for tasks that write their own formats."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    if uri.startswith(("s3a://", "s3n://")):
        uri = "s3://" + uri.split("://", 1)[1]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def vocabulary(path: str) -> str:
    """The place of a vocabulary file: a path as it is; a bare name is a public tokenizer's, wherever this machine keeps it."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def binary_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part hold about `most_bytes` (one text at least)."""
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    begin, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + (n or 0) > most_bytes:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def crc_fold(column: str, folds: int):
    """crc32 of the id written as decimal text, modulo `folds` (a stable split of the rows)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def first_rows(docs: DataFrame, classes: DataFrame, by: str = "component_id") -> DataFrame:
    """One row of `docs` for each value of `by` in `classes` (doc_id, h: the text's xxhash64, `by`; a row per row of `docs`), and all rows without an id.

    It is a row of the least doc_id of the class that is itself in the class: with several such texts the one of least h, and of rows
    that agree in id and text the one with the least hash of its columns (maps don't count). Only ids and hashes are grouped; rows
    move once, to the last join.
    """
    best = classes.filter("doc_id is not null").groupBy(by, "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    best = best.groupBy(by).agg(F.min(F.struct("doc_id", "h", "n")).alias("x")).select(F.col("x.doc_id").alias("first_id"), F.col("x.h").alias("first_h"), "x.n")
    best = materialize(best, "first")
    this = (docs["doc_id"] == best["first_id"]) & (F.xxhash64(docs["text"]) == best["first_h"])
    once, again = docs.join(best.filter("n = 1"), this, "left_semi"), docs.join(best.filter("n > 1"), this, "left_semi")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)]
    again = again.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*plain)).alias("x")).select("x.*")
    return once.unionByName(again).unionByName(docs.filter("doc_id is null"))


_held: dict[tuple, object] = {}


def held(key: tuple, make):
    """What a task's process keeps for later tasks of the same operator; another operator's is let go first."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """For operators that keep nothing: free what another one has left in this process, and hand empty pages back."""
    if _held:
        _held.clear()
        gc.collect()
    give_back()


def give_back() -> None:
    """Hand empty pages of this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def chunked(items: Iterable, size: int) -> Iterator[list]:
    out: list = []
    for x in items:
        out.append(x)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
