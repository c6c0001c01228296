"""WARC archives with revisit resolution.

Only headers (digest, key, size) are shuffled by payload digest: the least key of each digest is a map-side combined
minimum, and the join that hands it back is narrow, so a digest that a third of all pages share can be split. Payloads move once,
by page key. A page whose payload stands in an earlier response becomes a revisit record without the payload. Archives
are gzip files with one member per record, so each record can be read by its offset alone.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from datetime import UTC, datetime
from itertools import accumulate
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_texts, file_system, materialize, slices, small_batches

#: Payloads below this many bytes are always written whole.
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # a fixed value of the format
CRLF = b"\r\n"
#: Bytes of compressed data inflated at once, and of an archive that one task reads.
READ_BYTES, RANGE_BYTES = 64 << 10, 64 << 20
INDEX = "part int, file string, page_id long, offset long, length long, record_type string"


def record_id(page: int | None, digest: str) -> str:
    """The record's URN. It names the page, so a revisit's target can be read from its header, and the payload, so pages that share an id
    have records of their own; a page without an id has a random one. Only a page stored twice with one payload has the same URN twice."""
    return f"<urn:page:{page}:{digest[:32]}>" if page is not None else f"<urn:uuid:{uuid.uuid4()}>"


def page_of(urn: str | None) -> int | None:
    return int(urn.split(":")[2]) if urn and urn.startswith("<urn:page:") else None


def target(url: str | None) -> str:
    return quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, first_url: str | None = None) -> bytes:
    """One record as bytes. Revisits carry no payload, but name its size, digest and first response, with that one's address and date (it is written with them)."""
    kind = "response" if refers_to is None else "revisit"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record_id(page, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        fields += [("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Target-URI", target(first_url)), ("WARC-Refers-To-Date", date), ("WARC-Profile", PROFILE)]
    body = payload if refers_to is None else b""
    fields.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode() + CRLF + body + CRLF + CRLF


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of one record."""
    head, _, rest = data.partition(CRLF + CRLF)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def members(stream, most_bytes: int | None = None, read_bytes: int = READ_BYTES):
    """The inflated gzip members of the next `most_bytes` of a stream (all of it: None), one after another.

    What follows a member's end in what was read is copied for each member, so little is read at once.
    """
    inflate, out, data, left = zlib.decompressobj(31), [], b"", most_bytes
    while True:
        if not data:
            data = stream.read(read_bytes if left is None else min(read_bytes, left))
            left = None if left is None else left - len(data)
            if not data:
                break
        out.append(inflate.decompress(data))
        data = b""
        if inflate.eof:
            yield b"".join(out)
            data, inflate, out = inflate.unused_data, zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("an archive ends within a record")


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to, first_url): a row per page that revisits an earlier one's payload, with the address of that one.

    Among pages with equal payloads of at least `least_bytes`, those with the least page_id are responses (all of
    them where a page_id is repeated). A page without an id is always a response. Null html is the empty payload.
    """
    heads = headers(pages).filter((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "payload_digest", "url")
    first = heads.groupBy("payload_digest").agg(F.min(F.struct("page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n"))
    first = first.filter("n > 1").select("payload_digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("first_url"))
    return heads.join(first, "payload_digest").filter("page_id > refers_to").select("page_id", "payload_digest", "refers_to", "first_url").distinct()


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_digest (hex SHA-256) and payload_bytes of every page, computed in the scan."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str | None = None) -> DataFrame:
    """Write every page as a response or revisit record of `date` (the time of writing, unless it is given); returns the index of the archives.

    Each attempt of a task writes a file of its own name, and the index, a Parquet table in `folder`/index, names those of the job that ended.
    """
    spark = pages.sparkSession
    small_batches(spark)
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    full = headers(pages).drop("payload_bytes").join(resolve(pages, least_bytes), ["page_id", "payload_digest"], "left")

    def run(batches):
        part, offset, out = TaskContext.get().partitionId(), 0, None
        name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        fs, path = file_system(folder)
        try:
            for whole in batches:
                for batch in slices(whole, "payload"):
                    c = {n: batch.column(n).to_pylist() for n in ("page_id", "url", "payload_digest", "refers_to", "first_url")}
                    packed = []
                    for page, url, payload, digest, to, first in zip(c["page_id"], c["url"], binary_texts(batch.column("payload")), c["payload_digest"], c["refers_to"], c["first_url"], strict=True):
                        packed.append(gzip.compress(record(page, url, payload, digest, to, date, first), 6, mtime=0))
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(b"".join(packed))
                    lengths = list(map(len, packed))
                    offsets = list(accumulate(lengths[:-1], initial=offset))
                    offset += sum(lengths)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part] * len(packed), pa.int32()), "file": [name] * len(packed), "page_id": pa.array(c["page_id"], pa.int64()),
                        "offset": pa.array(offsets, pa.int64()), "length": pa.array(lengths, pa.int64()), "record_type": ["response" if x is None else "revisit" for x in c["refers_to"]],
                    })
        finally:
            if out is not None:
                out.close()

    full.select("page_id", "url", "payload", "payload_digest", "refers_to", "first_url").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri.

    Sizes and digests of responses are computed anew from the stored payload and must agree with the headers.
    """
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    # ranges of whole records: as many as tasks are worth while, whatever the number of records
    ranges = index.groupBy("file", F.floor(F.col("offset") / RANGE_BYTES).alias("nth")).agg(F.min("offset").alias("begin"), F.sum("length").alias("size")).drop("nth")
    ranges = materialize(ranges, "ranges")
    tasks = max(1, min(ranges.count(), 20_000))

    def run(batches):
        fs, path = file_system(folder)
        for pdf in batches:
            for name, begin, size in zip(pdf["file"], pdf["begin"], pdf["size"], strict=True):
                with fs.open_input_file(f"{path}/{name}") as file:
                    file.seek(int(begin))
                    rows = []
                    for data in members(file, int(size)):
                        fields, block = parse_record(data)
                        digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                        length = int(fields["X-Payload-Length"])
                        if kind == "response" and (len(block) != length or hashlib.sha256(block).hexdigest() != digest):
                            raise ValueError(f"{fields['WARC-Record-ID']} in {name} is damaged")
                        rows.append((page_of(fields["WARC-Record-ID"]), length, digest, kind, page_of(fields.get("WARC-Refers-To")), fields["WARC-Target-URI"]))
                        if len(rows) == 10_000:
                            yield frame(rows)
                            rows = []
                    if rows:
                        yield frame(rows)

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"])
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    return ranges.repartition(tasks).mapInPandas(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def roundtrip(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives of `pages` and read them back."""
    write(pages, folder)
    return read(pages.sparkSession, folder)
