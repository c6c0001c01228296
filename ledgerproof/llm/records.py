"""Token ids in length-delimited binary records with masked checksums and a separate offset index.

A record is: payload length (8 bytes, little-endian), masked CRC-32C of those 8 bytes (4), payload, masked CRC-32C of
the payload (4) - the framing TFRecord readers know. A payload is the document's key (8, signed), a byte that
gives the width of an id (2 or 4; 128 more where the document has no key), and the ids. Files follow each other in ascending key order. The index has a row per
record (part, file, seq, doc_id, offset, length, n_tokens, start) and is a Parquet table, so a training job
can draw records in any order by byte range.

A task writes a file of its own name for each attempt; only files that the index of the finished job
names exist for readers, so a task that is run again or twice leaves at most an unnamed file behind.
"""

from __future__ import annotations

import re
import string
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_texts, file_system, held, slices, small_batches, vocabulary

#: Words whose ids a task's process keeps between batches; the table is emptied beyond that.
MOST_WORDS = 1_000_000
#: Words of letters that the library is given at once.
LINE = 64
#: Marks that stand behind letters as a pre-token of their own (an apostrophe may not), and words of letters and such marks.
MARKS = "".join(c for c in string.punctuation if c != "'")
MARKED = re.compile(rf"[^\W\d_]+[{re.escape(MARKS)}]+").fullmatch
#: Bytes of a file read at once.
READ_BYTES = 8 << 20
POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected (a fixed value)
MASK_DELTA = 0xA282EAD8  # of the masked checksum (a fixed value)
BLOCK = 128
#: Added to the width byte of a record without a key.
NO_KEY = 128


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """The table of two bytes, and for 2**k zero bytes the four tables that move a checksum past them."""
    byte = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        byte = np.where(byte & 1, byte >> 1 ^ np.uint32(POLYNOMIAL), byte >> 1)
    one = np.array([np.arange(256, dtype=np.uint32) << (8 * k) for k in range(4)], np.uint32)
    skip = [byte[one & 255] ^ one >> 8]
    for _ in range(40):
        skip.append(_move(skip[-1], skip[-1]))
    two = np.arange(1 << 16, dtype=np.uint32)
    for _ in range(2):
        two = byte[two & 255] ^ two >> 8
    return two, skip


def _move(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def crc32c(messages: list[bytes]) -> np.ndarray:
    """CRC-32C of each message. All messages advance together: 128-byte blocks side by side, then each one's blocks."""
    if not messages:
        return np.empty(0, np.uint32)
    two, skip = _tables()
    sizes = np.fromiter(map(len, messages), np.int64, len(messages))
    blocks = np.maximum(1, -(-sizes // BLOCK))
    ends = np.cumsum(blocks)
    flat = np.zeros(int(ends[-1]) * BLOCK, np.uint8)  # zeros before a message don't count
    for end, m in zip((ends * BLOCK).tolist(), messages, strict=True):
        flat[end - len(m): end] = np.frombuffer(m, np.uint8)
    crc = np.zeros(int(ends[-1]), np.uint32)
    for column in np.ascontiguousarray(flat.view("<u2").reshape(-1, BLOCK // 2).T):
        crc = two[(crc ^ column) & 0xFFFF] ^ crc >> 16
    begins, step = ends - blocks, BLOCK.bit_length() - 1
    total = crc[begins]
    order = np.argsort(-blocks, kind="stable")
    lasting = np.searchsorted(-blocks[order], -np.arange(1, int(blocks.max())), "left")
    for j, n in enumerate(lasting.tolist(), 1):  # the first n messages by size have a block j
        some = order[:n]
        total[some] = _move(skip[step], total[some]) ^ crc[begins[some] + j]
    start = np.full(len(messages), 0xFFFFFFFF, np.uint32)
    for k in range(int(sizes.max()).bit_length()):
        some = sizes >> k & 1 == 1
        start[some] = _move(skip[k], start[some])
    return total ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    """Each payload with its length and both masked checksums."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    tails = masked(crc32c(payloads)).astype("<u4").tobytes()
    marks = masked(crc32c(heads)).astype("<u4").tobytes()
    return [h + marks[i: i + 4] + p + tails[i: i + 4] for h, p, i in zip(heads, payloads, range(0, 4 * len(payloads), 4), strict=True)]


def parse(data: bytes | memoryview) -> tuple[list[bytes], int]:
    """(payloads of the whole frames at the front of `data`, bytes they take). Wrong checksums raise ValueError."""
    at, heads, payloads, marks, tails = 0, [], [], [], []
    while at + 12 <= len(data):
        (n,) = struct.unpack_from("<Q", data, at)
        if at + 16 + n > len(data):
            if masked(crc32c([bytes(data[at: at + 8])]))[0] != struct.unpack_from("<I", data, at + 8)[0]:
                raise ValueError("a record's length is damaged")
            break
        heads.append(bytes(data[at: at + 8]))
        marks.append(bytes(data[at + 8: at + 12]))
        payloads.append(bytes(data[at + 12: at + 12 + n]))
        tails.append(bytes(data[at + 12 + n: at + 16 + n]))
        at += 16 + n
    for bodies, sums in ((heads, marks), (payloads, tails)):
        if masked(crc32c(bodies)).astype("<u4").tobytes() != b"".join(sums):
            raise ValueError("a record's checksum is wrong")
    return payloads, at


class WordEncoder:
    """Ids of texts by the tokenizers library, which sees each new blank-separated word once.

    Exact for tokenizers that drop white space and never look across it, as is checked on opening: the pre-tokenizer must
    give words without blanks, and the normalizer must not join what blanks part.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary(path))
        probe = "Ab, it's\n x́y\t́z  12 <b>"
        apart = [i for w in probe.split() for i in self.library.encode(w, add_special_tokens=False).ids]
        if self.library.encode(probe, add_special_tokens=False).ids != apart:
            raise ValueError("this tokenizer looks across white space: texts can't be cut into words")
        self.wide = self.library.get_vocab_size() > 65536
        self.words: dict[bytes, bytes] = {}
        self.last = self._last()
        pre = self.library.pre_tokenizer
        self.marked = pre is not None and all(len(pre.pre_tokenize_str("a" + c)) == 2 for c in MARKS)

    def _last(self) -> np.ndarray | None:
        """Which ids end a pre-token, where the vocabulary tells: a BPE whose last symbols have a suffix, of which every byte has one."""
        from tokenizers.pre_tokenizers import ByteLevel

        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        vocab = self.library.get_vocab()
        if not suffix or not all(c + suffix in vocab for c in ByteLevel.alphabet()):
            return None
        last = np.zeros(max(vocab.values()) + 1, bool)
        last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        return last

    def _lines(self, texts: list[str], needs: list[int]) -> list[bytes]:
        """Ids of words of letters, with marks behind them or not, encoded LINE at a time. A word has at least as many pre-tokens as it needs (letters one,
        marks one), so a line with just as many as all its words need has no more for any."""
        lines = [(texts[at: at + LINE], needs[at: at + LINE]) for at in range(0, len(texts), LINE)]
        out: list[bytes] = []
        for (line, need), x in zip(lines, self.library.encode_batch_fast([" ".join(line) for line, _ in lines], add_special_tokens=False), strict=True):
            ids, after = np.array(x.ids, "<u4"), np.cumsum(need)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != after[-1]:  # a letter that normalising takes apart
                out += self._alone(line)
                continue
            raw, ends = ids.tobytes(), (ends[after - 1] * 4).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, new: list[bytes]) -> None:
        """Take words that aren't in the table yet into it."""
        for at in range(0, len(new), 20_000):
            part = new[at: at + 20_000]
            texts = [w.decode() for w in part]
            if self.last is None:
                self.words.update(zip(part, self._alone(texts), strict=True))
                continue
            needs = [1 if t.isalpha() else 2 if self.marked and MARKED(t) else 0 for t in texts]
            plain = [k for k, n in enumerate(needs) if n]
            self.words.update(zip([part[k] for k in plain], self._lines([texts[k] for k in plain], [needs[k] for k in plain]), strict=True))
            others = [k for k, n in enumerate(needs) if not n]
            self.words.update(zip([part[k] for k in others], self._alone([texts[k] for k in others]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        cut = [t.split() for t in texts]
        self.learn(list(set().union(*cut) - self.words.keys()))
        get = self.words.__getitem__
        return [b"".join(map(get, words)) for words in cut]


def word_encoder(path: str) -> WordEncoder:
    return held(("words", path), lambda: WordEncoder(path))


def key_of(payload: bytes) -> tuple[int | None, int]:
    """(key, bytes of an id) of a record's payload."""
    k, width = struct.unpack_from("<qB", payload)
    return (None if width & NO_KEY else k), width & ~NO_KEY


INDEX = "part int, file string, seq long, doc_id long, offset long, length long, n_tokens long"


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int, parts: int | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text (null: empty), append `end_id`, and write records in ascending key order. Returns the index.

    Rows are dealt by ranges of the key (null keys first) and, as rows of one key can be many, of the text's first letters and its hash; equal rows
    are dealt by their place in the input. Within a range they are sorted alike, so ties have one order. The index is written to `folder`/index and read back from there. A text of any
    length is one record.
    """
    spark = docs.sparkSession
    small_batches(spark)
    order = ["k", "first", "h", "same"]
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.pmod(F.monotonically_increasing_id(), F.lit(256)).alias("same"))
    rows = rows.withColumn("first", F.substring("t", 1, 32)).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)

    def run(batches):
        own, end = word_encoder(tokenizer), struct.pack("<I", end_id)
        width = 4 if own.wide or end_id > 65535 else 2
        part, offset, seq, out = TaskContext.get().partitionId(), 0, 0, None
        name = f"part-{part:06d}-{uuid.uuid4().hex}.rec"
        fs, path = file_system(folder)
        try:
            for whole in batches:
                for batch in slices(whole, "t", 4 << 20):
                    ids = [x + end for x in own.encode(binary_texts(batch.column("t")))]
                    keys = batch.column("k").to_pylist()
                    small = ids if width == 4 else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                    framed = frames([struct.pack("<qB", k or 0, width if k is not None else width | NO_KEY) + x for k, x in zip(keys, small, strict=True)])
                    if out is None:
                        fs.create_dir(path, recursive=True)
                        out = fs.open_output_stream(f"{path}/{name}")
                    out.write(b"".join(framed))
                    lengths = list(map(len, framed))
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([part] * n, pa.int32()), pa.array([name] * n), pa.array(range(seq, seq + n), pa.int64()), pa.array(keys, pa.int64()),
                        pa.array(accumulate(lengths[:-1], initial=offset), pa.int64()), pa.array(lengths, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    ], names=["part", "file", "seq", "doc_id", "offset", "length", "n_tokens"])
                    seq, offset = seq + n, offset + sum(lengths)
        finally:
            if out is not None:
                out.close()

    rows.sortWithinPartitions(*order[:3], "t").select("k", "t").mapInArrow(run, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def files_of(index: DataFrame) -> DataFrame:
    """A row per file in reading order: part, file, n_tokens, start (ids in the files before it).

    The sums pass through the driver: as many rows as the writing job had tasks, whatever the number of documents.
    """
    rows = sorted(index.groupBy("part", "file").agg(F.sum("n_tokens").alias("n")).collect())
    starts = accumulate((r.n for r in rows), initial=0)
    found = [(r.part, r.file, int(r.n), s) for r, s in zip(rows, starts, strict=False)]
    files = index.sparkSession.createDataFrame(found, "part int, file string, n_tokens long, start long")
    return files.repartition(max(1, min(len(found), 10_000)))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files of a folder back: doc_id, start (ids before it in key order), n_tokens, ids_crc32.

    ids_crc32 is the unsigned crc32 of the document's ids as little-endian unsigned 32-bit numbers. Every checksum is verified.
    """
    files = files_of(spark.read.schema(INDEX).parquet(f"{folder}/index"))

    def run(batches):
        fs, path = file_system(folder)
        for pdf in batches:
            for name, start in zip(pdf["file"], pdf["start"], strict=True):
                with fs.open_input_stream(f"{path}/{name}") as data:
                    held, start = b"", int(start)
                    while more := data.read(max(READ_BYTES, len(held))):
                        held += more
                        payloads, used = parse(held)
                        held = held[used:]
                        rows = []
                        for p in payloads:
                            k, width = key_of(p)
                            ids = p[9:] if width == 4 else np.frombuffer(p, "<u2", offset=9).astype("<u4").tobytes()
                            rows.append((k, start, len(ids) // 4, zlib.crc32(ids)))
                            start += len(ids) // 4
                        if rows:
                            out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                            yield out.astype({"doc_id": "Int64"})
                    if held:
                        raise ValueError(f"{name} ends within a record")

    return files.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(folder: str, file: str, offset: int, length: int) -> tuple[int | None, list[int]]:
    """(key, ids) of one record by its index row: what a shuffled reader does."""
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/{file}") as data:
        (payload,), _ = parse(data.read_at(length, offset))
    k, width = key_of(payload)
    return k, np.frombuffer(payload, f"<u{width}", offset=9).tolist()


def roundtrip(docs: DataFrame, tokenizer: str, folder: str, end_id: int) -> DataFrame:
    """Write `docs` and read the files back."""
    write(docs, tokenizer, folder, end_id)
    return read(docs.sparkSession, folder)
