"""Byte-level BPE encoding and decoding by merge ranks.

A pre-token (a match of the split pattern) that is a token itself is that token. Any other starts as a linked list of bytes; each adjacent
pair whose join is a token waits in the bucket of that token's rank. A bitmap of three levels marks the buckets that hold something, so
that finding the first set bit on each level gives the next rank, whatever their number. The leftmost place of that bucket merges; its new neighbours
are filed under their own ranks, and an entry whose pair has changed since is stale and skipped when it comes up. A pre-token of n bytes has n entries
and at most two more a merge, so long ones (a megabyte of letters) cost n log n, where a scan for the best pair costs n².

All new pre-tokens of a batch share one list and one queue; nothing joins across their ends. Short ones are kept in two bounded tables of each task's
process: when the newer is full it becomes the older, from which only what is met again moves on.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, held, in_arrow, slices, texts_of, vocabulary

#: Pre-tokens that a table keeps between batches, their longest, the bytes that one queue takes on at once (one pre-token at least), and up to which its links are lists.
MOST_WORDS, LONGEST, QUEUED, LISTED = 400_000, 64, 1 << 18, 1 << 19
NONE = -1


class RankQueue:
    """Places filed under ranks; the first place of the least rank comes next."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int] | None] = [None] * ranks
        self.low, self.middle, self.top = [0] * (ranks // 64 + 1), [0] * (ranks // 4096 + 1), 0

    def fill(self, places: np.ndarray, ranks: np.ndarray) -> None:
        """File ascending places at once; a sorted list is a heap. The queue must be empty."""
        if not len(places):
            return
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        starts = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(ranks)], strict=True):
            r = int(ranks[a])
            self.buckets[r] = places[a:b].tolist()
            self.mark(r)

    def mark(self, r: int) -> None:
        """Say that a bucket holds something."""
        self.low[r >> 6] |= 1 << (r & 63)
        self.middle[r >> 12] |= 1 << (r >> 6 & 63)
        self.top |= 1 << (r >> 12)

    def first(self) -> int:
        """The least rank whose bucket is marked; only while `top` isn't zero."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.middle[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1

    def drop(self, r: int) -> None:
        """Take the mark of an empty bucket away."""
        self.buckets[r] = None
        self.low[r >> 6] &= ~(1 << (r & 63))
        if not self.low[r >> 6]:
            self.middle[r >> 12] &= ~(1 << (r >> 6 & 63))
            if not self.middle[r >> 12]:
                self.top &= ~(1 << (r >> 12))


class RankEncoder:
    """Encoder and decoder for one file of ranks; a token's rank is its id."""

    def __init__(self, path: str, pattern: str):
        fs, name = file_system(vocabulary(path))
        with fs.open_input_stream(name) as lines:
            pairs = [line.split() for line in lines.read().splitlines() if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.size = max(self.ranks.values()) + 1
        tokens: list[bytes | None] = [None] * self.size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.tokens = pa.array(tokens, pa.binary())
        self.find = regex.compile(pattern).findall
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.joins = {}  # a pair of ids to the id of their join
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    self.joins[a << 32 | b] = rank
        self.two = np.full(1 << 16, NONE, np.int32)  # of two bytes
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.two[token[0] << 8 | token[1]] = rank
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian, 32 bits each) of each pre-token that isn't empty, by one queue."""
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        n, ends = len(data), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1], before[np.r_[0, ends[:-1]]] = NONE, NONE
        rank = np.full(n, NONE, np.int32)
        rank[:-1] = self.two[data[:-1] << 8 | data[1:]]
        rank[ends - 1] = NONE
        queue = RankQueue(self.size)
        filed = np.flatnonzero(rank != NONE)
        queue.fill(filed, rank[filed])
        ids = self.of_byte[data]
        if n <= LISTED:  # lists are faster, arrays smaller
            ids, after, before, rank = ids.tolist(), after.tolist(), before.tolist(), rank.tolist()
        else:
            ids, after, before, rank = (array("i", x.tobytes()) for x in (ids, after, before, rank))
        join, buckets, mark = self.joins.get, queue.buckets, queue.mark
        while queue.top:
            r = queue.first()
            bucket, lower = buckets[r], False
            while bucket and not lower:
                i = heappop(bucket)
                if rank[i] != r:
                    continue  # stale: the pair that waited here has changed
                j = after[i]
                k = after[j]
                h = before[i]
                ids[i] = r
                ids[j] = rank[j] = rank[i] = NONE
                after[i] = k
                if k != NONE:
                    before[k] = i
                    new = join(r << 32 | ids[k])
                    if new is not None:
                        rank[i] = new
                        if (other := buckets[new]) is None:
                            buckets[new] = [i]
                            mark(new)
                        else:
                            heappush(other, i)
                        lower = new < r
                if h != NONE:
                    new = join(ids[h] << 32 | r)
                    if new is None:
                        rank[h] = NONE
                    else:
                        rank[h] = new
                        if (other := buckets[new]) is None:
                            buckets[new] = [h]
                            mark(new)
                        else:
                            heappush(other, h)
                        lower = lower or new < r
            if not bucket:
                queue.drop(r)
        ids = np.array(ids, np.int32)
        left = np.r_[0, np.cumsum(ids != NONE)]
        raw = ids[ids != NONE].astype("<u4").tobytes()
        stops = (left[ends] * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def _merged(self, words: list[str]) -> dict[str, bytes]:
        found, part, size = {}, [], 0

        def flush():
            found.update(zip([w for w, _ in part], self.merge([b for _, b in part]), strict=True))

        for w in words:
            raw = w.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                found[w] = whole.to_bytes(4, "little")
                continue
            if part and size + len(raw) > QUEUED:
                flush()
                part, size = [], 0
            part.append((w, raw))
            size += len(raw)
        if part:
            flush()
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, little-endian and 32 bits each."""
        cuts = [self.find(t) for t in texts]
        if len(self.words) > MOST_WORDS:
            self.words, self.older = {}, self.words
        new = set().union(*cuts) - self.words.keys()
        again = new & self.older.keys()
        self.words.update(zip(again, map(self.older.__getitem__, again), strict=True))
        new = self._merged(list(new - again))
        self.words.update((w, x) for w, x in new.items() if len(w) <= LONGEST)
        long = {w: x for w, x in new.items() if len(w) > LONGEST}
        if long:
            return [b"".join([self.words.get(w) or long[w] for w in words]) for words in cuts]
        ids = self.words.__getitem__
        return [b"".join(map(ids, words)) for words in cuts]

    def decode(self, coded: list[bytes]) -> list[memoryview]:
        """The bytes of each list of ids, as encode gives them."""
        taken = self.tokens.take(pa.array(np.frombuffer(b"".join(coded), "<u4")))
        if taken.null_count:
            raise ValueError("an id of no token")
        stops = np.cumsum([len(x) // 4 for x in coded])
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset:]
        data = memoryview(taken.buffers()[2] or b"")
        return [data[offsets[a]:offsets[b]] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist(), strict=True)]


def encoder(path: str, pattern: str) -> RankEncoder:
    return held(("ranks", path, pattern), lambda: RankEncoder(path, pattern))


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode every whole text (null: empty) and decode its ids again.

    Returns doc_id, n_tokens long, ids_sha256 (hex; of the ids as little-endian unsigned 32-bit integers), decoded_sha256 (of the decoded
    bytes), and the ids themselves where `with_ids`. An empty text has no ids. Special tokens are ordinary text. Characters that no alternative of the pattern
    takes are left out, as the library does. Rows keep their number, repeats and null keys included. A row costs as much memory as its text, ids and decoded
    bytes hold; `path` is a file of the shared store, or a public tokenizer's bare name.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        own = encoder(path, pattern)
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                coded = own.encode(texts_of(batch.column("t")))
                columns = [
                    batch.column("k"),
                    pa.array([len(x) // 4 for x in coded], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in own.decode(coded)], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), run, fields)
