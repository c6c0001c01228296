"""SimHash near-duplicates, compared in vertical bit planes.

Distinct fingerprints only are compared. Two fingerprints within the radius agree on a good part of
their bits, so each one is filed under several keys made of some of its blocks (pigeonhole: with
`radius + 2` blocks, any two within the radius agree on two blocks). A key that too many fingerprints share is filed
again under finer keys; no pair is lost at any depth, and the deepest keys leave so few free bits that
their number of distinct fingerprints is bounded. Inside a key the free bits are stored vertically,
64 fingerprints to a word; for each query word-by-word XORs feed carry-save counters that hold many
distances at once, and words whose lanes have all passed the radius are dropped.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_texts, first_rows, in_arrow, let_go, materialize, slices
from .components import components, roots_of

#: Fingerprints a key may hold before it is filed again under finer keys.
MOST_IN_KEY = 4096
#: Shingles whose bits are counted at once.
SHINGLES_AT_ONCE = 1 << 16
#: (query, word) cells compared at once.
CELLS_AT_ONCE = 1 << 19
ONE, ALL = np.uint64(1), ~np.uint64(0)


def fingerprint(text: bytes, size: int) -> int:
    """64 bits, each 1 where over half of the shingles' XXH64 (seed 42) have it set.

    Words are runs of bytes other than ASCII white space, A-Z in lower case; shingles are `size` words
    joined by spaces, repeats included; a shorter text is one shingle; no word gives 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    starts, stops = begins[: len(words) - size + 1].tolist(), ends[size - 1:].tolist()
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        h = [digest(line[a:b], 42) for a, b in zip(starts[at: at + SHINGLES_AT_ONCE], stops[at: at + SHINGLES_AT_ONCE], strict=True)]
        bits = np.unpackbits(np.array(h, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id long, fp long: the 64 bits as a signed number, h long: the text's xxhash64) for every row; a null text has no words."""

    def run(batches):
        let_go()
        for whole in batches:
            for batch in slices(whole, "t", 2 << 20):
                fps = np.array([fingerprint(t, size) for t in binary_texts(batch.column("t"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(fps), batch.column("h")], names=["doc_id", "fp", "h"])

    return in_arrow(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("h")), run, "doc_id long, fp long, h long")


def near_in_words(bits: np.ndarray, last: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j < last[i], with at most `radius` differing bits.

    Row i is compared with the rows after it up to last[i] (the end of its key's run).
    """
    n = len(bits)
    planes_n = max(1, int(np.bitwise_or.reduce(bits, initial=np.uint64(0))).bit_length())
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = bits
    lanes = padded.reshape(words, 64)
    shift = np.arange(64, dtype=np.uint64)
    planes = [np.bitwise_or.reduce(((lanes >> np.uint64(b)) & ONE) << shift, axis=1) for b in range(planes_n)]
    rows = np.arange(n)
    first_word, last_word = (rows + 1) // 64, (last - 1) // 64
    spans = np.where(last - 1 > rows, last_word - first_word + 1, 0)
    digits = max(1, int(radius).bit_length())
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    upto = np.cumsum(spans)
    begin = 0
    while begin < n:
        base = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, base + CELLS_AT_ONCE, "right")))
        span = spans[begin:end]
        q = np.repeat(rows[begin:end], span)
        w = np.repeat(first_word[begin:end], span) + np.arange(len(q)) - np.repeat(np.cumsum(span) - span, span)
        low, high = q + 1 - w * 64, last[q] - w * 64  # the lanes of this word that belong to the query's key
        alive = np.where(low > 0, ALL << np.clip(low, 0, 63).astype(np.uint64), ALL)
        alive &= np.where(high < 64, ~(ALL << np.clip(high, 0, 63).astype(np.uint64)), ALL)
        counters = [np.zeros(len(q), np.uint64) for _ in range(digits)]
        for b in range(planes_n):
            carry = planes[b][w] ^ np.where((bits[q] >> np.uint64(b)) & ONE == ONE, ALL, np.uint64(0))
            for k in range(digits):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            alive &= ~carry  # the counters ran over
            beyond = np.zeros(len(q), np.uint64)  # lanes whose counter is above the radius
            equal = np.full(len(q), ALL)
            for k in reversed(range(digits)):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    beyond |= equal & counters[k]
                    equal &= ~counters[k]
            alive &= ~beyond
            if b % 4 == 3 or b == planes_n - 1:
                keep = alive != 0
                if not keep.all():
                    q, w, alive = q[keep], w[keep], alive[keep]
                    counters = [c[keep] for c in counters]
                if not len(q):
                    break
        if len(q):
            cell, lane = np.nonzero(np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            left.append(q[cell])
            right.append(w[cell] * 64 + lane)
        begin = end
    return np.concatenate(left), np.concatenate(right)


def _compare(batches, radius: int):
    """Stars over the near fingerprints of each key; rows come sorted by key, a key may span batches."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["bucket"].to_numpy()
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        last = np.repeat(np.r_[starts[1:], len(key)], np.diff(np.r_[starts, len(key)]))
        i, j = near_in_words(pdf["rest"].to_numpy().view(np.uint64), last, radius)
        fp, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
        true = np.bitwise_count(fp[i] ^ fp[j]) <= radius  # two keys may share a hash
        i, j = i[true], j[true]
        nodes, root = roots_of(rep[i], rep[j]) if len(i) else (rep[:0], rep[:0])
        return pd.DataFrame({"u": nodes, "v": root})[lambda x: x.u != x.v]

    held = None
    for pdf in batches:
        if not len(pdf):
            continue
        held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        key = held["bucket"].to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        if cut:
            yield links(held.iloc[:cut].reset_index(drop=True))
            held = held.iloc[cut:].reset_index(drop=True)
    if held is not None:
        yield links(held)


def _cut(width: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of the parts of `width` bits."""
    edges = [width * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _bits(column, offset: int, width: int):
    moved = F.shiftrightunsigned(column, offset)
    return moved if width == 64 else moved.bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _file(rows: DataFrame, width: int, radius: int, agree: int) -> tuple[DataFrame, int]:
    """File rows (bucket, rest, rep) under finer keys: `agree` equal parts of radius + agree. (rows, free bits)."""
    parts, options = _cut(width, radius + agree), []
    for n, chosen in enumerate(combinations(range(len(parts)), agree)):
        rest, at = F.lit(0).cast("long"), 0
        for k, (o, w) in enumerate(parts):
            if k not in chosen:
                rest, at = rest.bitwiseOR(F.shiftleft(_bits(F.col("rest"), o, w), at)), at + w
        key = F.xxhash64("bucket", F.lit(n), *[_bits(F.col("rest"), *parts[k]) for k in chosen])
        options.append(F.struct(key.alias("bucket"), rest.alias("rest")))
    free = max(sum(w for k, (_, w) in enumerate(parts) if k not in chosen) for chosen in combinations(range(len(parts)), agree))
    return rows.select("fp", "rep", F.explode(F.array(*options)).alias("x")).select("x.bucket", "x.rest", "fp", "rep"), free


def near_fingerprints(fps: DataFrame, radius: int = 2, most: int = MOST_IN_KEY) -> DataFrame:
    """(u long, v long): links that connect exactly the rows (fp, rep) that chains of near fingerprints connect.

    Row pairs within the radius are found by the keys of the module's notes, so none is missed. Keys
    are 64-bit hashes of the equal blocks and the choice of blocks: two keys that collide only cost a
    comparison, since distances are counted over the free bits of rows and checked again over all bits.
    """
    rows = fps.select(F.lit(0).cast("long").alias("bucket"), F.col("fp").alias("rest"), "fp", "rep")
    levels, width = [], 64
    for level in range(4):
        filed, width = _file(rows, width, radius, 2 if level == 0 else 1)
        filed = materialize(filed, f"keys{level}")
        counts = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        last = level == 3 or width <= max(12, radius)
        chosen = filed.join(counts if last else counts.filter(F.col("n") <= most), "bucket").select("bucket", "rest", "fp", "rep")
        levels.append(chosen)
        hot = counts.filter(F.col("n") > most)
        if last or hot.isEmpty():
            break
        rows = filed.join(hot, "bucket").select("bucket", "rest", "fp", "rep")
    out = None
    for chosen in levels:
        part = chosen.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(lambda batches: _compare(batches, radius), "u long, v long")
        out = part if out is None else out.unionByName(part)
    return out


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id long, fingerprint string, component_id long, h long: the text's xxhash64), one row for each row of `docs`.

    component_id is the least doc_id that chains of fingerprints within `radius` bits reach, the row's
    own included. Equal fingerprints are one node, so copies cost one comparison. A null or blank text
    has fingerprint zero, which links like any other. Rows repeated in `docs` are repeated here. A null
    doc_id stays null and can't name a component unless its whole component has no id.
    """
    prints = materialize(fingerprints(docs, size, text, key), "prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    named = nodes.filter("rep is not null")
    links = components(near_fingerprints(named, radius))
    classes = nodes.join(links, nodes.rep == links.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex(F.col("fp")), 16, "0"))
    return prints.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id", "h")


def kept(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """One row of each class of near duplicates (see first_rows for which one), with all its columns. Rows without an id stay."""
    return first_rows(docs, near_duplicates(docs, size, radius))
