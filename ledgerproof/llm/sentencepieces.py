"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's symbols start as characters. An agenda holds the adjacent pairs whose join is a piece; the
pair of highest score merges first, leftmost on ties, until no pair is left. What is still no piece is
spelled in byte pieces. The agenda runs over many words at once: each step takes the best pair of every word
from a flat array of pair ranks, merges it, and ranks only the pairs that changed.

Merges never cross a place where no piece holds the two characters side by side; texts are cut
there (before a run of word marks, and around line ends), so that equal words are merged once and kept in
two bounded tables: a full one becomes the older, and what is met again moves back. New words are checked against the sentencepiece library batch by
batch, so every id of the result belongs to a word that the library encodes alike; `check="texts"` compares every whole text's ids too,
which costs as much again as the library's own encoding.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, held, in_arrow, slices, texts_of, vocabulary

MARK = "▁"
#: Words of each of the two tables that a task's process keeps between batches; words merged at once.
MOST_WORDS, AT_ONCE = 250_000, 25_000
NONE = np.iinfo(np.int32).max


class MergeEncoder:
    """Own encoder and decoder for one vocabulary file; the library serves as the check."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary(path))
        n = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        if any(lib.is_unused(i) for i in range(n)) or lib.normalize("a  ﬁ ") != f"{MARK}a{MARK}{MARK}ﬁ{MARK}":
            raise ValueError("the vocabulary has unused pieces or rewrites its texts: only plain merge-type vocabularies are read")
        special = {i for i in range(n) if lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i)}
        self.bytes = {lib.id_to_piece(i): i for i in special if lib.is_byte(i)}
        self.byte_ids = np.array([self.bytes.get(f"<0x{b:02X}>", lib.unk_id()) for b in range(256)])
        self.normal = {p: i for i, p in enumerate(pieces) if i not in special}
        inner = {a + b for p in self.normal for a, b in zip(p, p[1:], strict=False)}
        if any(x[1] == MARK and x[0] != MARK for x in inner):
            raise ValueError("a piece goes on past a word mark: words can't be merged on their own")
        alone = "".join(c for c in "\n\r\t" if not any(c in x for x in inner))
        self.alone = np.array([ord(c) for c in alone], np.uint8)
        # symbols: vocabulary ids, then the characters that stand only inside pieces, then one for all others
        self.symbols = dict(self.normal)
        self.spelled = list(pieces)
        for c in sorted({c for p in self.normal for c in p} - self.symbols.keys()):
            self.symbols[c] = len(self.spelled)
            self.spelled.append(c)
        self.vocabulary, self.other = n, len(self.spelled)
        ranked = sorted(self.normal.values(), key=lambda i: -lib.get_score(i))
        scores, rank, at = [lib.get_score(i) for i in range(n)], {}, -1
        for k, i in enumerate(ranked):  # equal scores share a rank: the leftmost goes first
            at = at if k and scores[i] == scores[ranked[k - 1]] else k
            rank[i] = at
        keys, ranks, ids = [], [], []
        for p, i in self.normal.items():
            for k in range(1, len(p)):
                a, b = self.symbols.get(p[:k]), self.symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(rank[i])
                    ids.append(i)
        self._file(np.array(keys, np.int64), np.array(ranks, np.int32), np.array(ids, np.int64))
        self.of_char = np.full(0x110000, self.other, np.int64)
        for c, i in self.symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        # a text of one cut, after which another begins: what a cut without a mark is checked behind
        self.lead = (alone[0], list(lib.encode(alone[0]))) if alone else None
        self.numerals = [str(i) for i in range(n)]
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.words: dict[bytes, bytes] = {}  # cuts in UTF-8 with blanks for marks, and their packed ids
        self.older: dict[bytes, bytes] = {}

    def _file(self, keys: np.ndarray, ranks: np.ndarray, ids: np.ndarray) -> None:
        """File the pairs by a hash of both symbols, each in the next free place: three of four places stay free."""
        self.places = 1 << (4 * len(keys)).bit_length()
        self.keys, self.ranks, self.joined = np.full(self.places, -1, np.int64), np.full(self.places, NONE, np.int32), np.zeros(self.places, np.int64)
        left, at = np.arange(len(keys)), self._place(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            places, first = np.unique(at[free], return_index=True)
            mine = left[free[first]]
            self.keys[places], self.ranks[places], self.joined[places] = keys[mine], ranks[mine], ids[mine]
            rest = np.ones(len(left), bool)
            rest[free[first]] = False
            left, at = left[rest], at[rest] + 1 & self.places - 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - self.places.bit_length())).view(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the pairs (NONE where their join is no piece) and the ids of the joins."""
        key = a << 32 | b
        at = self._place(key)
        found = self.keys[at]
        on = np.flatnonzero((found != key) & (found >= 0))  # places of other pairs
        while len(on):
            at[on] = at[on] + 1 & self.places - 1
            found = self.keys[at[on]]
            on = on[(found != key[on]) & (found >= 0)]
        return self.ranks[at], self.joined[at]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (a cut of a normalised text), all agendas run in step."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), lengths)
        codes = self.of_char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        where = np.arange(len(codes))  # the first character of each symbol
        done: list[tuple[np.ndarray, np.ndarray]] = []
        follows = np.r_[owner[1:] == owner[:-1], False]
        rank, join = self._rank(codes, np.r_[codes[1:], 0])
        rank = np.where(follows, rank, NONE)
        while len(codes):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(codes)])
            if (best == NONE).any():  # their agendas are empty
                over = np.repeat(best == NONE, sizes)
                done.append((where[over], codes[over]))
                codes, owner, where, rank, join = codes[~over], owner[~over], where[~over], rank[~over], join[~over]
                sizes, best = sizes[best != NONE], best[best != NONE]
                if not len(codes):
                    break
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            first = hits[np.r_[True, owner[hits[1:]] != owner[hits[:-1]]]]  # the leftmost of each word
            codes[first] = join[first]
            keep = np.ones(len(codes), bool)
            keep[first + 1] = False
            moved = first - np.arange(len(first))  # each earlier merge took one symbol away
            codes, owner, where, rank, join = codes[keep], owner[keep], where[keep], rank[keep], join[keep]
            fresh = np.r_[moved, moved[moved > 0] - 1]
            after = np.minimum(fresh + 1, len(codes) - 1)
            r, j = self._rank(codes[fresh], codes[after])
            rank[fresh] = np.where((after > fresh) & (owner[after] == owner[fresh]), r, NONE)
            join[fresh] = j
        where, codes = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(where, kind="stable")
        where, codes = where[order], codes[order]
        owner = np.repeat(np.arange(len(words)), lengths)[where]
        bounds = np.searchsorted(owner, np.arange(len(words) + 1)).tolist()
        ids, odd = codes.tolist(), codes >= self.vocabulary
        if not odd.any():
            return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        starts, out = np.r_[0, np.cumsum(lengths)].tolist(), []
        strange = set(owner[odd].tolist())
        for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            if n not in strange:
                out.append(ids[a:b])
                continue
            got: list[int] = []
            for k in range(a, b):
                if ids[k] < self.vocabulary:
                    got.append(ids[k])
                else:
                    got += self.byte_ids[list(words[n][int(where[k]) - starts[n]].encode())].tolist()
            out.append(got)
        return out

    def cuts(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct cuts of all texts (blanks are marks), the number of each cut in turn, and how many cuts end with each text.

        A text is given a mark in front. A cut is one character that stands alone, or a run of marks and what follows it up to the next mark or such a character.
        """
        raw = [f" {t.replace(MARK, ' ')}".encode() if t else b"" for t in texts]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        buffer = b"".join(raw)
        data = np.frombuffer(buffer, np.uint8)
        alone, blank = np.isin(data, self.alone), data == ord(" ")
        begins = alone.copy()
        begins[1:] |= alone[:-1] | blank[1:] & ~blank[:-1]
        starts = np.r_[0, ends[:-1]]
        begins[starts[starts < ends]] = True
        at = np.flatnonzero(begins)
        offsets = np.r_[at, len(data)].astype(np.int32)
        found = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)]).dictionary_encode()
        return found.dictionary.to_pylist(), found.indices.to_numpy(), np.searchsorted(at, ends)

    def learn(self, words: list[bytes]) -> None:
        """Merge those of distinct words that are in no table yet, and check them against the library; all words are in the newer table then."""
        if len(self.words) > MOST_WORDS:
            self.words, self.older = {}, self.words
        new = [w for w, x in zip(words, map(self.words.get, words), strict=True) if x is None]
        old = list(map(self.older.get, new))
        self.words.update((w, x) for w, x in zip(new, old, strict=True) if x is not None)
        for part in chunked((w for w, x in zip(new, old, strict=True) if x is None), AT_ONCE):
            marked = [w.decode().replace(" ", MARK) for w in part]
            ids = self.merge(marked)
            self._check_words(marked, ids)
            raw = np.fromiter(chain.from_iterable(ids), self.kind).tobytes()
            ends = (np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) * self.kind.itemsize).tolist()
            self.words.update(zip(part, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def _check_words(self, words: list[str], ids: list[list[int]]) -> None:
        """Every word's ids must be the library's. It puts a mark before a text, so a word that begins with a mark is given without it.

        Any other cut (after a line end, or a line end itself) follows a lead that the mark goes to; runs of marks are blanks of the lead's end.
        """
        texts, want, lead = [], [], self.lead
        for w, x in zip(words, ids, strict=True):
            marked = w[0] == MARK and len(w) > 1
            if not marked and lead is None:
                continue
            texts.append(w[1:] if marked else lead[0] + w)
            want.append(x if marked else lead[1] + x)
        if want != self.library.encode(texts, num_threads=1):
            bad = next(t for t, x in zip(texts, want, strict=True) if x != self.library.encode(t))
            raise AssertionError(f"the merges of {bad!r} differ from the library's")

    def coded(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """The ids of all whole texts in a row, and where each text's begin and end."""
        words, cut, stops = self.cuts(texts)
        self.learn(words)
        packed = list(map(self.words.__getitem__, words))
        sizes = np.fromiter(map(len, packed), np.int32, len(packed)) // self.kind.itemsize
        begins, n = (np.cumsum(sizes, dtype=np.int32) - sizes)[cut], sizes[cut]
        ends = np.cumsum(n, dtype=np.int32)
        bounds = np.r_[0, np.r_[0, ends][stops]].tolist()
        flat = np.frombuffer(b"".join(packed), self.kind)
        return flat[np.repeat(begins - (ends - n), n) + np.arange(bounds[-1], dtype=np.int32)], bounds

    def encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """(ids, the ids in decimal joined by commas) of each whole text."""
        ids, bounds = self.coded(texts)
        each = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
        return [(x, self.spelling(x)) for x in each]

    def spelling(self, ids: list[int]) -> str:
        return ",".join(map(self.numerals.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces joined, runs of byte pieces read as UTF-8, marks as blanks but for the first."""
        raw = bytearray()
        for i in ids:
            p = self.spelled[i]
            raw += bytes([int(p[3:5], 16)]) if p in self.bytes else p.replace(MARK, " ").encode()
        text = raw.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encoder(path: str) -> MergeEncoder:
    return held(("pieces", path), lambda: MergeEncoder(path))


def encode_documents(docs: DataFrame, path: str, check: str = "words", text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode every whole text (null: empty) and decode its ids again.

    Returns doc_id, n_tokens long, ids_sha256 and decoded_sha256 (hex; of the decimal ids joined by commas, and of the decoded
    text), and the ids themselves where `with_ids`. An empty text has no ids and decodes to itself.
    `check`: "texts" compares all ids of each text with the library's and "words" those of new words (cuts of any kind); a
    difference ends the job. Rows keep their number, repeats and null keys included.
    """
    if check not in ("texts", "words"):
        raise ValueError("check is texts or words")
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        own = encoder(path)
        for whole in batches:
            for batch in slices(whole, "t", 4 << 20):
                texts = texts_of(batch.column("t"))
                flat, bounds = own.coded(texts)
                spelled, decoded = [], []
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):  # a text at a time: lists of ids are large
                    ids = flat[a:b].tolist()
                    if check == "texts" and ids != own.library.encode(texts[k]):
                        raise AssertionError("the ids of a text differ from the library's")
                    spelled.append(hashlib.sha256(own.spelling(ids).encode()).hexdigest())
                    decoded.append(hashlib.sha256(own.library.decode(ids).encode()).hexdigest())
                columns = [batch.column("k"), pa.array(np.diff(bounds), pa.int64()), pa.array(spelled, pa.string()), pa.array(decoded, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return in_arrow(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), run, fields)
