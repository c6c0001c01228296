"""Spelling variants: words within one edit of a much more frequent word.

Words are counted per document and added up. Two words within one edit, of equal length or one longer than the other, share one of two halves: the
shorter word (length n) is cut evenly after n // 2 code points, the edit lies in one half, and the other stands unchanged in the longer word, in front at the same place, at the
end moved by the difference of lengths. So each word files its two halves under (its length, which half, the half), and asks there for its own length and for words one
shorter, two questions each; no pair is missed. A pair found by both halves counts at the front one only. What meets is tested in the join: parities
of letters first, then the edit distance, so only near pairs leave it. Keys that hold many words are dealt to several tasks by what they hold.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, let_go, materialize

#: Distinct words that a task adds up before it hands them on.
MOST_WORDS = 200_000
#: Words of one half that one part of the join holds; a half with more is dealt to several parts.
HALF_WORDS = 2_000
# a byte of Latin-1 to its lower-case letter (A-Z only), anything that is no letter of A-Z, a-z, U+00C0-U+00FF to a blank
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters of a text, in Latin-1 (what that can't hold is no letter here), A-Z lower-cased."""
    return text.encode("latin-1", "replace").translate(LETTERS).split()


def slipped(run: bytes, lead: int, every: int) -> bytes:
    """The run, less one code point where `every` divides the crc32 of the lead's text and the run in UTF-8."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), lead)
    return run if h % every else run[: h % len(run)] + run[h % len(run) + 1:]


def counts(docs: DataFrame, every: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n long): the words of whole texts, of which one run in `every` loses a code point, that are long and frequent enough.

    Null texts hold no words; a null id is the empty text in the hash. Each row counts, repeated ids and texts too. Memory: a text's words, and MOST_WORDS more.
    """

    def batch(table):
        words = [w.decode("latin-1") for w in table]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(table.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        let_go()
        table: dict[bytes, int] = {}
        for part in batches:
            for key, text in zip(part.column("k").to_pylist(), part.column("t").to_pylist(), strict=True):
                lead = zlib.crc32(b":" if key is None else b"%d:" % key)
                for word, n in Counter(runs(text or "")).items():
                    word = slipped(word, lead, every)
                    if len(word) >= least_length:
                        table[word] = table.get(word, 0) + n
                if len(table) > MOST_WORDS:
                    yield batch(table)
                    table = {}
        if table:
            yield batch(table)

    rows = docs.select(F.col("doc_id").cast("long").alias("k"), F.col("text").alias("t"))
    return in_arrow(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def near_pairs(words: DataFrame) -> DataFrame:
    """(u, v, nu, nv): each pair of different words within one edit, once. `words` is a written table (word, n) of distinct words of two code points or more."""
    parity = lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64))
    letters = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), parity)
    sized = words.select("word", "n", F.char_length("word").alias("size"), letters.alias("letters"))
    half = F.floor(F.col("length") / 2).cast("int")

    def halves(rows: DataFrame, moved: int) -> DataFrame:
        """The halves of words of `length` code points as they stand in words that are `moved` longer."""
        ends = F.array(F.struct(F.lit(0).alias("end"), F.substring("word", F.lit(1), half).alias("part")), F.struct(F.lit(1).alias("end"), F.substring("word", half + 1 + moved, F.col("length") - half).alias("part")))
        return rows.withColumn("length", F.col("size") - moved).withColumn("half", F.explode(ends)).select("length", "half.end", "half.part", "word", "n", "letters")

    filed = halves(sized, 0)
    asked = filed.withColumn("moved", F.lit(0)).unionByName(halves(sized.filter("size > 2"), 1).withColumn("moved", F.lit(1)))
    key = ["length", "end", "part"]
    # keys of many words: their filed words are dealt to parts, and who asks there asks every part
    many = materialize(filed.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > HALF_WORDS).select(*key, F.ceil(F.col("held") / HALF_WORDS).cast("int").alias("parts")), "halves")
    filed = filed.join(many, key, "left").withColumn("dealt", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("word"), F.col("parts"))).cast("int")).drop("parts")
    asked = asked.join(many, key, "left").withColumn("dealt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    f, a = filed.alias("f"), asked.alias("a")
    met = [F.col(f"f.{c}") == F.col(f"a.{c}") for c in [*key, "dealt"]]
    first = F.floor(F.col("f.length") / 2).cast("int")
    once = F.when(F.col("a.moved") == 0, F.col("f.word") < F.col("a.word")).otherwise((F.col("f.end") == 0) | (F.substring("f.word", F.lit(1), first) != F.substring("a.word", F.lit(1), first)))
    near = (F.bit_count(F.col("f.letters").bitwiseXOR(F.col("a.letters"))) <= 2) & (F.levenshtein("f.word", "a.word", 1) == 1)
    test = met[0]
    for more in [*met[1:], once, near]:
        test = test & more
    return f.join(a, test).select(F.col("f.word").alias("u"), F.col("a.word").alias("v"), F.col("f.n").alias("nu"), F.col("a.n").alias("nv"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word that has a form, `forms` being a written table (word, form) without cycles: pointers double until none moves."""
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = materialize(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.filter("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root string, n, n_near, form_n long, a row for each word (see counts).

    n_near: the words within one edit. form: the most frequent of them (ties: the least in code-point order) where it occurs `times` times as often as
    the word or more, form_n its n; null without one. root: where following forms ends, the word itself without a form. Counts at least double with
    each form, so chains are short and never close. An empty table gives no rows.
    """
    if times < 2:
        raise ValueError("times is 2 or more: forms must lead to more frequent words")
    words = materialize(counts(docs), "words")
    pairs = materialize(near_pairs(words), "near")
    both = pairs.select(F.col("u").alias("word"), F.struct((-F.col("nv")).alias("less"), F.col("v").alias("form")).alias("other"))
    both = both.unionByName(pairs.select(F.col("v").alias("word"), F.struct((-F.col("nu")).alias("less"), F.col("u").alias("form")).alias("other")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    named = words.join(near, "word", "left")
    good = -F.col("best.less") >= times * F.col("n")
    named = materialize(named.select("word", F.when(good, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, -F.col("best.less")).alias("form_n")), "forms")
    ends = roots(named.filter("form is not null").select("word", "form"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
