"""Benchmark decontamination by template windows.

Texts become templates: numbers, units after numbers and capitalised names turn into typed placeholders whose values are kept
as slots. Windows of the template (and, for texts whose case was changed, of the folded words with numbers as the only slots) are hashed
and joined with the benchmark's windows. Matches of one document and item that lie on one alignment must fill their slots
consistently: an item's value always stands for the same value. So a question with other numbers or names is
caught, and chance matches of common phrases with unrelated slots are not. Signs of arithmetic before a number are words of a template. An item whose
windows all hold too few words (mostly numbers) has windows of its values as they are instead, without slots, so that its copies are found. Where only some
windows hold too few words, those that are left don't stand for the whole item: what they find is spelled out, the whole item's template against the text's, token by token.

Windows that many items share (a common instruction) say little: a text must hold one of an item's rarer windows, of which any leak holds one, before all of them
are looked up.

What decides is the text alone, so equal texts are one key, whatever their ids. Items with the same windows and the same pattern of
equal slots are one template: texts are joined with templates, and only what leaks is spelled out by item.

Documents send to the join only windows whose hash hits a bitmap of the benchmark's hashes. The bitmap's size is fixed
(2 MB); with a very large benchmark it lets more windows through, and the join still decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, let_go, materialize, slices, texts_of
from .hashing import mix

#: Tokens of a window, and the literal words it must have (of a shorter item: half of its tokens).
WINDOW, LEAST_LITERAL = 8, 4
#: An item leaks where this share of its windows is found, or one alignment holds this many tokens in a row of windows.
COVERAGE, RUN = 0.8, 13
#: Share of slot pairs that one mapping of values explains.
CONSISTENT = 0.8
BITMAP_BITS = 24
MOST_WORDS = 250_000
TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d]+|[-+*/=^<>×÷](?=[\s(]{0,3}\d)")
LITERAL, NUMBER, NAME, UNIT = range(4)
# fixed values: English number words and unit names
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
UNITS = frozenset("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds s minute minutes min hour hours h day days week weeks month months year years dollar dollars cent cents euro euros usd eur gbp percent degree degrees mph kmh hz khz mhz ghz w kw v a j kj cal kcal byte bytes kb mb gb tb meter meters metre metres centimeter centimeters kilometer kilometers".split())
#: Forms of a window: typed slots, numbers as the only slots, no slots.
TYPED, FOLDED, EXACT = range(3)
WINDOWS = "row long, at int, size int, form int, hash long, slots array<string>"
ITEMS = "item_id long, template long, at int, size int, form int, hash long, slots array<int>, typed array<string>, folded array<string>, typed_codes array<long>, folded_codes array<long>"


class Templates:
    """Token tables of a task: kinds and hashes of each known token."""

    def __init__(self):
        self.forget()

    def forget(self):
        """Start anew: a task's tables are bounded."""
        self.index: dict[str, int] = {}
        self.kind, self.unit, self.typed, self.folded, self.exact = (np.empty(0, x) for x in (np.int8, bool, np.uint64, np.uint64, np.uint64))

    def learn(self, lists: list[list[str]]) -> None:
        if len(self.index) > MOST_WORDS:
            self.forget()
        new = list(set().union(*lists) - self.index.keys())
        if not new:
            return
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        low = [w.lower() for w in new]
        kind = np.array([NUMBER if w[0].isdigit() or x in NUMBERS else NAME if w[0].isupper() else LITERAL for w, x in zip(new, low, strict=True)], np.int8)
        word = np.array([xxhash.xxh64_intdigest(x, 11) for x in low], np.uint64)
        place = mix(np.arange(1, 5, dtype=np.uint64))  # the placeholders' hashes
        self.kind = np.r_[self.kind, kind]
        self.unit = np.r_[self.unit, np.array([x in UNITS for x in low], bool)]
        self.typed = np.r_[self.typed, np.where(kind == LITERAL, word, place[kind])]
        self.folded = np.r_[self.folded, np.where(kind == NUMBER, place[NUMBER], word)]
        self.exact = np.r_[self.exact, word]

    def _coded(self, texts: list[str]):
        """(tokens, text of each, first token of each text, kinds, places in the tables, typed hashes), all texts in a row."""
        lists = [TOKEN.findall(t) for t in texts]
        self.learn(lists)
        tokens = [w for x in lists for w in x]
        flat = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        lengths = np.array([len(x) for x in lists], np.int64)
        owner = np.repeat(np.arange(len(lists)), lengths)
        kind = self.kind[flat]
        unit = self.unit[flat] & np.r_[False, (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])] if len(flat) else np.empty(0, bool)
        kind = np.where(unit & (kind != NUMBER), UNIT, kind)
        typed = np.where(kind == UNIT, mix(np.array([UNIT + 1], np.uint64))[0], self.typed[flat])
        return tokens, owner, np.cumsum(lengths) - lengths, kind, flat, typed

    def codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The template of a text, token by token: typed, and folded."""
        _, _, _, _, flat, typed = self._coded([text])
        return typed.view(np.int64), self.folded[flat].view(np.int64)

    def windows(self, texts: list[str], sizes: list[int], bitmap: np.ndarray | None, exact: list[int] = ()):
        """(row, at, size, form, hash, slots) of every window of whole texts that may match.

        `sizes`: the window lengths; a text shorter than WINDOW tokens gives one window of all of them where its
        length is asked for. `exact`: the lengths of windows without slots. `bitmap`: None keeps all windows.
        """
        tokens, owner, begins, kind, flat, typed = self._coded(texts)
        literal = np.r_[0, np.cumsum(kind == LITERAL)]
        plain = np.r_[0, np.cumsum(kind != NUMBER)]
        for size in sorted({*sizes, *exact}):
            n = len(flat) - size + 1
            if n <= 0:
                continue
            inside = owner[:n] == owner[size - 1:]
            least = LEAST_LITERAL if size == WINDOW else -(-size // 2)
            forms = [(TYPED, typed, literal), (FOLDED, self.folded[flat], plain)] if size in sizes else []
            forms += [(EXACT, self.exact[flat], None)] if size in exact else []
            for form, codes, words in forms:
                h = np.zeros(n, np.uint64)
                for k in range(size):
                    h = h * np.uint64(0x100000001B3) + codes[k: k + n]
                h = mix(h ^ np.uint64(size << 2 | form))
                keep = inside if form == EXACT else inside & (words[size:] - words[:n] >= least)
                if bitmap is not None:
                    bit = (h & np.uint64((1 << BITMAP_BITS) - 1)).astype(np.int64)
                    keep = keep & (bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
                for i, hashed in zip(np.flatnonzero(keep).tolist(), h[keep].view(np.int64).tolist(), strict=True):
                    slots = [f"{kind[j]}:{tokens[j].lower()}" for j in range(i, i + size) if (kind[j] == NUMBER if form == FOLDED else kind[j] != LITERAL)] if form != EXACT else []
                    yield int(owner[i]), i - int(begins[owner[i]]), size, form, hashed, slots


def item_windows(benchmark: DataFrame) -> DataFrame:
    """ITEMS: the windows of every item (WINDOW tokens, or all of a shorter one), exact ones where there are no others; null and empty texts have none.

    template names the windows and which of their slots are equal; slots are numbers into the item's values of that form. typed_codes and folded_codes spell the
    template of an item of which some windows are left out (and belong to its name), else they are null.
    """

    def run(batches):
        let_go()
        own = Templates()
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), *[pa.list_(pa.string())] * 2, *[pa.list_(pa.int64())] * 2)
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("k").to_pylist(), texts_of(batch.column("t")), strict=True):
                if not (n := len(TOKEN.findall(text))):
                    continue
                size = [min(n, WINDOW)]
                found = list(own.windows([text], size, None)) or list(own.windows([text], [], None, size))
                values: dict[int, dict[str, int]] = {form: {} for form in (TYPED, FOLDED, EXACT)}
                named = [(*w[1:5], [values[w[3]].setdefault(x, len(values[w[3]])) for x in w[5]]) for w in found]
                codes = [x.tolist() for x in own.codes(text)] if len({w[1] for w in found}) < n - size[0] + 1 else [None, None]
                template = xxhash.xxh64_intdigest(repr((named, codes[0]) if codes[0] else named)) - (1 << 63)
                rows += [(key, template, *w, list(values[TYPED]), list(values[FOLDED]), *codes) for w in named]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in ITEMS.split(", ")])

    return in_arrow(benchmark.select(F.col("item_id").cast("long").alias("k"), F.col("text").alias("t")), run, ITEMS)


def text_windows(docs: DataFrame, sizes: list[int], exact: list[int], bitmap) -> DataFrame:
    """WINDOWS of every text, `row` being its 64-bit hash, that hit the bitmap. Equal texts give each window once."""

    def run(batches):
        let_go()
        own = Templates()
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                rows = batch.column("row").to_pylist()
                found = [(rows[w[0]], *w[1:]) for w in own.windows(texts_of(batch.column("t")), sizes, bitmap.value, exact)]
                columns = list(zip(*found, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in WINDOWS.split(", ")])

    rows = docs.filter("text is not null").select(F.xxhash64("text").alias("row"), F.col("text").alias("t"))
    return in_arrow(rows, run, WINDOWS).dropDuplicates(["row", "form", "size", "at"])


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row per (row, template) that leaks, `row` being the text's hash: windows, matched, coverage, longest, slots, consistency, form, pairs."""
    spark = docs.sparkSession
    asked = items.select("size", (F.col("form") == EXACT).alias("plain")).distinct().collect()  # at most 2 x WINDOW rows
    sizes, exact = (sorted(r.size for r in asked if r.plain == which) for which in (False, True))
    bits = np.zeros(1 << BITMAP_BITS, bool)
    low = items.select(F.col("hash").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1)).cast("int").alias("bit")).distinct()
    bits[low.toArrow().column("bit").to_numpy()] = True  # at most 2**BITMAP_BITS numbers, whatever the benchmark's size
    bitmap = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))
    found = text_windows(docs, sizes, exact, bitmap).select("row", "hash", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    wanted = materialize(items.select("template", "at", "size", "form", "hash", "slots").distinct(), "windows")
    found = materialize(found, "hits")
    held = found.join(_telling(wanted), "hash").select("row", "template").distinct()
    pairs = found.join(held, "row").join(wanted, ["template", "hash"])
    filled = F.flatten(F.collect_list(F.arrays_zip("slots", "doc_slots")))
    lined = pairs.groupBy("row", "template", "form", (F.col("doc_at") - F.col("at")).alias("shift")).agg(
        F.sort_array(F.collect_set("at")).alias("ats"), F.first("size").alias("size"), F.array_distinct(filled).alias("pairs"),
    )  # an alignment has at most as many windows as the item
    values = F.array_distinct(F.col("pairs.slots"))  # one way: several values of the item may coincide in the text
    share = F.when(F.size("pairs") == 0, 1.0).otherwise(F.size(values) / F.size("pairs"))
    lined = lined.withColumn("consistency", share).filter(F.col("consistency") >= CONSISTENT)
    lined = lined.withColumn("span", F.size("ats") + F.col("size") - 1)
    best = F.max_by(F.struct("form", "pairs"), F.struct("span", "consistency", -F.col("form"), -F.col("shift")))
    per_pair = lined.groupBy("row", "template").agg(
        F.max("span").alias("longest"), F.max(F.size("pairs")).alias("slots"), F.max("consistency").alias("consistency"), best.alias("best")
    )
    covered = lined.select("row", "template", F.explode("ats").alias("at")).distinct().groupBy("row", "template").agg(F.count(F.lit(1)).alias("matched"))
    per_item = wanted.groupBy("template").agg(F.countDistinct("at").alias("windows"))
    out = per_pair.join(covered, ["row", "template"]).join(per_item, "template").withColumn("coverage", F.col("matched") / F.col("windows"))
    out = out.filter((F.col("coverage") >= COVERAGE) | (F.col("longest") >= RUN))
    out = out.select("row", "template", "windows", "matched", "coverage", "longest", "slots", "consistency", "best.form", "best.pairs")
    whole = items.filter("typed_codes is not null").select("template", "typed_codes", "folded_codes").dropDuplicates(["template"])
    if whole.isEmpty():
        return out
    out, whole = materialize(out, "candidates"), materialize(whole, "spelled")
    lines = lined.select("row", "template", "form", "shift").join(out.select("row", "template"), ["row", "template"], "left_semi").join(whole, "template")
    shares = _spelled_out(docs, materialize(lines, "lines"))
    out = out.join(whole.select("template", F.lit(True).alias("partial")), "template", "left").join(shares, ["row", "template"], "left")
    out = out.withColumn("coverage", F.when(F.col("partial"), F.coalesce("share", F.lit(0.0))).otherwise(F.col("coverage")))
    return out.filter((F.col("coverage") >= COVERAGE) | (F.col("longest") >= RUN)).drop("partial", "share")


def _telling(wanted: DataFrame) -> DataFrame:
    """(template, hash) without the windows of each template that most other templates share, as many as a leak can do without.

    A leak holds COVERAGE of an item's windows, or as many of one alignment as RUN tokens have; so it holds one of any set that leaves out fewer than both.
    """
    shared = wanted.groupBy("hash").agg(F.countDistinct("template").alias("templates"))
    places = wanted.select("template", "at").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("windows"))
    at = wanted.join(shared, "hash").groupBy("template", "at", "size").agg(F.max("templates").alias("templates"))
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.desc("templates"), "at"))
    spare = F.least(F.lit(RUN) - F.col("size"), F.ceil(F.col("windows") * COVERAGE - 1e-9) - 1)
    kept = at.join(places, "template").withColumn("rank", rank).filter((F.col("rank") > spare) | (F.col("templates") == 1)).select("template", "at")
    return wanted.join(kept, ["template", "at"], "left_semi").select("template", "hash").distinct()


def _spelled_out(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(row, template, share): of the alignments (row, template, form, shift, typed_codes, folded_codes) the largest share of the item's tokens that the text has in its template."""
    asked = lines.groupBy("row").agg(F.collect_list(F.struct("template", "form", "shift", "typed_codes", "folded_codes")).alias("asked"))  # alignments of one text with windows of such items
    texts = docs.filter("text is not null").select(F.xxhash64("text").alias("row"), F.col("text").alias("t")).join(lines.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])

    def run(batches):
        let_go()
        own = Templates()
        for whole in batches:
            for batch in slices(whole, "t", 1 << 20):
                out = []
                for row, text, asked in zip(batch.column("row").to_pylist(), texts_of(batch.column("t")), batch.column("asked").to_pylist(), strict=True):
                    theirs = own.codes(text)
                    for a in asked:
                        mine, here = (a["folded_codes"], theirs[1]) if a["form"] == FOLDED else (a["typed_codes"], theirs[0])
                        begin = max(0, -a["shift"])
                        end = max(begin, min(len(mine), len(here) - a["shift"]))
                        same = np.count_nonzero(np.array(mine[begin:end], np.int64) == here[begin + a["shift"]: end + a["shift"]])
                        out.append((row, a["template"], float(same / len(mine))))
                columns = list(zip(*out, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["row", "template", "share"])

    return in_arrow(texts.join(asked, "row"), run, "row long, template long, share double").groupBy("row", "template").agg(F.max("share").alias("share"))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per (doc_id, item_id) that leaks: windows, matched, coverage, longest, slots, consistency, reparametrized.

    windows is the item's number of windows, matched how many of them the document holds on consistent alignments, coverage the share of these, or, for an item
    of which some windows hold too few words, the share of its tokens that one alignment has in its template; longest the tokens that the
    windows of the best alignment would hold in a row, reparametrized whether some slot of that alignment has another value than the item's. Rows of
    one doc_id count as one document (its best row for each column), equal items each have their rows; null texts match nothing, and
    documents without an id have no row. Empty tables give an empty result. Texts are told apart by 64-bit hashes.
    """
    items = materialize(item_windows(benchmark), "items")
    found = materialize(matches(docs, items), "leaks")
    named = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row")).join(found, "row")
    members = items.select("template", "item_id", "typed", "folded").filter("item_id is not null").distinct()
    each = named.join(members, "template")  # what leaks, by item
    own = F.when(F.col("form") == TYPED, F.col("typed")).otherwise(F.col("folded"))
    each = each.withColumn("own", own).withColumn("changed", F.expr("exists(pairs, p -> p.doc_slots <> own[p.slots])"))
    return each.groupBy("doc_id", "item_id").agg(
        F.max("windows").alias("windows"), F.max("matched").alias("matched"), F.max("coverage").alias("coverage"), F.max("longest").alias("longest"),
        F.max("slots").alias("slots"), F.max("consistency").alias("consistency"), F.min("changed").alias("reparametrized"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with all their columns. Decided by each row's text alone: a clean row stays though another
    of its doc_id leaks, a leaking one goes though it has no id, and null texts stay."""
    bad = materialize(matches(docs, materialize(item_windows(benchmark), "items")).select("row").distinct(), "leaking")
    return docs.join(bad, docs["text"].isNotNull() & (F.xxhash64(docs["text"]) == bad["row"]), "left_anti")
