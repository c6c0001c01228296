"""Template windows against a plain version: tokens, windows, alignments and slots by loops."""

import random

from ledgerproof.llm import decontaminate as d

SCHEMAS = "doc_id long, text string", "item_id long, text string"


def windows(text, size, form):
    tokens = d.TOKEN.findall(text)
    kinds = []
    for i, w in enumerate(tokens):
        low = w.lower()
        number = w[0].isdigit() or low in d.NUMBERS
        unit = low in d.UNITS and not number and i > 0 and (tokens[i - 1][0].isdigit() or tokens[i - 1].lower() in d.NUMBERS)
        kinds.append("number" if number else "unit" if unit else "name" if w[0].isupper() else "word")
    out = {}
    for at in range(len(tokens) - size + 1):
        part = list(zip(tokens[at: at + size], kinds[at: at + size], strict=True))
        if form == "exact":
            out[at] = tuple(w.lower() for w, _ in part), []
            continue
        slot = (lambda k: k != "word") if form == "typed" else (lambda k: k == "number")
        words = sum(k == "word" for _, k in part) if form == "typed" else sum(k != "number" for _, k in part)
        if words >= (d.LEAST_LITERAL if size == d.WINDOW else -(-size // 2)):
            out[at] = tuple(f"<{k}>" if slot(k) else w.lower() for w, k in part), [(k, w.lower()) for w, k in part if slot(k)]
    return out


def spelled(text, form):
    """The template of a whole text, token by token."""
    tokens, out = d.TOKEN.findall(text), []
    for i, w in enumerate(tokens):
        low = w.lower()
        number = w[0].isdigit() or low in d.NUMBERS
        unit = low in d.UNITS and not number and i > 0 and (tokens[i - 1][0].isdigit() or tokens[i - 1].lower() in d.NUMBERS)
        kind = "number" if number else "unit" if unit else "name" if w[0].isupper() else "word"
        slot = kind == "number" or form == "typed" and kind != "word"
        out.append(f"<{kind}>" if slot else low)
    return out


def leaks(docs, items):
    found = set()
    for item, question in items:
        n = len(d.TOKEN.findall(question or ""))
        size = min(n, d.WINDOW)
        forms = {f: windows(question, size, f) for f in ("typed", "folded")} if n else {}
        forms = forms if any(forms.values()) else {"exact": windows(question, size, "exact")} if n else {}
        every = {at for w in forms.values() for at in w}
        for doc, text in docs:
            matched, longest, aligned = set(), 0, []
            for form, mine in forms.items():
                theirs = windows(text or "", size, form)
                lines = {}
                for at, (codes, slots) in mine.items():
                    for there, (other, filled) in theirs.items():
                        if codes == other:
                            lines.setdefault(there - at, []).append((at, list(zip(slots, filled, strict=True))))
                good = []
                for shift, line in lines.items():
                    pairs = {p for _, x in line for p in x}
                    if not pairs or len({a for a, _ in pairs}) / len(pairs) >= d.CONSISTENT:
                        good.append(shift)
                        matched |= {at for at, _ in line}
                        longest = max(longest, len(line) + size - 1)
                aligned.append((form, good))
            if every and 0 < len(every) < n - size + 1:
                # some windows hold too few words: an alignment must have the whole item's template
                best = 0
                for form, lines in aligned:
                    for shift in lines:
                        mine, theirs = (spelled(x or "", form) for x in (question, text))
                        best = max(best, sum(0 <= i + shift < len(theirs) and theirs[i + shift] == c for i, c in enumerate(mine)) / n)
                if len(matched) / len(every) >= d.COVERAGE and best >= d.COVERAGE or longest >= d.RUN:
                    found.add((doc, item))
                continue
            if every and (len(matched) / len(every) >= d.COVERAGE or longest >= d.RUN):
                found.add((doc, item))
    return found


def test_equal_to_plain_version(spark):
    rng = random.Random(6)
    names, words = ["Anna", "Bernard", "Zoe", "Carl"], "buys apples for the market and pays with small coins at night near river".split()

    def sentence(n):
        return " ".join(rng.choice([rng.choice(words)] * 5 + [rng.choice(names), str(rng.randint(1, 30)), "12 kg", "+ 5"]) for _ in range(n))

    items = [(i, sentence(rng.choice([3, 5, 8, 12, 20, 40]))) for i in range(30)] + [(100, "What is 12 + 30 - 7?"), (101, "Compute 45 * 12."), (102, "17 18 19 20"), (103, ""), (104, None)]
    items += [(110 + i, f"please add up the numbers {' '.join(str(rng.randint(1, 40)) for _ in range(k))} and name {rng.choice(names)}") for i, k in enumerate((3, 9, 14))]
    docs = []
    for i in range(120):
        text = sentence(rng.randint(0, 30))
        if rng.random() < 0.7:
            copy = rng.choice(items)[1] or ""
            if rng.random() < 0.5:
                copy = copy.replace("Anna", rng.choice(names)).replace("12", str(rng.randint(1, 99)))
            if rng.random() < 0.3:
                copy = " ".join(w for w in copy.split() if rng.random() < 0.9)
            text = f"{text} {copy.lower() if rng.random() < 0.2 else copy} {sentence(rng.randint(0, 30))}"
        docs.append((i, text))
    want = leaks(docs, items)
    got = d.leaks(spark.createDataFrame(docs, SCHEMAS[0]).repartition(3), spark.createDataFrame(items, SCHEMAS[1])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(want) > 30
    kept = d.decontaminate(spark.createDataFrame(docs, SCHEMAS[0]), spark.createDataFrame(items, SCHEMAS[1]))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_arithmetic(spark):
    """Short questions of numbers are found as they are and with other numbers."""
    items = spark.createDataFrame([(1, "What is 12 + 30 - 7?"), (2, "Compute 45 * 12.")], SCHEMAS[1])
    docs = [(1, "What is 12 + 30 - 7?"), (2, "so what is 5 + 6 - 1 then"), (3, "Compute 45 * 12."), (4, "compute 3 * 9"), (5, "what is 12 or 30"), (6, "compute 45 and 12")]
    got = {(r.doc_id, r.item_id): r.reparametrized for r in d.leaks(spark.createDataFrame(docs, SCHEMAS[0]), items).collect()}
    assert got == {(1, 1): False, (2, 1): True, (3, 2): False, (4, 2): True}


def test_many_items_of_one_template(spark):
    """Items that differ in values alone are one template: they meet texts once, and each keeps its own answer."""
    items = spark.createDataFrame([(i, f"If Anna buys {i} kg of red apples for {i + 7} dollars how much is one") for i in range(1, 200)], SCHEMAS[1])
    docs = spark.createDataFrame([(1, "If Anna buys 5 kg of red apples for 12 dollars how much is one"), (2, "if nobody buys apples")], SCHEMAS[0])
    assert d.item_windows(items).select("template").distinct().count() == 1
    got = d.leaks(docs, items).collect()
    assert {r.item_id for r in got if r.doc_id == 1} == set(range(1, 200)) and [r.item_id for r in got if not r.reparametrized] == [5]


def test_rows_are_judged_by_their_text(spark, odd, none):
    """A clean row stays though another of its id leaks, and a leaking row goes though it has no id; very long texts and clashing columns."""
    question = "which of the following rivers flows through the largest number of countries"
    items = spark.createDataFrame([(1, question, "x", 2)], "item_id long, text string, row string, template int")
    docs = spark.createDataFrame([(1, question, 1, "a"), (1, "clean text", 2, "b"), (None, question, 3, "c"), (None, None, 4, "d"), (5, "pad " * 60_000 + question, 5, "e")], "doc_id long, text string, row int, template string")
    kept = d.decontaminate(docs, items)
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [2, 4]
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()} == {(1, 1), (5, 1)}
    assert d.decontaminate(odd, items).count() == odd.count() and d.decontaminate(none, items).count() == 0


SUM = "Compute the sum of the following numbers: 12 45 78 3 9 81 22 64 5 17 33 90 41 28 6 73 59 11 36 2"


def test_the_beginning_of_an_item_is_no_leak(spark):
    """An item whose later windows are numbers alone: its first words aren't the item; the whole of it is, with other numbers too."""
    items = spark.createDataFrame([(1, SUM)], SCHEMAS[1])
    rng = random.Random(1)
    other = " ".join(str(rng.randint(1, 99)) if w.isdigit() else w for w in SUM.split())
    docs = [(1, "Exercise. Compute the sum of the following numbers: 1 2 3 4 and hand it in."), (2, f"so {SUM} then"), (3, f"now {other} please"), (4, SUM.lower()), (5, " ".join(SUM.split()[:15]))]
    got = {r.doc_id: r for r in d.leaks(spark.createDataFrame(docs, SCHEMAS[0]), items).collect()}
    assert set(got) == {2, 3, 4} == {doc for doc, _ in leaks(docs, [(1, SUM)])}
    assert got[2].coverage == 1 and not got[2].reparametrized and got[3].reparametrized
    kept = d.decontaminate(spark.createDataFrame(docs, SCHEMAS[0]), items)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 5]


def test_a_common_instruction(spark):
    """Windows that all items share are looked up only for texts that hold a rarer one of an item; the leaks are the same."""
    rng = random.Random(8)
    words = [f"w{i}x" for i in range(300)]
    words = ["".join(c for c in w if not c.isdigit()) + "abcdefghij"[i % 10] + "klmnopqrst"[i // 10 % 10] + "uvwxyz"[i // 100] for i, w in enumerate(words)]
    items = [(i, "choose the best answer to the following question " + " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 9, 20])))) for i in range(40)]
    docs = [(i, "choose the best answer to the following question " + " ".join(rng.choice(words) for _ in range(15))) for i in range(40)] + [(100 + i, f"and {t} and") for i, t in items[:15]]
    got = d.leaks(spark.createDataFrame(docs, SCHEMAS[0]), spark.createDataFrame(items, SCHEMAS[1])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks(docs, items)
    made = d.item_windows(spark.createDataFrame(items, SCHEMAS[1])).select("template", "at", "size", "form", "hash", "slots").distinct()
    common = made.groupBy("hash").count().filter("count >= 20").select("hash")
    assert d._telling(made).join(common, "hash").select("template").distinct().count() < 20
