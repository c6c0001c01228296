from decimal import Decimal

import pytest

from ledgerproof.lang.values import Fault
from ledgerproof.operators.charts import draw, draw_all, state
from ledgerproof.operators.documents import check, check_corpus, tally
from ledgerproof.operators.infer import acronym, aliases, infer, proposals, write
from ledgerproof.operators.repair import Edit, apply_edits, fmt, plan_corpus, splice
from ledgerproof.operators.reports import explain, findings_json, findings_text, result_json
from ledgerproof.plans.findings import summary
from ledgerproof.sources.csv_import import gate, parse_clause, parse_csv, stamp_state

LOG = """# Boiler log

Water goes in at the foot of the shaft and is measured at its head.

| Run | Minutes | Start [C] | End [C] | Rise [C] | Pace |
|-----|---:|---:|---:|---:|---:|
| dawn | 40 | 18.5 | 61.0 | 42.5 | 1.063 |
| noon | 25 | 20.0 | 48.0 | 28.0 | 1.120 |
| dusk | 50 | 19.2 | 70.4 | 51.2 | 1.024 |
| late | 16 | 22.4 | 30.4 | 8.0 | 0.500 |

```vmark #boiler
limit [C] = 75.0
Rise = End - Start
Pace precision 3 = Rise / Minutes
peak [C] = MAX(End)
runtime = SUM(Minutes)
typical [C] precision 1 = AVG(Rise)
assert peak < limit
```

The water reached **70.4 C**<!--vmark=boiler.peak|unit-->, rose by 32.4<!--vmark=boiler.typical--> as a rule, and the boiler burnt for 131<!--vmark=boiler.runtime--> minutes.
"""
COLDER = LOG.replace("| noon | 25 | 20.0 |", "| noon | 25 | 21.0 |")


def codes(text, **more):
    return [f.code for f in check(text, **more).findings]


def test_clean():
    r = check(LOG)
    assert r.findings == [] and r.exit_code == 0
    assert r.values["boiler", "typical"] == Decimal("32.4") and r.values["boiler", "runtime"] == Decimal(131)
    assert fmt(LOG)[0] == LOG


def test_drift_and_repair():
    text = COLDER.replace("| 0.500 |", "| 0.600 |")
    r = check(text)
    assert summary(r.findings) == {"problems": 5, "stale": 5, "errors": 0}
    fixed, counts, left = fmt(text)
    assert counts == {"cell": 3, "anchor": 1} and left == []
    assert check(fixed).findings == [] and fmt(fixed)[0] == fixed
    changed = [(a, b) for a, b in zip(text.split("\n"), fixed.split("\n"), strict=True) if a != b]
    assert len(changed) == 3 and "| noon | 25 | 21.0 | 48.0 | 27.0 | 1.080 |" in fixed


@pytest.mark.parametrize(("old", "new", "code"), [
    ("End - Start", "End - Strat", "UNDEF"), ("MAX(End)", "End", "VECTOR"), ("MAX(End)", "MAXX(End)", "UNDEF"), ("SUM(Minutes)", "SUM(Minutes, 1)", "TYPE"),
    ("End - Start", "End - Minutes", "UNIT"), ("Rise / Minutes", "Rise / 0", "TYPE"), ("assert peak < limit", "assert peak > limit", "ASSERT"),
    ("peak [C] = MAX(End)", "peak = limit", "CYCLE"), ("boiler.runtime-->", "boiler.runtim-->", "ANCHOR"), ("| noon | 25 |", "| noon | 12/11/2026 |", "DATE"),
    ("| 48.0 |", "| $48.0 |", "UNIT"), ("limit [C] = 75.0", "limit [C] = 75.0\nlimit [C] = 5.0", "DUP"), ("typical [C] precision 1", "typical [C]", "PRECISION"), ("limit [C] = 75.0", "limit [C] = 75.0\nspare = 1", "WARN"),
])
def test_findings(old, new, code):
    text = LOG.replace(old, new)
    if code == "CYCLE":
        text = text.replace("limit [C] = 75.0", "limit = peak")
    assert code in codes(text)


def test_a_rate_between_zero_and_one():
    """A percentage as a scalar, and a rule that takes it off."""
    doc = "```vmark\nloss = 4%\n```\n\n| Sack | Grain | Flour |\n|--|--|--|\n| a | 50 | 48.0 |\n| b | 25 | 24.1 |\n\n```vmark #mill\nFlour precision 1 = Grain * (1 - loss)\n```\n"
    assert [(f.code, f.stored, f.computed) for f in check(doc).findings] == [("STALE", "24.1", "24.0")]


def test_doubled_names_are_not_suggested():
    doc = "| A | A | Ab |\n|--|--|--|\n| 1 | 2 | 3 |\n\n```vmark #t\nx = SUM(A)\n```\n"
    assert [(f.code, f.suggestion) for f in check(doc).findings if f.code == "UNDEF"] == [("UNDEF", "Ab")]


def test_display_rules_of_ones_own():
    from ledgerproof.operators.documents import DISPLAY_RULES, register_display

    doc = "```vmark #t\nn = 12\n```\n**{}**<!--vmark=t.n|dozens-->\n"
    assert codes(doc.format("1 dz")) == ["ANCHOR"]
    register_display("dozens", "num", lambda v, places, unit: f"{v / 12:f} dz")
    try:
        assert codes(doc.format("1 dz")) == [] and fmt(doc.format("2 dz"))[0] == doc.format("1 dz")
        with pytest.raises(ValueError):
            register_display("dozens", "num", str)
    finally:
        del DISPLAY_RULES["dozens"]


def test_suppression_and_coverage():
    broken = LOG.replace("MAX(End)", "MAX(Ende)")
    assert [c for c in codes(broken) if c != "WARN"] == ["UNDEF", "NOTE"]
    assert [f.message for f in check(broken).findings if f.code == "NOTE"] == ["1 assertion not verified (upstream errors)"]
    ring = LOG.replace("peak [C] = MAX(End)", "peak = limit").replace("limit [C] = 75.0", "limit = peak")
    assert [(a.text, a.holds) for a in check(ring).assertions] == [("peak < limit", None)]
    table = "| a | b |\n|--|--|\n| 1 | 2 |\n"
    assert codes(table) == ["COVERAGE"] and codes(table + "\n<!--vmark:no-formulas-->\n") == []


def test_aliases_units_and_quotes():
    text = '| GPUs [GPU] | Band width [TB/s] | Out put [GB/s/GPU] |\n|--|--|--|\n| 8 | 3.2 | 400 |\n| 16 | 3.2 | 201 |\n\n```vmark #n\n"Band width" is bw\n"Out put" is o\no = ROUND(bw / GPUs * 1000 [GB/TB], 0)\npeak [GB/s/GPU] = MAX(o)\n```\n**400**<!--vmark=n.peak-->\n'
    found = check(text).findings
    assert [(f.code, f.stored, f.computed) for f in found] == [("STALE", "201", "200")]


def test_imports():
    data = b"Lap,Secs\n1,61.25\n2,60.50\n3,62.00\n"
    import hashlib

    stamp = hashlib.sha256(data).hexdigest()
    doc = f"```vmark #b from b.csv labelled Lap, Secs at sha256:{stamp}\nmean precision 3 = AVG(b.Secs)\n```\n**61.250**<!--vmark=b.mean-->\n"
    assert codes(doc, read=lambda p: data) == []
    assert codes(doc, read=lambda p: data + b"4,50.00\n") == ["STALE", "STALE", "IMPORT"]
    assert codes(doc) == []
    for bad in ("/a.csv", "../a.csv", "http://x/a.csv", "a.txt", "a\\b.csv"):
        with pytest.raises(Fault):
            gate(bad)
    assert parse_csv('a;"b;""c"\r\nd;e\r\n', ";") == [["a", 'b;"c'], ["d", "e"]]
    for bad in ("", "a\nb\r\nc", 'a,"b'):
        with pytest.raises(Fault):
            parse_csv(bad)
    assert stamp_state(data, None) == "unstamped" and stamp_state(data, stamp) == "ok" and stamp_state(b"", stamp) == "stale"
    assert parse_clause("from a.csv unlabelled X, Y").labelled is False
    with pytest.raises(Fault):
        parse_clause("by a.csv")


def test_stamps_are_written():
    """An import without a stamp gets one, a stale one is put right, and nothing is stamped that can't be read."""
    import hashlib

    data = b"Lap,Secs\n1,61.25\n2,60.75\n"
    stamp = hashlib.sha256(data).hexdigest()
    doc = "```vmark #b from laps.csv labelled Lap, Secs\nmean precision 3 = AVG(b.Secs)\n```\n**61.000**<!--vmark=b.mean-->\n"
    fixed, counts, left = fmt(doc, read=lambda p: data)
    assert counts == {"stamp": 1} and left == [] and f"labelled Lap, Secs at sha256:{stamp}\n" in fixed and codes(fixed, read=lambda p: data) == []
    old = fixed.replace(stamp, "0" * 64)
    assert codes(old, read=lambda p: data) == ["IMPORT"] and fmt(old, read=lambda p: data)[0] == fixed and fmt(old)[0] == old

    def missing(path):
        raise FileNotFoundError(path)

    assert fmt(doc, read=missing)[0] == doc


def test_splice():
    assert apply_edits("abcdef", [Edit(1, 2, "XX"), Edit(4, 6, "")]) == "aXXcd"
    with pytest.raises(ValueError):
        apply_edits("abc", [Edit(0, 2, "x"), Edit(1, 3, "y")])


HIRE = "| Boat | Days | Fee | Hire | Levy |\n|--|--|--|--|--|\n| a | 7 | 120.00 | 840.00 | 100.80 |\n| b | 3 | 95.50 | 286.50 | 34.38 |\n| c | 11 | 64.00 | 704.00 | 84.48 |\n"


def test_inference():
    text = HIRE + "\nDays **21**, hire **1830.50**, levy is 12%.\n"
    got = {p.target: (p.formula, p.near_miss) for p, _ in infer(text)}
    assert got["Hire"] == ("Days * Fee", False) and got["Levy"] == ("Hire * 0.12", False)
    assert got["days_total"][0] == "SUM(Days)" and got["hire_total"][0] == "SUM(Hire)"
    written = write(text)
    assert check(written).findings == [] and written.count("<!--vmark=") == 2 and write(written) == written
    assert {p.echo for p in proposals(text) if p.kind == "constant"} == {"12%"}
    near = text.replace("286.50", "386.50")
    assert ("Days * Fee", True) in [(p.formula, p.near_miss) for p, _ in infer(near)]
    plain = "| a | b |\n|--|--|\n| x | 3 |\n| y | 8 |\n"
    assert infer(plain) == [] and write(plain) == plain + "\n<!--vmark:no-formulas-->\n"
    assert acronym("GPU-to-GPU Bandwidth (full)") == "ggbf" and aliases(["B c", "B d", "D"]) == [("B c", "bc", False), ("B d", "bd", False)]
    assert acronym("Cost with VAT") == "cwv" and acronym("3 day rate") == "_3dr" and acronym("of the") == "_" and aliases(["As Set", "A S"]) == [("As Set", "as", False), ("A S", "s", False)]


def test_inference_on_a_sheet_that_has_rules():
    """A block is extended at its end, its columns aren't proposed again, the units come along, and an untrue marker goes."""
    text = HIRE.replace("Fee", "Fee [EUR]") + "\n```vmark #boats\nHire = Days * Fee\n```\n\nAll **1830.50**.\n\n<!--vmark:no-formulas-->\n"
    assert [p.target for p, _ in infer(text)] == ["Levy", "hire_total"]
    written = write(text)
    block = written[written.index("```vmark"):written.index("All")]
    assert block == "```vmark #boats\nHire = Days * Fee\nLevy = Hire * 0.12\n\nhire_total [EUR] = SUM(Hire)\n```\n\n"
    assert "Hire [EUR] | Levy [EUR] |" in written and "no-formulas" not in written and written.endswith("<!--vmark=boats.hire_total-->.\n")
    assert check(written).findings == [] and write(written) == written


def test_inference_that_stays_open():
    """Two rules of one rank, a constant column that can't be told apart, and a figure that two reduces explain are reported and never written."""
    twins = "| a | b | c | t |\n|--|--|--|--|\n| 1 | 2 | 2 | 3 |\n| 4 | 1 | 1 | 5 |\n| 7 | 3 | 3 | 10 |\n"
    assert any(p.target == "t" and p.alternatives == ["t = a + b", "t = a + c"] for p in proposals(twins) if p.kind == "ambiguous")
    ones = "| n | p | t |\n|--|--|--|\n| 1 | 2.00 | 2.00 |\n| 1 | 3.50 | 3.50 |\n| 1 | 9.00 | 9.00 |\n"
    assert any(p.alternatives == ["t = n * p", "t = p"] for p in proposals(ones) if p.kind == "ambiguous")
    figure = "| n |\n|--|\n| 4 |\n| 4 |\n\nIt is **4**.\n"
    unclear = [p for p in proposals(figure) if p.kind == "ambiguous"]
    assert [len(p.alternatives) for p in unclear] == [3] and "vmark" not in write(figure)


def test_charts():
    rows = {"A": [1.0, 2.0], "B": [3.0, -4.0]}
    for engine in ("bar", "line", "area", "stacked-bar"):
        svg = draw(engine, ["x", "y"], rows)
        assert svg == draw(engine, ["x", "y"], rows) and svg.startswith("<svg")
    assert "<path" in draw("pie", ["x", "y"], {"A": [1.0, 3.0]})
    for engine, series in (("pie", rows), ("pie", {"A": [1.0, -1.0]}), ("pie", {"A": [0.0, 0.0]}), ("ring", rows)):
        with pytest.raises(Fault):
            draw(engine, ["x", "y"], series)
    doc = "| M | A |\n|--|--|\n| x | 1 |\n| y | 2 |\n\n```vmark #s\nchart c as bar of A labelled M aspect 16:9\nchart d as pie of Z labelled M\n```\n"
    drawn, found = draw_all(check(doc))
    assert list(drawn) == [("s", "c")] and [f.code for f in found] == ["ARTIFACT"]
    svg = drawn["s", "c"]
    assert [state(x, svg) for x in (None, svg, svg + " ", "other")] == ["missing", "current", "stale", "foreign"]


def test_charts_in_a_check():
    """A check says what keeps a chart from its file: no image line, a shared one, bad data, a file that is missing, old or someone else's, and upstream errors."""
    table = "| M | A | B |\n|--|--|--|\n| x | 1 | 2 |\n| y | 2 | 4 |\n\n"
    doc = table + "```vmark #s\nB = A * 2\nchart c as bar of A, B labelled M\n```\n![c](c.svg)<!--vmark=s.c-->\n"
    assert codes(doc) == []
    svg = draw_all(check(doc))[0]["s", "c"]
    files = {"c.svg": svg.encode()}

    def read(path):
        if path not in files:
            raise FileNotFoundError(path)
        return files[path]

    assert codes(doc, read=read) == []
    files["c.svg"] = svg.replace("A", "Z").encode()
    assert codes(doc, read=read) == ["STALE"]
    files["c.svg"] = b"mine"
    assert codes(doc, read=read) == ["ARTIFACT"]
    del files["c.svg"]
    assert [f.message for f in check(doc, read).findings] == ["c.svg is missing"] and fmt(doc, read=read)[0] == doc
    assert codes(doc.replace("![c](c.svg)<!--vmark=s.c-->", "")) == ["ARTIFACT"]
    assert codes(doc.replace("as bar", "as ring")) == ["ARTIFACT"]
    assert codes(doc.replace("B = A * 2", "B = Q * 2")) == ["UNDEF", "NOTE"]
    assert codes(doc.replace("(c.svg)", "(../c.svg)"), read=read) == ["ARTIFACT"]


def test_reports():
    r = check(COLDER)
    assert "problems" in findings_text("x.md", r.findings) and '"summary"' in result_json(r)
    plan = {p["id"]: p for p in explain(r)}
    assert plan["boiler.Pace"]["needs"] == ["boiler.Rise"] and plan["boiler.Pace"]["width"] == 3 and plan["boiler.Rise"]["width"] == 1


def test_corpus(spark):
    docs = spark.createDataFrame([("a", LOG), ("b", COLDER), ("c", "no tables"), ("d", None), ("e", "```vmark #x\ny = (\n```")], "doc_id string, text string")
    found = check_corpus(docs)
    got = {r.doc_id: (r.problems, r.stale) for r in tally(found).collect()}
    assert set(got) == {"b", "e"} and got["e"] == (1, 0)
    edits = plan_corpus(docs).select("doc_id", "start", "end", "old", "text")
    fixed = {r.doc_id: r for r in splice(docs, edits).collect()}
    assert check(fixed["b"].text).findings == [] and fixed["a"].applied == 0 and fixed["d"].text is None
    bad = edits.selectExpr("doc_id", "start", "end", "'nonsense' as old", "text")
    assert {r.doc_id: r.refused for r in splice(docs, bad).collect()}["b"] > 0
    assert findings_json(found).count() == 2


def test_report_names_chart_paths_and_units():
    doc = "| M | A [kg] |\n|--|--|\n| x | 1 |\n\n```vmark #s\nall = SUM(A)\nchart c as bar of A labelled M\nchart d as line of A labelled M\nreport best scalar s.al direction max\n```\n![x](a.svg)<!--vmark=s.c-->\n\n![y](a.svg)<!--vmark=s.d-->\n\n**1**<!--vmark=s.all-->\n"
    r = check(doc)
    assert [(f.code, f.suggestion) for f in r.findings] == [("UNDEF", "s.all"), ("ARTIFACT", None)]  # and two charts on one path
    from ledgerproof.operators.charts import paths
    from ledgerproof.operators.infer import unit_proposals

    placed, found = paths(r)
    assert placed == {("s", "c"): "a.svg"} and [f.code for f in found] == ["ARTIFACT"]
    assert unit_proposals(r) == [("s", "all", "kg")]


def test_names_of_a_rule_are_looked_up_once_for_all_rows(monkeypatch):
    from ledgerproof.operators import documents

    looked, real = [], documents.resolve
    monkeypatch.setattr(documents, "resolve", lambda *a: looked.append(a) or real(*a))

    def lookups(n: int) -> int:
        looked.clear()
        rows = "\n".join(f"| {k} | {2 * k} |" for k in range(n))
        assert not [f for f in documents.check(f"| A | B |\n|--|--|\n{rows}\n\n```vmark #t\nB = A * 2\n```\n").findings if f.problem]
        return len(looked)

    assert lookups(3) == lookups(300)


def test_equal_lines_of_two_documents_are_statements_of_their_own():
    from ledgerproof.lang.parser import parse_lines

    (a,), _ = parse_lines("x = 1 + 2", 5)
    (b,), _ = parse_lines("x = 1 + 2", 50)
    assert (a.at, b.at) == (5, 50) and a.expr == b.expr
