import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerproof.functions import texts
from ledgerproof.functions.evaluate import evaluate
from ledgerproof.lang.parser import parse_expression
from ledgerproof.lang.values import Fault, number_of, quantize, shown_places
from ledgerproof.operators import grids
from ledgerproof.operators.sweep import read_scenario, resolve_scenario, simulate
from ledgerproof.operators.workbook import Workbook
from ledgerproof.plans.model import build
from ledgerproof.sources.markdown import locate

D = Decimal
ROWS = [(1, D("2.50"), D("3.00"), D("7.50")), (2, D("-1.25"), D("4.00"), D("-5.00")), (3, D("10.00"), D("0.00"), D("1.00")), (4, None, D("1.00"), None)]


@pytest.fixture
def frame(spark):
    return spark.createDataFrame(ROWS, "id long, a decimal(12,2), b decimal(12,2), p decimal(18,2)")


def test_rules_errors_and_stale_rows(spark, frame):
    run = Workbook(spark).sheet("t", frame, "p precision 2 = a * b\nq precision 3 = a / b\nr = q + p", label="id").run()
    got = {r.id: r for r in run.table("t").collect()}
    assert [got[i].p for i in (1, 2, 3)] == [D("7.50"), D("-5.00"), D("0.00")]
    assert got[1].q == D("0.833") and got[3].q is None and got[3].q_error == "TYPE" and got[3].r_error == "TYPE"
    found = {(r.name, r.row_label, r.code) for r in run.findings().collect()}
    assert ("p", "3", "STALE") in found and ("q", "3", "TYPE") in found and ("p", "4", "TYPE") in found and ("p", "1", "STALE") not in found


def test_scalars(spark, frame):
    book = Workbook(spark).sheet("", None, "k = 2").sheet("t", frame.filter("a is not null"), "s = SUM(a)\nm precision 4 = AVG(b)\nn = COUNT(a)\nx = MAX(a) * k\ny = s + x\nassert s > 10\nassert n == 4", order_by="id")
    got = {r.name: (r.value, r.error) for r in book.run().values().collect()}
    assert got["s"] == ("11.25", None) and got["m"] == ("2.3333", None) and got["n"] == ("3", None) and got["x"] == ("20.00", None) and got["y"] == ("31.25", None)
    assert [h for _, _, h in book.run().assertions()] == [True, False]
    poisoned = {r.name: r.error for r in Workbook(spark).sheet("t", frame, "s = SUM(a)\nn = COUNT(a)\nu = s + 1\nz = AVG(a)").run().values().collect()}
    assert poisoned == {"s": "TYPE", "n": None, "u": "TYPE", "z": "TYPE"}
    empty = {r.name: (r.value, r.error) for r in Workbook(spark).sheet("t", frame.filter("id > 9"), "s = SUM(a)\nn = COUNT(a)\nz = MIN(a)").run().values().collect()}
    assert empty == {"s": ("0.00", None), "n": ("0", None), "z": (None, "TYPE")}


def test_finance_over_sheets(spark):
    flows = spark.createDataFrame([(i, D(v)) for i, v in enumerate(("-48000.00", "20000.00", "20000.00", "20000.00"))], "ix int, cash decimal(12,2)").repartition(3)
    got = {r.name: r.value for r in Workbook(spark).sheet("f", flows, "v precision 2 = NPV(0.08, cash)\ni precision 4 = IRR(cash)", order_by="ix").run().values().collect()}
    assert got == {"v": "3541.94", "i": "0.1204"}
    gap = flows.withColumn("ix", F.col("ix") * 2)
    assert Workbook(spark).sheet("f", gap, "v precision 2 = NPV(0.08, cash)", order_by="ix").run().values().first().error == "TYPE"


def test_refusals(spark, frame):
    for text, code in (("x = y", "UNDEF"), ("x = a", None), ("p precision 2 = a / b\nq = p / a", "PRECISION")):
        try:
            run = Workbook(spark).sheet("t", frame, text).run()
            assert code is None or code in {f.code for f in run.faults.values()}
        except Fault as f:
            assert f.code == code
    ring = Workbook(spark).sheet("t", None, "x = y + 1\ny = x + 1").run()
    assert {f.code for f in ring.faults.values()} == {"CYCLE"}
    with pytest.raises(Fault):
        Workbook(spark).sheet("t", frame, "x = = 1")


def test_compiled_rules_equal_python(spark):
    """Random rules over random rows give the same as decimal evaluation, errors included."""
    rng = random.Random(5)

    def expression(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["a", "b", "c", "2", "0.5", "3%"])
        x, y = expression(depth - 1), expression(depth - 1)
        return rng.choice([f"({x} + {y})", f"({x} - {y})", f"({x} * {y})", f"({x} / {y})", f"MOD({x}, {y})", f"FLOOR({x}, 0.25)", f"CEILING({x}, 2)", f"ABS({x})", f"ROUND({x}, 1)", f"IF({x} < {y}, {x}, {y})", f"-{x}", f"SQRT({x})", f"({x}) ^ 2"])

    rows = [(i, D(rng.randint(-9999, 9999)).scaleb(-2), D(rng.randint(-500, 500)).scaleb(-1), D(rng.randint(-20, 20))) for i in range(40)] + [(99, D(0), D(0), D(0))]
    frame = spark.createDataFrame(rows, "i int, a decimal(8,2), b decimal(6,1), c decimal(4,0)")
    texts_ = [expression(3) for _ in range(40)]
    rules = "\n".join(f"r{k} precision 3 = {t} + a * 0" for k, t in enumerate(texts_))
    run = Workbook(spark).sheet("t", frame, rules).run()
    assert not run.faults, run.faults
    for row in run.table("t").collect():
        values = {"a": row.a, "b": row.b, "c": row.c}
        for k, t in enumerate(texts_):
            try:
                want = quantize(evaluate(parse_expression(f"{t} + a * 0"), lambda r: values[r.name], None), 3)
            except Fault:
                want = None
            error = row[f"r{k}_error"] if f"r{k}_error" in row else None
            assert row[f"r{k}"] == want and (error is None) == (want is not None), (t, values, row[f"r{k}"], want)


def test_cell_text_columns(spark):
    cells = ["1.50", "30%", "$ 5.0", "5 kg", "-$3", "1,000.00", "1e3", "", "n/a", "$5kg", "2026-09-03", "2026-02", "15.10.2026", "11/12/2026", "5/5/2026"]
    frame = spark.createDataFrame([(c,) for c in cells], "t string")
    t = F.col("t")
    for r in frame.select("t", texts.number(t).alias("v"), texts.places(t).alias("p"), texts.kind_of(t).alias("k"), texts.date_reading(t).alias("d")).collect():
        try:
            want = number_of(r.t)
        except Fault:
            want = None
        assert r.v == want and r.p == shown_places(r.t), r
    kinds = {r.t: (r.k, r.d) for r in frame.select("t", texts.kind_of(t).alias("k"), texts.date_reading(t).alias("d")).collect()}
    assert kinds["2026-09-03"][0] == "date" and kinds["2026-02"][0] == "str"
    assert [kinds[x][1] for x in cells[-3:]] == ["decidable", "ambiguous", "same"]


SWEEP = """```vmark #plan
param hours precision 0 integer in [0, 20] lattice 10 = default 10
param disc  precision 2 in [0%, 10%] lattice 5% = default 0%
rate precision 2 = 100.00
cost precision 2 = hours * rate
price precision 2 = 1500.00 * (1 - disc)
margin precision 2 = price - cost
assert margin >= 0
assert hours <= 15

report ledger assertions broken
report deltas on plan.margin among all
report gates
report best scalar plan.margin direction max among feasible
report forbidden
report slack
```
"""


def test_blocked_sheets():
    """A fault keeps back the sheets whose reports read it, a lattice's fault all of them, and what nothing reads none."""
    two = SWEEP + "```vmark #other\nfar precision 2 = 1.00\nassert far > 0\n\nreport deltas on other.far\n```\n"
    broken = two.replace("far precision 2 = 1.00", "far precision 2 = 1.00\nlost = nothing + 1")
    sim = simulate(broken)
    assert sim.blocked == [] and len(sim.reports) == 7
    read = simulate(two.replace("far precision 2 = 1.00", "far precision 2 = nothing"))
    assert len(read.blocked) == 1 and read.blocked[0].startswith("other: UNDEF other.far") and len(read.reports) == 6 and all(k.startswith("plan") for k in read.reports)
    chain = simulate(two.replace("rate precision 2 = 100.00", "rate precision 2 = nothing"))
    assert len(chain.blocked) == 1 and chain.blocked[0].startswith("plan: UNDEF plan.rate") and [k.split(":")[0] for k in chain.reports] == ["other"]
    lattice = simulate(two.replace("lattice 10 = default 10", "lattice 7 = default 10"))
    assert len(lattice.blocked) >= 2 and lattice.reports == {} and lattice.answers == []


def test_document_sweep():
    sim = simulate(SWEEP)
    lines = {k.split("report ")[1].split()[0]: v for k, v in sim.reports.items()}
    assert len(sim.answers) == 9 and lines["ledger"][-1] == "9\t20\t10%\tno\tmargin >= 0; hours <= 15"
    assert lines["deltas"] == ["plan.margin\tbase 500.00", "low\t-650.00\t(-1150.00)\thours=20 disc=10%", "high\t1500.00\t(+1000.00)\thours=0 disc=0%", "over 9 questions"]
    assert lines["gates"][2] == "margin >= 0\t6\t3\t0\tholds\thours=20 disc=0%"
    assert lines["best"][0] == "hours=0 disc=0%" and lines["best"][2] == "chosen from 6 feasible of 9 questions"
    assert lines["forbidden"] == ["hours\t20", "disc\tnone"]
    assert lines["slack"][1] == "hours <= 15\troom 5 at hours=10 disc=0%"
    with pytest.raises(Fault):
        simulate(SWEEP, most_questions=8)
    assert simulate(SWEEP.replace("lattice 10", "lattice 7")).blocked


def test_scenarios():
    model = build(locate(SWEEP))
    assert resolve_scenario(model, read_scenario('{"plan.hours": "20", "disc": "5%"}')) == {("plan", "hours"): D(20), ("plan", "disc"): D("0.05")}
    for bad in ('{"hours": "21"}', '{"hours": "1.5"}', '{"disc": "0.05"}', '{"x": "1"}', '{"hours": "a"}', '{"hours": 1}', '{"hours": "1", "hours": "2"}', "[1]", "{"):
        with pytest.raises(Fault):
            resolve_scenario(model, read_scenario(bad))


def test_sheet_sweep_equals_single_runs(spark):
    frame = spark.createDataFrame([(D("10.00"),), (D("20.50"),)], "a decimal(8,2)")
    params = [grids.Param("x", D("0"), D("0.5"), 5), grids.Param("y", D(1), D(2), 30)]
    got = grids.sheet_answers(frame, {"v": ("a * x + y", 2)}, {"s": "SUM(v)", "m": "MAX(v)"}, params)
    rows = {r.q_ix: r for r in got.collect()}
    assert len(rows) == 150 and {r.q_ix for r in grids.questions(spark, params).collect()} == set(rows)
    for q, given in enumerate(grids.points(params), 1):
        values = [quantize(a * given["x"] + given["y"], 2) for a in (D("10.00"), D("20.50"))]
        assert rows[q].s == sum(values) and rows[q].m == max(values)


def test_quotients_that_end_a_rule(spark):
    """A quotient is rounded exactly by its remainder: ties, signs, zero and digits that only just fit, equal to decimal evaluation."""
    rng = random.Random(12)
    rows = [(i, D(rng.randint(-(10**9), 10**9)).scaleb(-2), D(rng.randint(-400, 400)).scaleb(-1)) for i in range(300)]
    rows += [(1000, D("0.05"), D("0.1")), (1001, D("-0.25"), D("0.2")), (1002, D("1.00"), D("8.0")), (1003, D("-1.00"), D("8.0")), (1004, D("5.00"), D("0.0")), (1005, D("0.00"), D("-3.0"))]
    frame = spark.createDataFrame(rows, "i int, a decimal(14,2), b decimal(6,1)")
    run = Workbook(spark).sheet("t", frame, "q precision 2 = a / b\nr precision 4 = ROUND(a / b, 1)\nz precision 0 = (a + 1) / (b * 4)\ns precision 3 = a * 1000 / SUM(a)").run()
    plan = run.table("t")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    total = sum(a for _, a, _ in rows)
    formulas = {"q": ("a / b", 2), "r": ("ROUND(a / b, 1)", 4), "z": ("(a + 1) / (b * 4)", 0), "s": ("a * 1000 / t", 3)}
    for row in run.table("t").collect():
        for name, (text, places) in formulas.items():
            try:
                want = quantize(evaluate(parse_expression(text), lambda r, row=row: {"a": row.a, "b": row.b, "t": total}[r.name], None), places)
            except Fault:
                want = None
            assert row[name] == want, (name, row.a, row.b)
            assert (row[f"{name}_error"] == "TYPE") == (want is None)


def test_reduces_of_assertions(spark):
    """Assertions may hold any reduce, rates included; all of one sheet are computed together."""
    flows = spark.createDataFrame([(i, D(v)) for i, v in enumerate(("-900.00", "500.00", "600.00"))], "ix int, cash decimal(12,2)")
    book = Workbook(spark).sheet("f", flows, "assert NPV(0.05, cash) > 0\nassert IRR(cash) > 10%\nassert SUM(cash) == 200\nassert NPV(0 - 2, cash) > 0\nassert NPV(0.5, cash) > 0", order_by="ix")
    assert [h for _, _, h in book.run().assertions()] == [True, True, True, None, False]


def test_rates_in_tasks_equal_the_driver(spark, monkeypatch):
    """The same steps price a trial rate in the tasks or on the driver, whatever the number of flows."""
    from ledgerproof.operators import workbook

    rng = random.Random(9)
    flows = [(i, D(-5000) if i < 3 else D(rng.randint(0, 900))) for i in range(60)]
    frame = spark.createDataFrame(flows, "ix int, cash decimal(12,2)").repartition(5)
    rule = "i precision 12 = IRR(cash)"
    near = Workbook(spark).sheet("f", frame, rule, order_by="ix").run().values().first()
    monkeypatch.setattr(workbook, "FEW_FLOWS", 0)
    monkeypatch.setattr(workbook, "BLOCK", 7)
    far = Workbook(spark).sheet("f", frame, rule, order_by="ix").run().values().first()
    assert near == far and near.error is None
    wavy = spark.createDataFrame([(i, D((-1) ** i)) for i in range(30)], "ix int, cash decimal(12,2)")
    assert Workbook(spark).sheet("f", wavy, rule, order_by="ix").run().values().first().error == "TYPE"


def test_days_added_from_either_side(spark):
    from datetime import date

    frame = spark.createDataFrame([(date(2024, 2, 28), D(2)), (date(2023, 12, 31), D(1))], "day date, n decimal(4,0)")
    run = Workbook(spark).sheet("t", frame, "x = day + n\ny = n + day\nz = 30 + day").run()
    got = run.table("t").collect()
    assert [(r.x, r.y) for r in got] == [(date(2024, 3, 1),) * 2, (date(2024, 1, 1),) * 2] and got[0].z == date(2024, 3, 29)
    assert evaluate(parse_expression("3 + EOMONTH(d, 0)"), lambda r: date(2024, 1, 5), None) == date(2024, 2, 3)
