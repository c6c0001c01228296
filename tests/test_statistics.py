"""Answers from statistics of a sheet, against a loop over its rows."""

import random
from decimal import ROUND_HALF_UP, Decimal

import pytest

from ledgerproof.lang.parser import parse_expression
from ledgerproof.operators import grids
from ledgerproof.operators.statistics import Inseparable, Statistics, parts_of

P = [grids.Param("x", Decimal("-0.50"), Decimal("0.25"), 6), grids.Param("y", Decimal("0.0"), Decimal("1.3"), 5)]


def sheet(spark, n, seed, nulls=0.0):
    rng = random.Random(seed)
    cell = lambda low, high, s: None if rng.random() < nulls else Decimal(rng.randrange(low, high)).scaleb(-s)
    rows = [(cell(-9000, 90000, 2), cell(-50, 50, 1), cell(0, 9, 0)) for _ in range(n)]
    return spark.createDataFrame(rows, "a decimal(12,2), b decimal(8,1), c decimal(4,0)").repartition(3), rows


def loop(rows, rule, places, given):
    values = [rule(*[Decimal(v) for v in row], given["x"], given["y"]).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP) for row in rows if None not in row]
    return sum(values, Decimal(0)), min(values, default=None), max(values, default=None), Decimal(len(rows))


ROUNDED = [("a * (1 - x) * (1 + y)", 2, lambda a, b, c, x, y: a * (1 - x) * (1 + y)), ("a * b * x", 1, lambda a, b, c, x, y: a * b * x), ("-(a * (x + y) ^ 2)", 0, lambda a, b, c, x, y: -(a * (x + y) ** 2))]
WHOLE = [("a * x + b * y - c + 2", 4, lambda a, b, c, x, y: a * x + b * y - c + 2), ("a * (b + y) - a * b", 3, lambda a, b, c, x, y: a * (b + y) - a * b)]


@pytest.mark.parametrize("nulls", [0.0, 0.2])
@pytest.mark.parametrize(("text", "places", "rule"), ROUNDED)
def test_rules_that_round(spark, text, places, rule, nulls):
    frame, rows = sheet(spark, 200, 5, nulls)
    used = [r if "c" in text else (*r[:2], 0) for r in rows]
    used = [r if "b" in text else (r[0], 0, r[2]) for r in used]
    got = grids.sheet_answers(frame, {"v": (text, places)}, {"s": "SUM(v)", "lo": "MIN(v)", "hi": "MAX(v)", "n": "COUNT(v)"}, P)
    assert "MapInPandas" in got._jdf.queryExecution().toString()
    got = {r.q_ix: (r.s, r.lo, r.hi, r.n) for r in got.collect()}
    for q, given in enumerate(grids.points(P), 1):
        assert got[q] == loop(used, rule, places, given)


@pytest.mark.parametrize(("text", "places", "rule"), WHOLE)
def test_rules_that_keep_all_decimals(spark, text, places, rule):
    frame, rows = sheet(spark, 100, 6)
    got = {r.q_ix: r.s for r in grids.sheet_answers(frame, {"v": (text, places)}, {"s": "SUM(v)"}, P).collect()}
    assert got == {q: loop(rows, rule, places, given)[0] for q, given in enumerate(grids.points(P), 1)}


def test_what_does_not_come_apart(spark):
    frame, _ = sheet(spark, 5, 1)
    for text, places in (("a / x", 2), ("a * x + b", 1), ("ROUND(a, 1) * x", 1), ("a * x * 0.00000001", 2)):
        with pytest.raises(Inseparable):
            Statistics(frame, parse_expression(text), places, {"s": "SUM"}, {"x": 2, "y": 1})
    assert len(parts_of(parse_expression("(a + x) * (b - y)"), {"a", "b"}, {"x", "y"})) == 4


def test_a_hundred_thousand_questions(spark):
    """As many answers as questions, those of a coarse grid among them equal to one aggregation for each question."""
    frame, rows = sheet(spark, 300, 8)
    fine = [grids.Param("x", Decimal("0.000"), Decimal("0.001"), 400), grids.Param("y", Decimal("0.00"), Decimal("0.02"), 250)]
    got = grids.sheet_answers(frame, {"v": ("a * (1 - x) * (1 + y)", 2)}, {"s": "SUM(v)"}, fine)
    assert got.count() == 100_000
    some = {(r.x, r.y): r.s for r in got.filter("q_ix % 9973 = 0").collect()}
    for (x, y), s in some.items():
        assert s == loop([(r[0], 0, 0) for r in rows], lambda a, b, c, p, q: a * (1 - p) * (1 + q), 2, {"x": x, "y": y})[0]


def test_an_empty_sheet(spark):
    frame = spark.createDataFrame([], "a decimal(12,2)")
    got = grids.sheet_answers(frame, {"v": ("a * x", 2)}, {"s": "SUM(v)", "m": "MAX(v)", "n": "COUNT(v)"}, P[:1]).collect()
    assert {(r.s, r.m, r.n) for r in got} == {(Decimal("0.00"), None, Decimal(0))} and len(got) == 6
