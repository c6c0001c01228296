"""Series of many keys against one series at a time."""

import random
from decimal import Decimal

import pytest

from ledgerproof.functions.finance import irr, irr_shown, npv
from ledgerproof.lang.values import Fault, quantize
from ledgerproof.operators import series

SCHEMA = "a string, b int, at long, v decimal(18,2), more int"


def money(rng, low, high):
    return Decimal(rng.randrange(low, high)).scaleb(-2)


def frame(spark, rows):
    return spark.createDataFrame([(a, b, at, v, 1) for a, b, at, v in rows], SCHEMA).repartition(3)


def plain(rows, value, places):
    groups = {}
    for a, b, at, v in rows:
        groups.setdefault((a, b), []).append((at, v))
    out = {}
    for key, flows in groups.items():
        places_ = [at for at, _ in flows]
        whole = None not in places_ and sorted(places_) == list(range(min(places_), min(places_) + len(places_))) and all(v is not None for _, v in flows)
        try:
            out[key] = (quantize(value([v for _, v in sorted(flows)]), places), None) if whole else (None, "TYPE")
        except Fault as f:
            out[key] = (None, f.code)
    return out


def rows_of(df, name):
    return {(r.a, r.b): (r[name], r.error) for r in df.collect()}


def loans(rng, keys, longest=30):
    rows = []
    for a, b in keys:
        n, lent, at = rng.randrange(2, longest), money(rng, 10_000, 10_000_000), rng.choice([0, 5, -3, 1995])
        rows.append((a, b, at, -lent))
        rows += [(a, b, at + k, money(rng, 100, 3_000_000)) for k in range(1, n)]
    return rows


AWKWARD = [
    ("gap", 1, 0, Decimal("-5.00")), ("gap", 1, 2, Decimal("7.00")), ("twice", 1, 0, Decimal("-5.00")), ("twice", 1, 0, Decimal("1.00")), ("twice", 1, 2, Decimal("7.00")),
    ("void", 1, 0, Decimal("-5.00")), ("void", 1, 1, None), ("lost", 1, None, Decimal("1.00")), ("lost", 1, 1, Decimal("1.00")), ("lone", 1, 3, Decimal("4.00")),
    ("zeros", 1, 0, Decimal("0.00")), ("zeros", 1, 1, Decimal("0.00")), ("turns", 1, 0, Decimal("-1.00")), ("turns", 1, 1, Decimal("3.00")), ("turns", 1, 2, Decimal("-1.00")),
    (None, None, 7, Decimal("-100.00")), (None, None, 8, Decimal("0.00")), (None, None, 9, Decimal("121.00")),
]


@pytest.mark.parametrize("block", [3, 20_000])
def test_present_values(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK", block)
    rows = loans(random.Random(1), [("x", k) for k in range(12)] + [("y|,", 1)]) + AWKWARD
    got = rows_of(series.present_values(frame(spark, rows), ["a", "b"], "at", "v", Decimal("0.07")), "npv")
    assert got == plain(rows, lambda flows: npv(Decimal("0.07"), flows), 2)
    with pytest.raises(Fault):
        series.present_values(frame(spark, rows), ["a"], "at", "v", Decimal(-1))


@pytest.mark.parametrize(("few", "keys"), [(20_000, 10), (2, 3)])
def test_rates_of_return(spark, monkeypatch, few, keys):
    """Alone in their tasks, and all together scan by scan over blocks of three rows."""
    monkeypatch.setattr(series, "FEW", few)
    monkeypatch.setattr(series, "BLOCK", 3)
    rows = loans(random.Random(2), [("x", k) for k in range(keys)], 9) + AWKWARD
    got = rows_of(series.rates_of_return(frame(spark, rows), ["a", "b"], "at", "v", 12), "irr")
    assert got == plain(rows, irr, 12)
    assert got[None, None] == (Decimal("0.100000000000"), None)


def test_no_series(spark):
    empty = frame(spark, [])
    assert series.present_values(empty, ["a"], "at", "v", Decimal("0.1")).collect() == []
    assert series.rates_of_return(empty, ["a"], "at", "v").collect() == []


def test_a_value_of_too_many_digits(spark):
    rows = [("x", 1, k, Decimal("9999999999999999.99")) for k in range(200)]
    got = rows_of(series.present_values(frame(spark, rows), ["a", "b"], "at", "v", Decimal("-0.5")), "npv")
    assert got == {("x", 1): (None, "PRECISION")}


def test_a_rate_is_told_by_two_prices():
    """The rounded rate without the search is the search's, wherever it is told at all; ties, several signs and rates far out are left to the search."""
    rng, told = random.Random(5), 0
    some = [[v for *_, v in loans(rng, [("x", k)])] for k in range(300)] + [[Decimal(-100)] + [Decimal(r)] * k + [Decimal(100 + r)] for r in range(-8, 30) for k in range(4)]
    for flows in some:
        got = irr_shown(flows, 6)
        told += got is not None
        assert got is None or got == quantize(irr(flows), 6)
    assert told > 0.8 * len(some)
    for flows in ([Decimal(-1), Decimal("1.0000005")], [Decimal(-1), Decimal(3), Decimal(-1)], [Decimal(-1), Decimal(5)], [Decimal(1)], []):
        assert irr_shown(flows, 6) is None


def test_short_series_of_one_file_are_priced_in_several_tasks(spark, tmp_path):
    rows = [(None, k, at, Decimal(-100 if at == 0 else 60)) for k in range(400) for at in range(3)]
    frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/rows")
    got = series.rates_of_return(spark.read.parquet(f"{tmp_path}/rows"), ["b"], "at", "v")
    held = got.select("irr").mapInPandas(lambda batches: iter([__import__("pandas").DataFrame({"n": [sum(map(len, batches))]})]), "n long")
    assert sum(r.n for r in held.collect()) == 400
    assert "RepartitionByExpression" in got._jdf.queryExecution().optimizedPlan().toString() and "FlatMapGroupsInPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
