"""Candidates of wide sheets by fingerprints, against counters of every triple."""

import random
import time
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from ledgerproof.operators import infer
from ledgerproof.operators.candidates import result_scale


def rows_of(df):
    return {(r.target, r.formula, r.n_rows, r.n_fit) for r in df.collect()}


def sheet(spark, columns, n, seed, nulls=0.0, wrong=()):
    """Base columns of several widths, and rules over them; `wrong` rows of every rule are off by one."""
    rng = random.Random(seed)
    rows = []
    for r in range(n):
        base = [Decimal(rng.randrange(-500, 99999)).scaleb(-s) for s in (0, 2, 2, 4, 2, 0)]
        off = Decimal(int(r in wrong))
        ruled = [base[1] + base[3] + off, base[1] - base[2] + off, base[0] * base[1] + off, (base[1] * base[2]).quantize(Decimal("0.01"), "ROUND_HALF_UP") + off]
        ruled.append((base[4] / base[5]).quantize(Decimal("0.001"), "ROUND_HALF_UP") + off if base[5] else None)
        rest = [Decimal(rng.randrange(10**6)).scaleb(-2) for _ in range(columns - 11)]
        rows.append([None if v is not None and rng.random() < nulls else v for v in base + ruled + rest])
    scales = [0, 2, 2, 4, 2, 0, 4, 2, 2, 2, 3] + [2] * (columns - 11)
    return spark.createDataFrame(rows, ", ".join(f"c{k} decimal(18,{s})" for k, s in enumerate(scales)))


def every(frame, misses):
    """All rules by a loop over rows: those of sums, products, and quotients rounded as Spark rounds them."""
    rows, scale = [tuple(r) for r in frame.collect()], [f.dataType.scale for f in frame.schema.fields]
    half = lambda v, s: v.quantize(Decimal(1).scaleb(-s), "ROUND_HALF_UP")
    out = set()
    with localcontext() as context:
        context.prec = 80
        for t in range(len(scale)):
            for a in range(len(scale)):
                for b in range(len(scale)):
                    for op in "+*-/" if a < b else "-/":
                        if len({t, a, b}) < 3:
                            continue
                        n = fit = 0
                        for row in rows:
                            x, y, z = row[a], row[b], row[t]
                            if None in (x, y, z):
                                continue
                            n += 1
                            v = x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else half(x / y, 20 - scale[b]) if y else None
                            fit += v is not None and half(v, scale[t]) == z
                            if n - fit > misses:
                                break
                        if n - fit <= misses:
                            out.add((f"c{t}", f"c{a} {op} c{b}", n, fit))
    return out


@pytest.mark.parametrize(("nulls", "misses", "wrong"), [(0.0, 0, ()), (0.0, 1, (5,)), (0.1, 1, (7,)), (0.7, 0, ())])
def test_equal_to_all_rules(spark, nulls, misses, wrong):
    frame = sheet(spark, 13, 120, 3, nulls, wrong)
    want = every(frame, misses)
    assert rows_of(infer.fits(frame, most_misses=misses)) == want and len(want) >= 5


def test_types_round_as_spark_does(spark):
    """The decimals of results, wide types that lose some included."""
    for p, s, q, u in ((18, 2, 18, 2), (38, 10, 38, 10), (30, 12, 20, 8), (38, 0, 38, 38), (12, 2, 5, 0)):
        frame = spark.createDataFrame([], f"a decimal({p},{s}), b decimal({q},{u})")
        types = [f.dataType for f in frame.schema.fields]
        made = frame.select((F.col("a") + F.col("b")).alias("+"), (F.col("a") - F.col("b")).alias("-"), (F.col("a") * F.col("b")).alias("*"), F.try_divide(F.col("a").cast("decimal(30,12)"), F.col("b")).alias("/")).schema
        assert {f.name: f.dataType.scale for f in made.fields} == {op: result_scale(op, *types) for op in "+-*/"}


def test_two_hundred_columns(spark):
    """8 million rules over 200 columns: those that hold are found by lookup."""
    frame = sheet(spark, 200, 400, 9).cache()
    frame.count()
    began = time.time()
    got = {(t, f) for t, f, n, fit in rows_of(infer.fits(frame, most_misses=0))}
    assert time.time() - began < 120
    assert {("c6", "c1 + c3"), ("c7", "c1 - c2"), ("c8", "c0 * c1"), ("c9", "c1 * c2"), ("c10", "c4 / c5")} <= got
    assert got <= {(t, f) for t, f, _, _ in rows_of(infer.fits(frame.select(*[f"c{k}" for k in range(11)]), most_misses=0))}


def test_nothing_to_find(spark):
    empty = spark.createDataFrame([], "a decimal(9,2), b decimal(9,2), c decimal(9,2)")
    assert rows_of(infer.fits(empty, most_misses=0)) == rows_of(infer.fits(empty))
    assert infer.fits(empty.select("a", "b"), most_misses=0).collect() == []


def test_a_scan_counts_few_rules(spark, monkeypatch):
    """Rules that a sample leaves are counted a few at a time: one scan for all of them is too long a method for the JVM to compile."""
    columns = []
    for k in range(8):
        a, b = (F.pmod(F.xxhash64("id", F.lit(f"{k}{side}")), F.lit(900)).cast("decimal(8,0)") + 100 for side in "ab")
        columns += [a.cast("decimal(9,0)").alias(f"a{k}"), b.cast("decimal(9,0)").alias(f"b{k}"), (a + b).cast("decimal(10,0)").alias(f"x{k}")]
    frame = spark.range(200).select(*columns)
    scans, counted = [], infer._counted
    monkeypatch.setattr(infer, "_counted", lambda f, triples, scale: scans.append(triples) or counted(f, triples, scale))
    got = {(r.target, r.formula, r.n_rows, r.n_fit) for r in infer.fits(frame, most_misses=0).collect()}
    assert got == {x for k in range(8) for x in ((f"x{k}", f"a{k} + b{k}", 200, 200), (f"a{k}", f"x{k} - b{k}", 200, 200), (f"b{k}", f"x{k} - a{k}", 200, 200))}
    assert sum(map(len, scans)) == 24 and max(map(len, scans)) <= 8
    assert all(len({c for t, _, a, b in s for c in (t, a, b)}) <= 12 for s in scans)
