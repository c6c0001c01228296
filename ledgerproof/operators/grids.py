"""Sweeps over large sheets: parameter grids as DataFrames, answers in one scan per bounded chunk of questions, reports as aggregations."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Compiled, compile_expression, literal
from ..functions.registry import REDUCES
from ..lang.parser import parse_expression
from ..lang.syntax import Call, Ref, walk
from . import statistics

#: Questions whose reduces share one scan.
CHUNK = 64


@dataclass(frozen=True)
class Param:
    """A swept parameter: first value, step and number of points."""

    name: str
    first: Decimal
    step: Decimal
    count: int

    @property
    def scale(self) -> int:
        return max(0, -self.first.as_tuple().exponent, -self.step.as_tuple().exponent)

    def point(self, k: int) -> Decimal:
        return self.first + self.step * k


def questions(spark: SparkSession, params: list[Param]) -> DataFrame:
    """(q_ix from 1, a column per parameter): the full grid, last parameter fastest, by arithmetic on the question's number."""
    total = reduce(lambda n, p: n * p.count, params, 1)
    out, stride = spark.range(1, total + 1).withColumnRenamed("id", "q_ix"), total
    for p in params:
        stride //= p.count
        k = F.floor((F.col("q_ix") - 1) / stride) % p.count
        out = out.withColumn(p.name, (F.lit(p.first) + F.lit(p.step) * k.cast("decimal(10,0)")).cast(f"decimal(20,{p.scale})"))
    return out


def points(params: list[Param]) -> list[dict[str, Decimal]]:
    out: list[dict[str, Decimal]] = [{}]
    for p in params:
        out = [q | {p.name: p.point(k)} for q in out for k in range(p.count)]
    return out


def sheet_answers(frame: DataFrame, rules: dict[str, tuple[str, int]], scalars: dict[str, str], params: list[Param]) -> DataFrame:
    """(q_ix, parameters, scalars) where rules over a sheet's columns read parameters.

    `rules`: column to (formula, width); `scalars`: name to SUM/MIN/MAX/COUNT(column). Where the scalars reduce one rule that is a sum of products of columns and parameters, the
    sheet is read twice at most, whatever the number of questions (see statistics). Otherwise each chunk of questions is one aggregation: the sheet is
    read once for CHUNK questions and rows are never multiplied. Only sums leave the tasks.
    """
    spark = frame.sparkSession
    separate = _separate(frame, rules, scalars, params)
    if separate is not None:
        return separate
    grid = points(params)
    schema = {f.name: f.dataType for f in frame.schema.fields}

    def column(name: str, given: dict[str, Decimal]) -> Compiled:
        if name in given:
            return literal(given[name])
        if name in rules:
            text, places = rules[name]
            got = compile_expression(parse_expression(text), lambda r: column(r.name, given))
            digits = min(38, got.digits - got.scale + 1 + places)
            return Compiled(F.round(got.value, places).cast(f"decimal({digits},{places})"), got.error, "num", digits, places)
        t = schema[name]
        return Compiled(F.col(name), None, "num", getattr(t, "precision", 19), getattr(t, "scale", 0))

    parsed = {n: parse_expression(t) for n, t in scalars.items()}
    bad = [n for n, e in parsed.items() if not (isinstance(e, Call) and e.name in REDUCES and isinstance(e.args[-1], Ref))]
    if bad:
        raise ValueError(f"{bad[0]} must be one reduce of a column")
    out = None
    for at in range(0, len(grid), CHUNK):
        chunk, aggs = grid[at: at + CHUNK], []
        for k, given in enumerate(chunk):
            for n, e in parsed.items():
                c = column(e.args[-1].name, given)
                how = {"SUM": lambda v: F.coalesce(F.sum(v), F.lit(0)), "MIN": F.min, "MAX": F.max, "COUNT": lambda v: F.count(F.lit(1))}[e.name]
                aggs.append(how(c.value).cast(f"decimal(38,{c.scale if e.name != 'COUNT' else 0})").alias(f"{n}_{k}"))
        items = [
            F.struct(F.lit(at + k + 1).cast("long").alias("q_ix"), *[F.lit(v).cast(f"decimal(20,{p.scale})").alias(p.name) for p, v in zip(params, given.values(), strict=True)], *[F.col(f"{n}_{k}").alias(n) for n in scalars])
            for k, given in enumerate(chunk)
        ]
        part = frame.agg(*aggs).select(F.explode(F.array(*items)).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "q_ix long")


def _separate(frame: DataFrame, rules: dict[str, tuple[str, int]], scalars: dict[str, str], params: list[Param]) -> DataFrame | None:
    """The answers from statistics of the sheet, or None where the rule doesn't come apart."""
    reduces = {n: statistics.reduce_of(parse_expression(t)) for n, t in scalars.items()}
    columns = {r[1] for r in reduces.values() if r}
    if None in reduces.values() or len(columns) != 1 or (name := columns.pop()) not in rules or not params:
        return None
    text, places = rules[name]
    rule = parse_expression(text)
    if any(isinstance(x, Ref) and x.name in rules for x in walk(rule)):
        return None
    widths = {p.name: p.scale for p in params}
    try:
        stats = statistics.Statistics(frame, rule, places, {n: r[0] for n, r in reduces.items()}, widths)
    except statistics.Inseparable:
        return None
    return statistics.priced(stats, questions(frame.sparkSession, params), widths)


def derive(answers: DataFrame, formulas: dict[str, tuple[str, int]]) -> DataFrame:
    """More scalars from parameters and scalars that stand in the answers already: name to (formula, width)."""
    for n, (text, places) in formulas.items():
        schema = {f.name: f.dataType for f in answers.schema.fields}

        def lookup(r: Ref, schema=schema) -> Compiled:
            t = schema[r.name]
            scale = getattr(t, "scale", 0)
            return Compiled(F.col(r.name).cast(f"decimal(24,{scale})"), None, "num", 24 if len(text) > 30 else 18 + scale, scale)

        got = compile_expression(parse_expression(text), lookup)
        answers = answers.withColumn(n, F.round(got.value, places).cast(f"decimal(24,{places})"))
    return answers


def with_assertions(answers: DataFrame, assertions: list[str]) -> DataFrame:
    """Add a0, a1, … (whether each assertion holds) and feasible / infeasible."""
    out, schema = answers, {f.name: f.dataType for f in answers.schema.fields}
    for k, text in enumerate(assertions):
        e = parse_expression(text)
        names = {x.name for x in walk(e) if isinstance(x, Ref)}
        known = {n: Compiled(F.col(n), None, "num", 20, getattr(schema[n], "scale", 0)) for n in names}
        out = out.withColumn(f"a{k}", compile_expression(e, lambda r, known=known: known[r.name]).value)
    held = reduce(lambda a, b: a & b, [F.col(f"a{k}") for k in range(len(assertions))], F.lit(True))
    return out.withColumn("feasible", held).withColumn("infeasible", ~held)


def _among(answers: DataFrame, among: str) -> DataFrame:
    return answers if among == "all" else answers.filter(F.col(among))


def ledger(answers: DataFrame, params: list[Param], assertions: list[str]) -> DataFrame:
    """Each question with its feasibility and the assertions that it breaks."""
    broken = F.array_join(F.filter(F.array(*[F.when(~F.col(f"a{k}"), F.lit(t)) for k, t in enumerate(assertions)]), lambda x: x.isNotNull()), "; ")
    return answers.select("q_ix", *[p.name for p in params], "feasible", broken.alias("broken"))


def deltas(answers: DataFrame, names: list[str], base: dict[str, Decimal], among: str = "all") -> DataFrame:
    """(scalar, base, low, low_q, high, high_q, n): extremes of each scalar; the first question wins a tie."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for n in names:
        aggs += [F.min(F.struct(F.col(n), F.col("q_ix"))).alias(f"lo_{n}"), F.min(F.struct((-F.col(n)).alias("m"), F.col("q_ix"))).alias(f"hi_{n}")]
    wide = _among(answers, among).agg(*aggs)
    text = lambda c: c.cast("decimal(30,2)")
    items = [F.struct(F.lit(n).alias("scalar"), text(F.lit(base[n])).alias("base"), text(F.col(f"lo_{n}.{n}")).alias("low"), F.col(f"lo_{n}.q_ix").alias("low_q"), text(-F.col(f"hi_{n}.m")).alias("high"), F.col(f"hi_{n}.q_ix").alias("high_q"), F.col("n")) for n in names]
    return wide.select(F.explode(F.array(*items)).alias("x")).select("x.*")


def gates(answers: DataFrame, assertions: list[str]) -> DataFrame:
    """(assert_ix, text, holds, fails, first_failure) of every assertion over the grid."""
    aggs = []
    for k in range(len(assertions)):
        aggs += [F.count_if(F.col(f"a{k}")).alias(f"h{k}"), F.count_if(~F.col(f"a{k}")).alias(f"f{k}"), F.min(F.when(~F.col(f"a{k}"), F.col("q_ix"))).alias(f"q{k}")]
    items = [F.struct(F.lit(k).alias("assert_ix"), F.lit(t).alias("text"), F.col(f"h{k}").alias("holds"), F.col(f"f{k}").alias("fails"), F.col(f"q{k}").alias("first_failure")) for k, t in enumerate(assertions)]
    return answers.agg(*aggs).select(F.explode(F.array(*items)).alias("x")).select("x.*")


def best(answers: DataFrame, name: str, direction: str = "max", among: str = "feasible") -> DataFrame:
    """The question with the extreme value, the first one on ties, and the number of ties."""
    pool, sign = _among(answers, among), -1 if direction == "max" else 1
    top = pool.agg(F.min(F.struct((F.col(name) * sign).alias("v"), F.col("q_ix").alias("q"))).alias("t"))
    extreme = (F.max if direction == "max" else F.min)(name)
    ties = pool.groupBy(F.col(name).alias("value")).agg(F.count(F.lit(1)).alias("ties"))
    joined = ties.join(pool.agg(extreme.alias("value")), "value")
    return top.select("t.q").crossJoin(F.broadcast(joined)).select(F.col("q").alias("q_ix"), F.col("value").alias(name), "ties")  # one row beside one row


def forbidden(answers: DataFrame, params: list[Param]) -> DataFrame:
    """(param, point) of every point that no feasible question visits."""
    long = answers.select("feasible", F.explode(F.array(*[F.struct(F.lit(p.name).alias("param"), F.col(p.name).cast("decimal(20,6)").alias("point")) for p in params])).alias("x"))
    return long.groupBy("x.param", "x.point").agg(F.bool_or("feasible").alias("any")).filter("not any").select("param", "point")


def slack(answers: DataFrame, sides: dict[int, tuple[Column, str]], count: int) -> DataFrame:
    """(assert_ix, side, distance, q_ix): the nearest question inside each comparison among the feasible, and outside among those that fail it alone."""
    items = []
    for k, (distance, _) in sides.items():
        others = reduce(lambda a, b: a & b, [F.col(f"a{j}") for j in range(count) if j != k], F.lit(True))
        side = F.when(F.col("feasible"), "room").when(~F.col(f"a{k}") & others, "miss")
        items.append(F.struct(F.lit(k).alias("assert_ix"), side.alias("side"), F.abs(distance).cast("decimal(30,6)").alias("distance"), F.col("q_ix")))
    long = answers.select(F.explode(F.array(*items)).alias("x")).select("x.*").filter("side is not null")
    return long.groupBy("assert_ix", "side").agg(F.min(F.struct("distance", "q_ix")).alias("m")).select("assert_ix", "side", "m.distance", "m.q_ix")
