"""Grids of any number of questions over a large sheet, from statistics of the sheet that no question changes.

A rule made of sums and products is a sum of parts, each a product of columns times an expression of the parameters. Where the rule's width keeps all
decimals, its SUM for any question is made of the columns' sums. Where it rounds, a rule of one part needs more: how a row is rounded depends on its columns' product modulo a power of
ten alone, so rows are counted by that remainder (and sign), a table whose size the decimals bound and the sheet doesn't. MIN and MAX follow the product's ends. So the sheet is read
twice at most, and questions are priced against the statistics in tasks of their own.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Context, Decimal, localcontext

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lang.syntax import Binary, Call, Expr, Num, Ref, Unary

#: Decimals that a rule may round away by remainders: 10^DROPPED classes of rows for each sign, at most.
DROPPED = 6
#: Parameters and their products are exact in this many digits.
EXACT = Context(prec=200)
#: Names of a product (with repeats, sorted) to its coefficient.
Polynomial = dict[tuple[str, ...], Decimal]


class Inseparable(Exception):
    """A rule that isn't a sum of products of columns and parameters."""


def _times(a: Polynomial, b: Polynomial) -> Polynomial:
    out: Polynomial = {}
    for x, p in a.items():
        for y, q in b.items():
            key = tuple(sorted(x + y))
            out[key] = EXACT.add(out.get(key, Decimal(0)), EXACT.multiply(p, q))
    return out


def _plus(a: Polynomial, b: Polynomial, sign: int) -> Polynomial:
    out = dict(a)
    for key, v in b.items():
        out[key] = EXACT.add(out.get(key, Decimal(0)), EXACT.multiply(Decimal(sign), v))
    return out


def polynomial(e: Expr, known: set[str]) -> Polynomial:
    """The formula multiplied out, over the names that are known."""
    match e:
        case Num() if not e.unit:
            return {(): e.value}
        case Ref() if e.sheet is None and e.name in known:
            return {(e.name,): Decimal(1)}
        case Unary("-", arg):
            return _times({(): Decimal(-1)}, polynomial(arg, known))
        case Binary("+" | "-" as op, left, right):
            return _plus(polynomial(left, known), polynomial(right, known), 1 if op == "+" else -1)
        case Binary("*", left, right):
            return _times(polynomial(left, known), polynomial(right, known))
        case Binary("^", base, Num() as n) if n.value == n.value.to_integral_value() and 1 <= n.value <= 8:
            out = polynomial(base, known)
            for _ in range(int(n.value) - 1):
                out = _times(out, polynomial(base, known))
            return out
    raise Inseparable


@dataclass
class Part:
    """columns: the names of a product of columns; weight: the polynomial of the parameters that it is multiplied by."""

    columns: tuple[str, ...]
    weight: Polynomial

    def scale(self, scales: dict[str, int]) -> int:
        return sum(scales[c] for c in self.columns)

    def weight_scale(self, scales: dict[str, int]) -> int:
        return max((sum(scales[p] for p in names) + max(0, -v.normalize(EXACT).as_tuple().exponent) for names, v in self.weight.items()), default=0)


def parts_of(e: Expr, columns: set[str], params: set[str]) -> list[Part]:
    """The parts of a rule, by their columns; a parameter hides a column of its name."""
    out: dict[tuple[str, ...], Polynomial] = {}
    for names, v in polynomial(e, columns | params).items():
        if v:
            mine = tuple(n for n in names if n not in params)
            given = tuple(n for n in names if n in params)
            weight = out.setdefault(mine, {})
            weight[given] = EXACT.add(weight.get(given, Decimal(0)), v)
    return [Part(c, w) for c, w in out.items()]


class Statistics:
    """What the reduces of one rule need of a sheet. `reduces`: name to SUM, MIN, MAX or COUNT of the rule."""

    def __init__(self, frame: DataFrame, rule: Expr, places: int, reduces: dict[str, str], params: dict[str, int]):
        types = {f.name: f.dataType for f in frame.schema.fields if isinstance(f.dataType, T.DecimalType)}
        self.frame, self.places, self.reduces = frame, places, reduces
        self.parts = parts_of(rule, set(types), set(params))
        scales = {c: t.scale for c, t in types.items()}
        self.scales = [(p.scale(scales), p.weight_scale(params)) for p in self.parts]
        self.scale = max((a + b for a, b in self.scales), default=0)
        self.rounds = self.scale > places
        one = len(self.parts) == 1
        if self.rounds and (not one or self.scale - places > DROPPED) or not one and {"MIN", "MAX"} & set(reduces.values()):
            raise Inseparable
        # the product of a row's columns, at 38 digits at most
        for p in self.parts:
            if sum(types[c].precision for c in p.columns) > 38:
                raise Inseparable

    def _product(self, p: Part) -> Column:
        out = F.lit(Decimal(1))
        for c in p.columns:
            out = out * F.col(f"`{c}`")
        return out

    def read(self) -> None:
        """One scan for counts, sums and ends, and one for the remainders of a rule that rounds."""
        values = [self._product(p).cast(f"decimal(38,{s})") for p, (s, _) in zip(self.parts, self.scales, strict=True)]
        whole = F.lit(True)
        for v in values:
            whole = whole & v.isNotNull()
        rows = self.frame.select(*[v.alias(f"v{k}") for k, v in enumerate(values)], whole.alias("whole"))
        aggs = [F.count(F.lit(1)).alias("n"), F.count_if("whole").alias("valued")]
        for k in range(len(values)):
            own = F.when(F.col("whole"), F.col(f"v{k}"))
            aggs += [F.sum(own).alias(f"s{k}"), F.min(own).alias(f"low{k}"), F.max(own).alias(f"high{k}")]
        got = rows.agg(*aggs).first()
        self.n, self.valued = got.n, got.valued
        self.sums = [self._whole(got[f"s{k}"], s) for k, (s, _) in enumerate(self.scales)]
        self.ends = [(self._whole(got[f"low{k}"], s), self._whole(got[f"high{k}"], s)) for k, (s, _) in enumerate(self.scales)]
        self.classes = None
        if self.rounds and "SUM" in self.reduces.values() and self.valued:
            size = 10 ** (self.scale - self.places)
            unit = F.lit(Decimal(size).scaleb(-self.scales[0][0])).cast("decimal(38,10)")
            left = (F.abs("v0") % unit * 10 ** self.scales[0][0]).cast("long")
            counted = rows.filter("whole").groupBy(left.alias("left"), (F.col("v0") < 0).alias("below")).agg(F.count(F.lit(1)).alias("n")).toArrow()
            sign = np.where(counted.column("below").to_numpy(zero_copy_only=False), -1, 1)
            self.classes = counted.column("left").to_numpy().astype(np.int64), sign * counted.column("n").to_numpy()  # 2 * 10**DROPPED rows at most

    @staticmethod
    def _whole(v: Decimal | None, scale: int) -> int:
        return 0 if v is None else int(v.scaleb(scale, EXACT))

    def weights(self, given: dict[str, Decimal]) -> list[int]:
        """The parts' weights as whole numbers at their scales."""
        out = []
        with localcontext(EXACT):
            for p, (_, t) in zip(self.parts, self.scales, strict=True):
                total = Decimal(0)
                for names, v in p.weight.items():
                    for name in names:
                        v = v * given[name]
                    total += v
                out.append(int(total.scaleb(t)))
        return out

    def answer(self, weights: list[int]) -> dict[str, Decimal | None]:
        out = {}
        for name, how in self.reduces.items():
            if how == "COUNT":
                out[name] = Decimal(self.n)
            elif how == "SUM":
                out[name] = self._sum(weights)
            elif not self.valued:
                out[name] = None
            else:
                (low, high), w = self.ends[0] if self.ends else (0, 0), weights[0] if weights else 0
                ends = self._rounded(low * w), self._rounded(high * w)
                out[name] = Decimal(min(ends) if how == "MIN" else max(ends)).scaleb(-self.places, EXACT)
        return out

    def _rounded(self, v: int) -> int:
        """A value at the rule's full scale, half up at its width."""
        if not self.rounds:
            return v * 10 ** (self.places - self.scale)
        size = 10 ** (self.scale - self.places)
        half = (2 * abs(v) + size) // (2 * size)
        return -half if v < 0 else half

    def _sum(self, weights: list[int]) -> Decimal:
        if not self.rounds:
            full = sum(w * s * 10 ** (self.scale - a - b) for w, s, (a, b) in zip(weights, self.sums, self.scales, strict=True))
            return Decimal(full * 10 ** (self.places - self.scale)).scaleb(-self.places, EXACT)
        if self.classes is None:
            return Decimal(0)
        size, w = 10 ** (self.scale - self.places), abs(weights[0])
        left, n = self.classes
        rest = left * (w % size) % size
        rest = np.where(2 * rest >= size, rest - size, rest)
        # what rounding takes away from the rows' sizes, signs put back
        away = int((rest * n).sum()) if self.valued * size < 1 << 62 else sum(int(a) * int(b) for a, b in zip(rest, n, strict=True))
        total = (self.sums[0] * w - away) // size
        return Decimal(total if weights[0] >= 0 else -total).scaleb(-self.places, EXACT)


def priced(stats: Statistics, questions: DataFrame, params: dict[str, int]) -> DataFrame:
    """(q_ix, parameters, reduces) of every question, a row of `questions` (q_ix and a column for each parameter) each."""
    stats.read()
    frame, stats.frame = stats.frame, None  # tasks get the statistics alone
    held = frame.sparkSession.sparkContext.broadcast(stats)
    names = list(params)

    def run(batches):
        own, known = held.value, {}
        for pdf in batches:
            rows = []
            for values in zip(*[pdf[p] for p in names], strict=True):
                weights = tuple(own.weights(dict(zip(names, values, strict=True))))
                if weights not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[weights] = own.answer(list(weights))
                rows.append(known[weights])
            yield pd.concat([pdf, pd.DataFrame({n: pd.Series([r[n] for r in rows], dtype=object) for n in own.reduces})], axis=1)

    wide = [f"{n} decimal(38,{0 if how == 'COUNT' else stats.places})" for n, how in stats.reduces.items()]
    schema = ", ".join(["q_ix long", *[f"{p} decimal(20,{s})" for p, s in params.items()], *wide])
    return questions.select("q_ix", *names).mapInPandas(run, schema)


def reduce_of(e: Expr) -> tuple[str, str] | None:
    """(SUM, MIN, MAX or COUNT, column) of a plain reduce."""
    return (e.name, e.args[-1].name) if isinstance(e, Call) and e.name in ("SUM", "MIN", "MAX", "COUNT") and len(e.args) == 1 and isinstance(e.args[0], Ref) and e.args[0].sheet is None else None
