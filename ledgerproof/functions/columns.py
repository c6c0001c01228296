"""Formulas as Spark columns: a value and an error code for each row.

Exact lane: sums, products, whole powers, rounding, comparisons and dates stay native DECIMAL expressions, as long as
their digits fit, and so does a quotient that a binding or its ROUND ends with: its rounding is decided by the remainder. Everything else
of a binding (inner quotients, roots, annuities, wide products) goes as a whole to one Arrow function that evaluates it with
Python decimals and rounds once. Errors never short-cut: an error in either branch of a
condition is the row's error, as in document mode.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.syntax import Binary, Call, Day, Expr, Num, Ref, Str, Unary, walk
from ..lang.values import SPARK_DIGITS, Fault, fits, quantize
from .evaluate import evaluate


class Wide(Exception):
    """The expression isn't exact in native columns."""


@dataclass
class Compiled:
    value: Column
    error: Column | None  # null where the row is fine
    type: str  # num, date, str, bool
    digits: int = 0
    scale: int = 0


def _join(*errors: Column | None) -> Column | None:
    some = [e for e in errors if e is not None]
    return None if not some else some[0] if len(some) == 1 else F.coalesce(*some)


def literal(value: Decimal) -> Compiled:
    scale = max(0, -value.as_tuple().exponent)
    digits = max(1, len(value.as_tuple().digits), scale + 1)
    return Compiled(F.lit(value).cast(f"decimal({digits},{scale})"), None, "num", digits, scale)


def _num(c: Compiled) -> Compiled:
    if c.type != "num":
        raise Fault("TYPE", f"a {c.type} stands where a number is needed")
    return c


def _checked(digits: int, scale: int) -> tuple[int, int]:
    if digits > SPARK_DIGITS:
        raise Wide
    return digits, scale


def compile_expression(e: Expr, lookup) -> Compiled:
    """Native columns for an exact expression. `lookup(ref)` gives a Compiled; raises Wide where the lane ends."""
    match e:
        case Num():
            return literal(e.value)
        case Str():
            return Compiled(F.lit(e.value), None, "str")
        case Day():
            return Compiled(F.lit(e.value), None, "date")
        case Ref():
            return lookup(e)
        case Unary("not", arg):
            a = compile_expression(arg, lookup)
            if a.type != "bool":
                raise Fault("TYPE", "not needs a condition")
            return Compiled(~a.value, a.error, "bool")
        case Unary(_, arg):
            a = _num(compile_expression(arg, lookup))
            return Compiled(-a.value, a.error, "num", a.digits, a.scale)
        case Binary(op, left, right):
            return _binary(op, compile_expression(left, lookup), compile_expression(right, lookup), right)
        case Call(name, args):
            return _call(name, [compile_expression(a, lookup) for a in args], args)
    raise Wide


def _binary(op: str, a: Compiled, b: Compiled, right: Expr) -> Compiled:
    error = _join(a.error, b.error)
    if op in ("and", "or"):
        if (a.type, b.type) != ("bool", "bool"):
            raise Fault("TYPE", f"{op} needs conditions")
        return Compiled(a.value & b.value if op == "and" else a.value | b.value, error, "bool")
    if op in ("==", "!="):
        if a.type != b.type:
            return Compiled(F.lit(op == "!="), error, "bool")
        return Compiled(a.value == b.value if op == "==" else a.value != b.value, error, "bool")
    if op in ("<", "<=", ">", ">="):
        if a.type != b.type or a.type == "bool":
            raise Fault("TYPE", f"{op} compares two values of one type, not {a.type} and {b.type}")
        value = {"<": a.value < b.value, "<=": a.value <= b.value, ">": a.value > b.value, ">=": a.value >= b.value}[op]
        return Compiled(value, error, "bool")
    if op == "+" and (a.type, b.type) == ("num", "date"):
        a, b = b, a
    if a.type == "date" and op in "+-":
        if b.type == "date" and op == "-":
            return Compiled(F.datediff(a.value, b.value).cast("decimal(10,0)"), error, "num", 10, 0)
        _num(b)
        days = b.value.cast("int")
        whole = F.when(b.value != b.value.cast("decimal(10,0)"), F.lit("TYPE"))
        return Compiled(F.date_add(a.value, days if op == "+" else -days), _join(error, whole if b.scale else None), "date")
    a, b = _num(a), _num(b)
    if op in "+-":
        scale = max(a.scale, b.scale)
        digits, scale = _checked(max(a.digits - a.scale, b.digits - b.scale) + scale + 1, scale)
        return Compiled(a.value + b.value if op == "+" else a.value - b.value, error, "num", digits, scale)
    if op == "*":
        digits, scale = _checked(a.digits + b.digits + 1, a.scale + b.scale)
        return Compiled(a.value * b.value, error, "num", digits, scale)
    if op == "^" and isinstance(right, Num) and right.value == right.value.to_integral_value() and 0 <= right.value <= 16:
        out = literal(Decimal(1))
        for k in range(int(right.value)):
            out = a if k == 0 else _binary("*", out, a, right)
        return Compiled(out.value, error, "num", out.digits, out.scale)
    raise Wide


def _call(name: str, v: list[Compiled], args: tuple) -> Compiled:
    error = _join(*[x.error for x in v])
    if name == "IF":
        if v[0].type != "bool":
            raise Fault("TYPE", "IF needs a condition")
        if v[1].type != v[2].type:
            raise Wide
        scale = max(v[1].scale, v[2].scale)
        digits = max(v[1].digits - v[1].scale, v[2].digits - v[2].scale) + scale
        return Compiled(F.when(v[0].value, v[1].value).otherwise(v[2].value), error, v[1].type, digits, scale)
    if name == "EOMONTH":
        if v[0].type != "date" or v[1].scale:
            raise Wide
        at = F.year(v[0].value) * 12 + F.month(v[0].value) - 1 + v[1].value.cast("int")
        out = F.last_day(F.add_months(F.trunc(v[0].value, "MM"), v[1].value.cast("int")))
        bad = F.when((at < 12) | (at >= 120000), F.lit("DATE"))
        return Compiled(out, _join(error, bad), "date")
    x = [_num(c) for c in v]
    if name == "ROUND" and isinstance(args[1], Num) and args[1].value == args[1].value.to_integral_value() and args[1].value >= 0:
        places = int(args[1].value)
        digits = x[0].digits - x[0].scale + places + 1
        _checked(digits, places)
        return Compiled(F.round(x[0].value, places).cast(f"decimal({digits},{places})"), error, "num", digits, places)
    if name == "ABS":
        return Compiled(F.abs(x[0].value), error, "num", x[0].digits, x[0].scale)
    if name in ("MOD", "FLOOR", "CEILING"):
        scale = max(x[0].scale, x[1].scale)
        whole = max(x[0].digits - x[0].scale, x[1].digits - x[1].scale) + 1
        digits, scale = _checked(whole + scale, scale)
        typed = f"decimal({digits},{scale})"
        a, b = x[0].value.cast(typed), x[1].value.cast(typed)
        if name == "MOD":
            safe = F.when(b != 0, b)
            return Compiled((a % safe).cast(typed), _join(error, F.when(b == 0, F.lit("TYPE"))), "num", digits, scale)
        safe = F.when(b > 0, b)
        value = a - F.pmod(a, safe) if name == "FLOOR" else -((-a) - F.pmod(-a, safe))
        return Compiled(value.cast(typed), _join(error, F.when(b <= 0, F.lit("TYPE"))), "num", digits, scale)
    raise Wide


def domain_fault(value: Column, domain) -> Column:
    """The clause of a parameter's domain that a value breaks first, as `in_range` says it, or null."""
    whole = value == F.floor(value)
    presets = {"integer": ~whole, "natural": ~whole | (value < 0), "positive": value <= 0, "positive integer": ~whole | (value <= 0)}
    tests = [(presets[p], p) for p in domain.presets]
    for lo, lo_open, hi, hi_open in domain.ranges:
        outside = (value <= lo if lo_open else value < lo) | (value >= hi if hi_open else value > hi)
        tests.append((outside, f"{'(' if lo_open else '['}{lo}, {hi}{')' if hi_open else ']'}"))
    tests += [(~value.isin(items), "{" + ", ".join(map(str, items)) + "}") for items in domain.sets]
    out = F.lit(None).cast("string")
    for broken, clause in reversed(tests):
        out = F.when(broken, F.lit(clause)).otherwise(out)
    return out


def closest_name(target: Column, names: Column) -> Column:
    """The name of an array that is nearest to `target`, as `closest` ranks them: edit distance, then common beginning, then alphabet."""
    def ranked(name):
        short = F.least(F.length(target), F.length(name))
        common = F.size(F.filter(F.sequence(F.lit(0), short), lambda k: F.left(target, k) == F.left(name, k))) - 1
        return F.struct(F.levenshtein(target, name).alias("distance"), (-common).alias("common"), name.alias("name"))

    return F.array_min(F.transform(names, ranked))


def quotient(n: Compiled, d: Compiled, places: int) -> Compiled:
    """n / d rounded half away from zero at `places`: both as whole numbers, divided with remainder. Raises Wide where digits don't fit."""
    n, d = _num(n), _num(d)
    up, down = max(n.scale, d.scale + places), d.scale + max(0, n.scale - d.scale - places)
    whole = n.digits - n.scale + d.scale + places + 1  # of the result, as a whole number
    if max(n.digits + up + 2, d.digits + down + 2, whole + places + 1) > SPARK_DIGITS:
        raise Wide
    shift = lambda v, k: v * F.lit(Decimal(10) ** k).cast(f"decimal({k + 1},0)")
    top, below = shift(n.value, up).cast(f"decimal({n.digits + up},0)"), shift(d.value, down).cast(f"decimal({d.digits + down},0)")
    a, b = F.abs(top), F.when(below != 0, F.abs(below))
    rest = a % b
    size = ((a - rest) / b).cast(f"decimal({whole},0)") + F.when(rest >= b - rest, 1).otherwise(0)
    signed = F.when((top < 0) != (below < 0), -size).otherwise(size)
    value = signed.cast(f"decimal({whole},0)") * F.lit(Decimal(1).scaleb(-places)).cast(f"decimal({max(1, places)},{places})")
    return Compiled(value.cast(f"decimal({whole},{places})"), _join(n.error, d.error, F.when(d.value == 0, F.lit("TYPE"))), "num", whole, places)


def compile_rounded(e: Expr, lookup, places: int | None) -> Compiled:
    """compile_expression, with a quotient that ends the expression at the width it is rounded to anyway."""
    if isinstance(e, Binary) and e.op == "/" and places is not None:
        return quotient(compile_expression(e.left, lookup), compile_expression(e.right, lookup), places)
    if isinstance(e, Call) and e.name == "ROUND" and isinstance(e.args[0], Binary) and e.args[0].op == "/" and isinstance(e.args[1], Num):
        own = e.args[1].value
        if own == own.to_integral_value() and 0 <= own <= 12:
            return quotient(compile_expression(e.args[0].left, lookup), compile_expression(e.args[0].right, lookup), int(own))
    return compile_expression(e, lookup)


def wide_column(e: Expr, places: int, inputs: dict[Ref, Compiled], constants: dict[Ref, object], reduces: dict) -> tuple[Column, Column | None]:
    """(value rounded to `places`, error) by one Arrow function over the columns that the formula reads."""
    refs = [r for r in dict.fromkeys(x for x in walk(e) if isinstance(x, Ref)) if r in inputs]
    settled = _settled(e, reduces)

    @F.pandas_udf(f"value decimal(38,{places}), error string")
    def run(*columns: pd.Series) -> pd.DataFrame:
        values, errors = [], []
        for row in zip(*columns, strict=True):
            here = dict(zip(refs, row, strict=True)) | constants
            try:
                if any(x is None for x in row):
                    raise Fault("TYPE", "a blank where a value is needed")
                v = evaluate(settled, here.__getitem__, None)
                if not isinstance(v, Decimal):
                    raise Fault("TYPE", "the result is not a number")
                if not fits(v, places, SPARK_DIGITS):
                    raise Fault("PRECISION", "too many digits")
                values.append(quantize(v, places))
                errors.append(None)
            except Fault as f:
                values.append(None)
                errors.append(f.code)
        return pd.DataFrame({"value": values, "error": errors})

    out = run(*[inputs[r].value for r in refs]) if refs else None
    if out is None:
        raise Wide
    return out["value"], _join(*[inputs[r].error for r in refs], out["error"])


def _settled(e: Expr, reduces: dict) -> Expr:
    """The expression with its reduces replaced by their values."""
    if isinstance(e, Call):
        key = (e.name, *e.args)
        if key in reduces:
            v = reduces[key]
            return Num(v, max(0, -v.as_tuple().exponent), str(v)) if isinstance(v, Decimal) else Day(v)
        return Call(e.name, tuple(_settled(a, reduces) for a in e.args))
    if isinstance(e, Binary):
        return Binary(e.op, _settled(e.left, reduces), _settled(e.right, reduces))
    if isinstance(e, Unary):
        return Unary(e.op, _settled(e.arg, reduces))
    return e
