"""Widths and units of expressions, found before anything is evaluated."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from ..functions.registry import TABLE
from ..lang.syntax import Binary, Call, Day, Expr, Num, Ref, Unary
from ..lang.units import UnitMap, divide, expand, format_unit, halve, multiply, power
from ..lang.values import Fault

DATE = "date"


def width(e: Expr, lookup: Callable[[Ref], int | None | str]) -> int | None | str:
    """Decimals of an exact result: a number, None where it has no end, or "date".

    Products add widths, sums take the wider one, quotients have none; functions say for themselves.
    """
    match e:
        case Num():
            return e.places
        case Day():
            return DATE
        case Ref():
            return lookup(e)
        case Unary("-", arg):
            return width(arg, lookup)
        case Call(name, args) if name in TABLE:
            known = [width(a, lookup) for a in args]
            if name == "EOMONTH" or name in ("MIN", "MAX") and known[-1] == DATE:
                return DATE
            return TABLE[name].width([None if k == DATE else k for k in known], list(args))
        case Binary(op, left, right):
            a, b = width(left, lookup), width(right, lookup)
            if DATE in (a, b):
                return 0 if (a, b, op) == (DATE, DATE, "-") else DATE if op in "+-" and a == DATE != b or op == "+" and b == DATE != a else None
            if a is None or b is None:
                return None
            if op in ("+", "-"):
                return max(a, b)
            if op == "*":
                return a + b
            if op == "^" and isinstance(right, Num) and right.value == right.value.to_integral_value() and right.value >= 0:
                return a * int(right.value)
    return None


def unit_of(e: Expr, lookup: Callable[[Ref], UnitMap | None], defs: dict[str, UnitMap]) -> UnitMap:
    """The unit of a formula; UNIT faults where operands disagree. Numbers without a unit are dimensionless."""
    def same(a: UnitMap, b: UnitMap, what: str) -> UnitMap:
        if expand(a, defs) != expand(b, defs):
            raise Fault("UNIT", f"{what} of [{format_unit(a)}] and [{format_unit(b)}]")
        return a

    def zero(x: Expr) -> bool:
        return isinstance(x, Num) and x.value == 0 and not x.unit

    match e:
        case Num():
            return dict(e.unit)
        case Ref():
            return lookup(e) or {}
        case Unary(_, arg):
            return unit_of(arg, lookup, defs)
        case Binary(op, left, right):
            a, b = unit_of(left, lookup, defs), unit_of(right, lookup, defs)
            if op == "*":
                return multiply(a, b)
            if op == "/":
                return divide(a, b)
            if op == "^":
                if b:
                    raise Fault("UNIT", "an exponent has a unit")
                if not a:
                    return {}
                if not (isinstance(right, Num) and right.value == right.value.to_integral_value() and right.value >= 0):
                    raise Fault("UNIT", "a value with a unit takes a whole literal exponent")
                return power(a, int(right.value))
            if op in ("and", "or"):
                return {}
            joined = b if zero(left) else a if zero(right) else same(a, b, f"{op}")
            return joined if op in "+-" else {}
        case Call(name, args):
            units = [unit_of(a, lookup, defs) for a in args]
            if name in ("COUNT", "EOMONTH"):
                return {}
            if name == "SQRT":
                half = halve(expand(units[0], defs))
                if half is None:
                    raise Fault("UNIT", f"SQRT of [{format_unit(units[0])}]")
                return half
            if name in ("NPV", "PMT"):
                if any(units[:-1]):
                    raise Fault("UNIT", f"the rate of {name} has a unit")
                return units[-1]
            if name == "IRR":
                return {}
            if name == "ROUND":
                return units[0]
            if name in ("MOD", "FLOOR", "CEILING"):
                return units[0] if not units[1] or zero(args[1]) else same(*units, name)
            if name == "IF":
                return units[2] if zero(args[1]) else units[1] if zero(args[2]) else same(units[1], units[2], "IF")
            return units[-1] if units else {}
    return {}


def in_range(value: Decimal, domain) -> str | None:
    """None where a value lies in a domain, else the clause that it breaks."""
    for preset in domain.presets:
        whole = value == value.to_integral_value()
        bad = {"integer": not whole, "natural": not whole or value < 0, "positive": value <= 0, "positive integer": not whole or value <= 0}[preset]
        if bad:
            return preset
    for lo, lo_open, hi, hi_open in domain.ranges:
        if value < lo or value > hi or lo_open and value == lo or hi_open and value == hi:
            return f"{'(' if lo_open else '['}{lo}, {hi}{')' if hi_open else ']'}"
    for items in domain.sets:
        if value not in items:
            return "{" + ", ".join(map(str, items)) + "}"
    return None
