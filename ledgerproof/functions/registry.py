"""The closed table of functions: kind, arity, width, unit rule and documentation of each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

MAP, REDUCE = "map", "reduce"


@dataclass(frozen=True)
class Function:
    name: str
    kind: str
    arity: int
    #: Position of the column argument of a reduce.
    column: int | None
    signature: str
    about: str
    #: Width of the result from the widths and literal values of the arguments; None where undefined.
    width: Callable[[list[int | None], list], int | None]
    example: tuple[str, str]


def _same(widths, _):
    return widths[-1]


def _none(*_):
    return None


def _wider(widths, _):
    known = widths[-2:]
    return None if None in known else max(known)


def _literal_places(widths, args):
    from ..lang.syntax import Num

    a = args[1] if len(args) > 1 else None
    return int(a.value) if isinstance(a, Num) and a.value == a.value.to_integral_value() and a.value >= 0 else None


TABLE = {
    f.name: f
    for f in (
        Function("SUM", REDUCE, 1, 0, "SUM(column)", "The exact sum; 0 of an empty column.", _same, ("SUM(t.Amount)", "60")),
        Function("AVG", REDUCE, 1, 0, "AVG(column)", "Sum over number of rows; its width must be declared.", _none, ("AVG(t.Amount)", "20")),
        Function("MIN", REDUCE, 1, 0, "MIN(column)", "The least number or date.", _same, ("MIN(t.Amount)", "10")),
        Function("MAX", REDUCE, 1, 0, "MAX(column)", "The greatest number or date.", _same, ("MAX(t.Amount)", "30")),
        Function("COUNT", REDUCE, 1, 0, "COUNT(column)", "The number of rows, blanks included.", lambda *_: 0, ("COUNT(t.Amount)", "3")),
        Function("NPV", REDUCE, 2, 1, "NPV(rate, column)", "Present value; row 1 isn't discounted.", _none, ("NPV(0, t.Cash)", "12000")),
        Function("IRR", REDUCE, 1, 0, "IRR(column)", "The rate at which the flows are worth nothing.", _none, ("IRR(t.Pair)", "0.1")),
        Function("ROUND", MAP, 2, None, "ROUND(x, places)", "Half away from zero.", _literal_places, ("ROUND(2.345, 2)", "2.35")),
        Function("ABS", MAP, 1, None, "ABS(x)", "Without the sign.", _same, ("ABS(0 - 3)", "3")),
        Function("MOD", MAP, 2, None, "MOD(x, y)", "Remainder with the sign of x.", _wider, ("MOD(0 - 7, 3)", "-1")),
        Function("SQRT", MAP, 1, None, "SQRT(x)", "The square root of a number not below 0.", _none, ("SQRT(16)", "4")),
        Function("FLOOR", MAP, 2, None, "FLOOR(x, step)", "The greatest multiple of step up to x.", _same, ("FLOOR(0 - 7, 3)", "-9")),
        Function("CEILING", MAP, 2, None, "CEILING(x, step)", "The least multiple of step from x.", _same, ("CEILING(7, 3)", "9")),
        Function("IF", MAP, 3, None, "IF(condition, a, b)", "a or b; all three are evaluated.", _wider, ("IF(2 > 1, 5, 6)", "5")),
        Function("EOMONTH", MAP, 2, None, "EOMONTH(date, months)", "The last day of the month so many months on.", lambda *_: None, ("EOMONTH(2026-01-15, 2)", "2026-03-31")),
        Function("PMT", MAP, 3, None, "PMT(rate, periods, present)", "The level payment of a loan.", _none, ("PMT(0, 4, 100)", "25")),
    )
}
REDUCES = frozenset(n for n, f in TABLE.items() if f.kind == REDUCE)


def reference() -> list[dict]:
    """The functions as rows: what a `ref` command prints."""
    return [{"name": f.name, "kind": f.kind, "signature": f.signature, "about": f.about, "example": f.example[0], "result": f.example[1]} for f in TABLE.values()]
