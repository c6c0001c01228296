"""Syntax trees of formulas and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal

from .units import UnitMap


@dataclass(frozen=True)
class Num:
    value: Decimal
    places: int
    text: str
    unit: tuple[tuple[str, int], ...] = ()
    percent: bool = False


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Day:
    value: date


@dataclass(frozen=True)
class Ref:
    name: str
    sheet: str | None = None

    def __str__(self) -> str:
        return f"{self.sheet}.{self.name}" if self.sheet else self.name


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


Expr = Num | Str | Day | Ref | Call | Unary | Binary
LEVEL = {"or": 1, "and": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "^": 6}


def source(e: Expr, least: int = 0) -> str:
    """The expression as text with the parentheses it needs."""
    match e:
        case Num():
            unit = "" if not e.unit else f" [{_unit(dict(e.unit))}]"
            return e.text + unit
        case Str():
            return f'"{e.value}"'
        case Day():
            return e.value.isoformat()
        case Ref():
            return str(e)
        case Call():
            return f"{e.name}({', '.join(source(a) for a in e.args)})"
        case Unary():
            level = 2 if e.op == "not" else 5
            text = ("not " if e.op == "not" else "-") + source(e.arg, level + 1)
        case Binary():
            level = LEVEL[e.op]
            right = e.op == "^"
            text = f"{source(e.left, level + (right or level == 3))} {e.op} {source(e.right, level + (not right))}"
    return f"({text})" if level < least else text


def _unit(unit: UnitMap) -> str:
    from .units import format_unit

    return format_unit(unit)


def walk(e: Expr):
    """The expression and everything below it."""
    yield e
    for x in e.args if isinstance(e, Call) else (e.arg,) if isinstance(e, Unary) else (e.left, e.right) if isinstance(e, Binary) else ():
        yield from walk(x)


@dataclass
class Domain:
    """A parameter's legal values: all clauses must hold. A bound is (value, open)."""

    ranges: list[tuple[Decimal, bool, Decimal, bool]] = field(default_factory=list)
    sets: list[list[Decimal]] = field(default_factory=list)
    presets: list[str] = field(default_factory=list)
    percent: bool = False


@dataclass
class Binding:
    target: str
    expr: Expr
    text: str
    places: int | None = None
    unit: UnitMap | None = None
    quoted: bool = False
    param: bool = False
    domain: Domain | None = None
    step: Num | None = None
    at: int = 0


@dataclass
class Alias:
    header: str
    name: str
    at: int = 0


@dataclass
class Assertion:
    expr: Expr
    text: str
    at: int = 0


@dataclass
class UnitDefinition:
    atom: str
    unit: UnitMap
    at: int = 0


@dataclass
class Chart:
    name: str
    engine: str
    series: list[str]
    label: str
    aspect: tuple[int, int] = (16, 9)
    at: int = 0


@dataclass
class Report:
    kind: str  # ledger, deltas, gates, best, forbidden, slack
    text: str
    names: list[Ref] = field(default_factory=list)
    among: str = "all"
    direction: str = "max"
    at: int = 0


Statement = Binding | Alias | Assertion | UnitDefinition | Chart | Report
