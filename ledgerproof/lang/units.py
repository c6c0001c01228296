"""Unit expressions: products of atoms with integer exponents."""

from __future__ import annotations

import re
from functools import lru_cache

UnitMap = dict[str, int]
SUPERSCRIPT = {c: str(i) for i, c in enumerate("⁰¹²³⁴⁵⁶⁷⁸⁹")} | {"⁻": "-"}
ATOM = re.compile(f"(?:(?![{''.join(SUPERSCRIPT)}])[^\\W\\d_])+")


class UnitError(ValueError):
    """A unit text that has no reading."""


def parse_unit(text: str) -> UnitMap:
    """Read `kg`, `GB/s/GPU`, `m^2`, `m²`, `1/h`, `N⋅m`. One division may not be followed by a product."""
    return dict(_parsed(text))


@lru_cache(maxsize=1 << 12)
def _parsed(text: str) -> UnitMap:
    rest, out, sign, divided, need = text.strip(), {}, 1, False, True
    if not rest:
        raise UnitError("a unit is empty")
    if "%" in rest:
        raise UnitError("% is not a unit")
    if rest.startswith("1/"):
        rest, sign, divided = rest[2:], -1, True
    while rest:
        rest = rest.lstrip()
        if need:
            m = ATOM.match(rest)
            if not m:
                raise UnitError(f"no unit name at {rest!r}")
            atom, rest, power = m[0], rest[m.end():], 1
            if m := re.match(r"\^(-?\d+)", rest):
                power, rest = int(m[1]), rest[m.end():]
            elif m := re.match(f"[{''.join(SUPERSCRIPT)}]+", rest):
                power, rest = int("".join(SUPERSCRIPT[c] for c in m[0])), rest[m.end():]
            out = multiply(out, {atom: sign * power})
            need = False
        else:
            op, rest = rest[0], rest[1:]
            if op == "/":
                sign, divided = -1, True
            elif op in "⋅*·×":
                if divided:
                    raise UnitError(f"{text!r} is ambiguous: a product after a division")
            else:
                raise UnitError(f"{op!r} has no meaning in a unit")
            need = True
    if need:
        raise UnitError("a unit ends with an operator")
    return out


def multiply(a: UnitMap, b: UnitMap, sign: int = 1) -> UnitMap:
    out = dict(a)
    for atom, power in b.items():
        out[atom] = out.get(atom, 0) + sign * power
    return {k: v for k, v in out.items() if v}


def divide(a: UnitMap, b: UnitMap) -> UnitMap:
    return multiply(a, b, -1)


def power(a: UnitMap, n: int) -> UnitMap:
    return {k: v * n for k, v in a.items() if v * n}


def halve(a: UnitMap) -> UnitMap | None:
    """The square root of a unit, or None where an exponent is odd."""
    return None if any(v % 2 for v in a.values()) else {k: v // 2 for k, v in a.items()}


def expand(a: UnitMap, definitions: dict[str, UnitMap], depth: int = 0) -> UnitMap:
    """Replace defined atoms by what they stand for."""
    if depth > 64:
        raise UnitError("unit definitions go in a circle")
    out: UnitMap = {}
    for atom, n in a.items():
        whole = expand(definitions[atom], definitions, depth + 1) if atom in definitions else {atom: 1}
        out = multiply(out, power(whole, n))
    return out


def same(a: UnitMap, b: UnitMap, definitions: dict[str, UnitMap] | None = None) -> bool:
    return expand(a, definitions or {}) == expand(b, definitions or {})


def format_unit(a: UnitMap) -> str:
    """Atoms in code-point order: numerator, then each denominator after a slash."""
    up = [k if v == 1 else f"{k}^{v}" for k, v in sorted(a.items()) if v > 0]
    down = [k if v == -1 else f"{k}^{-v}" for k, v in sorted(a.items()) if v < 0]
    return "/".join(["⋅".join(up) or "1", *down]) if a else "1"


def unit_json(a: UnitMap) -> dict[str, int]:
    return dict(sorted(a.items()))


