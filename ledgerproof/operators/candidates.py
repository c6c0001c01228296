"""Candidate rules T = A op B of wide sheets, by fingerprints of sampled rows.

A rule that misses at most m rows misses none in one of m + 1 disjoint groups of rows. For each group every target has the fingerprint of its cells there, and so has each pair of
operands under each operation; pairs whose fingerprint is a target's are found by lookup, so the work grows with the square of the columns and not with
their cube. Cells are whole numbers at their scales and rounded as the columns' types round them. What a sample can't refute is counted over all rows afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
from pyspark.sql import types as T

#: Rows of a group; a chance agreement in all of them is next to impossible, and costs a counter if it happens.
GROUP_ROWS = 12
#: Digits of a DECIMAL, and decimals that it keeps however many digits stand before the point.
MOST_DIGITS, LEAST_SCALE = 38, 6


def result_scale(op: str, a: T.DecimalType, b: T.DecimalType) -> int:
    """Decimals of A op B as Spark computes it; / as TRY_DIVIDE of A at DECIMAL(30, 12)."""
    if op in "+-":
        scale = max(a.scale, b.scale)
        digits = scale + max(a.precision - a.scale, b.precision - b.scale) + 1
    elif op == "*":
        digits, scale = a.precision + b.precision + 1, a.scale + b.scale
    else:
        scale = max(LEAST_SCALE, 12 + b.precision + 1)
        digits = 30 - 12 + b.scale + scale
    if digits <= MOST_DIGITS:
        return scale
    return max(MOST_DIGITS - (digits - scale), min(scale, LEAST_SCALE))


def half_up(n: np.ndarray, d) -> np.ndarray:
    """n / d rounded half away from zero, whole numbers; d is positive."""
    size = (2 * abs(n) + d) // (2 * d)
    return np.where(n < 0, -size, size)


def _shift(n: np.ndarray, places: int) -> np.ndarray:
    return n * 10**places if places >= 0 else half_up(n, 10**-places)


class Sample:
    """Rows of a sheet as whole numbers, a row each; None where a cell is empty."""

    def __init__(self, columns: dict[str, list[Decimal | None]], types: dict[str, T.DecimalType]):
        self.types = types
        self.names = list(columns)
        self.cells = {c: [None if v is None else int(v.scaleb(types[c].scale)) for v in values] for c, values in columns.items()}
        self.rows = len(next(iter(columns.values()))) if columns else 0

    def column(self, name: str, rows: list[int]) -> np.ndarray:
        return np.array([self.cells[name][r] for r in rows], object)

    def groups(self, names: list[str], n: int) -> list[list[int]] | None:
        """n groups of rows in which all of the columns have a cell, different rows as far as there are any; None where there aren't n."""
        seen, rows = set(), []
        for r in range(self.rows):
            row = tuple(self.cells[c][r] for c in names)
            if None not in row and row not in seen:
                seen.add(row)
                rows.append(r)
        size = min(GROUP_ROWS, len(rows) // n)
        return [rows[k * size: (k + 1) * size] for k in range(n)] if size else None

    def candidates(self, most_misses: int) -> Iterator[tuple[str, str, str, str]]:
        """(target, op, a, b) that at most so many of the sampled rows refute; all others are refuted. Some may still miss more rows elsewhere."""
        filled = {c: sum(v is not None for v in self.cells[c]) for c in self.names}
        dense = [c for c in self.names if 2 * filled[c] > self.rows]
        groups = self.groups(dense, most_misses + 1) if len(dense) > 2 else None
        if groups is None:
            dense = []
        found = {}
        for rows in groups or []:
            columns = {c: self.column(c, rows) for c in dense}
            targets: dict[tuple[int, tuple], list[str]] = {}
            for c in dense:
                targets.setdefault((self.types[c].scale, tuple(columns[c])), []).append(c)
            scales = {s for s, _ in targets}
            for i, a in enumerate(dense):
                for k, b in enumerate(dense):
                    if a == b:
                        continue
                    for op in "*+-/" if i < k else "-/":
                        for scale in scales:
                            got = _applied(op, columns[a], columns[b], self.types[a], self.types[b], scale)
                            for t in targets.get((scale, tuple(got)), ()) if got is not None else ():
                                if t not in (a, b):
                                    found[t, op, a, b] = None
        yield from found
        sparse = [c for c in self.names if c not in dense]
        if sparse:
            yield from self._one_by_one(set(sparse), most_misses)

    def _one_by_one(self, sparse: set[str], most_misses: int) -> Iterator[tuple[str, str, str, str]]:
        """Candidates that read or compute a column with many empty cells: each is followed to the row that refutes it."""
        filled = {c: sum(1 << r for r, v in enumerate(cells) if v is not None) for c, cells in self.cells.items()}
        for i, a in enumerate(self.names):
            for k, b in enumerate(self.names):
                both = filled[a] & filled[b]
                for t in self.names if a != b else ():
                    if t in (a, b) or not sparse & {t, a, b}:
                        continue
                    for op in "*+-/" if i < k else "-/":
                        if self._stands(op, t, a, b, both & filled[t], most_misses):
                            yield t, op, a, b

    def _stands(self, op: str, t: str, a: str, b: str, usable: int, most_misses: int) -> bool:
        missed = 0
        for _ in range(GROUP_ROWS * (most_misses + 1)):
            if not usable:
                break
            r = (usable & -usable).bit_length() - 1
            usable &= usable - 1
            got = _applied(op, self.column(a, [r]), self.column(b, [r]), self.types[a], self.types[b], self.types[t].scale)
            missed += got is None or got[0] != self.cells[t][r]
            if missed > most_misses:
                return False
        return True


def _applied(op: str, x: np.ndarray, y: np.ndarray, a: T.DecimalType, b: T.DecimalType, scale: int) -> np.ndarray | None:
    """Whole numbers x op y at `scale`, rounded first as Spark rounds the result's type; None where a divisor is zero."""
    own = result_scale(op, a, b)
    if op == "/":
        if not all(y):
            return None
        up = own + b.scale - a.scale
        n, d = (x * 10**up, y) if up >= 0 else (x, y * 10**-up)
        exact = half_up(np.where(y < 0, -n, n), abs(d))
    elif op == "*":
        exact = _shift(x * y, own - a.scale - b.scale)
    else:
        wide = max(a.scale, b.scale)
        x, y = x * 10 ** (wide - a.scale), y * 10 ** (wide - b.scale)
        exact = _shift(x + y if op == "+" else x - y, own - wide)
    return _shift(exact, scale - own)
