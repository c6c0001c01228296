"""Findings: typed results of a check."""

from __future__ import annotations

from dataclasses import dataclass, fields

# fixed values: the codes of findings in the order in which a report ranks them
CODES = ("STALE", "DATE", "UNIT", "UNDEF", "DUP", "VECTOR", "CYCLE", "TYPE", "SHEET", "ANCHOR", "ASSERT", "PRECISION", "DOMAIN", "ARTIFACT", "IMPORT", "WARN", "NOTE", "COVERAGE")
ADVICE = frozenset({"WARN", "NOTE"})
#: Findings that don't keep a sweep from starting.
NOT_BLOCKING = frozenset({"STALE", "WARN", "NOTE", "COVERAGE", "ASSERT", "ARTIFACT"})
SCHEMA = "code string, sheet string, name string, row_ix int, row_label string, stored string, computed string, formula string, message string, suggestion string, start int, end int, det int"


@dataclass
class Finding:
    code: str
    sheet: str = ""
    name: str = ""
    message: str = ""
    row_ix: int = -1
    row_label: str = ""
    stored: str | None = None
    computed: str | None = None
    formula: str | None = None
    suggestion: str | None = None
    start: int = -1
    end: int = -1
    det: int = 0
    anchor: bool = False
    count: int = 1

    @property
    def problem(self) -> bool:
        return self.code not in ADVICE

    def row(self) -> dict:
        return {name: getattr(self, name) for name in ROW}


ROW = tuple(f.name for f in fields(Finding) if f.name not in ("anchor", "count"))


def order(findings: list[Finding], sheets: list[str]) -> list[Finding]:
    """Stale cells by sheet, row and time of finding; stale anchors; then all others by code."""
    rank = {s: i for i, s in enumerate(sheets)}

    def key(f: Finding):
        section = 0 if f.code == "STALE" and not f.anchor else 1 if f.code == "STALE" else 2
        return (section, CODES.index(f.code) if section == 2 else 0, rank.get(f.sheet, len(rank)) if section < 2 and f.count == 1 else len(rank), f.row_ix if section == 0 else 0, f.det)

    return sorted(findings, key=key)


def summary(findings: list[Finding]) -> dict[str, int]:
    """Counts of problems, stale values and other errors; the line that gathers anchors counts each of them."""
    stale = sum(f.count for f in findings if f.code == "STALE")
    problems = sum(f.count for f in findings if f.problem)
    return {"problems": problems, "stale": stale, "errors": problems - stale}
