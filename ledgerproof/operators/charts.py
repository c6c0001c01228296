"""Charts of sheet columns as SVG: bar, line, area, stacked-bar and pie. The same rows give the same bytes."""

from __future__ import annotations

import math
from collections.abc import Callable
from html import escape

from ..lang.values import Fault
from ..plans.findings import Finding
from ..sources.csv_import import gate

WIDTH, MARGIN = 800, 60
COLOURS = ("#4477aa", "#ee6677", "#228833", "#ccbb44", "#66ccee", "#aa3377", "#777777")
OWNED = "<!-- drawn by ledgerproof -->"


def ticks(low: float, high: float, most: int = 6) -> list[float]:
    """Round axis steps that cover low to high."""
    if low == high:
        high = low + 1
    raw = (high - low) / most
    size = 10 ** math.floor(math.log10(raw))
    step = next(size * k for k in (1, 2, 5, 10) if size * k >= raw)
    first = math.floor(low / step)
    return [step * k for k in range(first, math.ceil(high / step) + 1)]


def _num(x: float) -> str:
    return f"{x:.2f}"


class Frame:
    """Plot area, value scale and category slots."""

    def __init__(self, labels: list[str], low: float, high: float, aspect: tuple[int, int]):
        self.height = round(WIDTH * aspect[1] / aspect[0], 2)
        self.marks = ticks(min(0.0, low), max(0.0, high))
        self.low, self.high = self.marks[0], self.marks[-1]
        self.slot = (WIDTH - 2 * MARGIN) / max(1, len(labels))
        self.out: list[str] = []
        for t in self.marks:
            y = _num(self.y(t))
            self.out.append(f'<line x1="{MARGIN}" x2="{WIDTH - MARGIN}" y1="{y}" y2="{y}" stroke="#ddd"/><text x="{MARGIN - 6}" y="{y}" text-anchor="end">{t:g}</text>')
        for k, label in enumerate(labels):
            self.out.append(f'<text x="{_num(self.x(k))}" y="{_num(self.height - MARGIN + 18)}" text-anchor="middle">{escape(label)}</text>')

    def x(self, k: float) -> float:
        return MARGIN + self.slot * (k + 0.5)

    def y(self, v: float) -> float:
        return MARGIN + (self.high - v) / (self.high - self.low) * (self.height - 2 * MARGIN)

    def box(self, x: float, w: float, a: float, b: float, colour: str) -> None:
        top, bottom = self.y(max(a, b)), self.y(min(a, b))
        self.out.append(f'<rect x="{_num(x)}" y="{_num(top)}" width="{_num(w)}" height="{_num(bottom - top)}" fill="{colour}"/>')

    def legend(self, names: list[str]) -> None:
        for k, name in enumerate(names):
            self.out.append(f'<rect x="{MARGIN + 120 * k}" y="14" width="12" height="12" fill="{COLOURS[k % len(COLOURS)]}"/><text x="{MARGIN + 120 * k + 18}" y="25">{escape(name)}</text>')


def _axis(draw: Callable) -> Callable:
    def engine(labels, series, aspect):
        if draw is _stacked:
            sums = [[sum(v[k] for v in series.values() if (v[k] > 0) == up) for k in range(len(labels))] for up in (True, False)]
            low, high = min([0.0, *sums[1]]), max([0.0, *sums[0]])
        else:
            flat = [x for v in series.values() for x in v]
            low, high = min(flat), max(flat)
        frame = Frame(labels, low, high, aspect)
        draw(frame, list(series.values()))
        frame.legend(list(series))
        return frame
    return engine


def _bar(frame: Frame, series: list[list[float]]) -> None:
    wide = frame.slot * 0.8 / len(series)
    for s, values in enumerate(series):
        for k, v in enumerate(values):
            frame.box(frame.x(k) - frame.slot * 0.4 + wide * s, wide, 0, v, COLOURS[s % len(COLOURS)])


def _line(frame: Frame, series: list[list[float]]) -> None:
    for s, values in enumerate(series):
        points = " ".join(f"{_num(frame.x(k))},{_num(frame.y(v))}" for k, v in enumerate(values))
        frame.out.append(f'<polyline points="{points}" fill="none" stroke="{COLOURS[s % len(COLOURS)]}" stroke-width="2"/>')


def _area(frame: Frame, series: list[list[float]]) -> None:
    for s, values in enumerate(series):
        points = [f"{_num(frame.x(k))},{_num(frame.y(v))}" for k, v in enumerate(values)]
        edge = [f"{_num(frame.x(k))},{_num(frame.y(0))}" for k in (len(values) - 1, 0)]
        frame.out.append(f'<polygon points="{" ".join(points + edge)}" fill="{COLOURS[s % len(COLOURS)]}" fill-opacity="0.4" stroke="{COLOURS[s % len(COLOURS)]}"/>')


def _stacked(frame: Frame, series: list[list[float]]) -> None:
    for k in range(len(series[0])):
        up = down = 0.0
        for s, values in enumerate(series):
            base = up if values[k] >= 0 else down
            frame.box(frame.x(k) - frame.slot * 0.35, frame.slot * 0.7, base, base + values[k], COLOURS[s % len(COLOURS)])
            up, down = (base + values[k], down) if values[k] >= 0 else (up, base + values[k])


def _pie(labels, series, aspect) -> Frame:
    if len(series) != 1:
        raise Fault("ARTIFACT", "a pie has one series")
    (name, values), = series.items()
    for k, v in enumerate(values, 1):
        if v < 0:
            raise Fault("ARTIFACT", f"pie of `{name}` contains a negative value ({v:.2f}, row {k})")
    total = sum(values)
    if not total:
        raise Fault("ARTIFACT", f"pie of `{name}` has a total of 0")
    frame = Frame([], 0, 1, aspect)
    frame.out = []
    cx, cy, r, turn = WIDTH / 2, frame.height / 2, frame.height / 2 - MARGIN, 0.0
    for k, v in enumerate(values):
        a, b = turn * 2 * math.pi, (turn + v / total) * 2 * math.pi
        turn += v / total
        if v == total:
            frame.out.append(f'<circle cx="{_num(cx)}" cy="{_num(cy)}" r="{_num(r)}" fill="{COLOURS[k % len(COLOURS)]}"/>')
        elif v:
            (x1, y1), (x2, y2) = ((cx + r * math.sin(t), cy - r * math.cos(t)) for t in (a, b))
            frame.out.append(f'<path d="M{_num(cx)},{_num(cy)} L{_num(x1)},{_num(y1)} A{_num(r)},{_num(r)} 0 {int(b - a > math.pi)} 1 {_num(x2)},{_num(y2)} Z" fill="{COLOURS[k % len(COLOURS)]}"/>')
    frame.legend(labels)
    return frame


#: Engines by the name a chart line gives; more can be registered by hosts, not by documents.
ENGINES: dict[str, Callable] = {"bar": _axis(_bar), "line": _axis(_line), "area": _axis(_area), "stacked-bar": _axis(_stacked), "pie": _pie}


def register_engine(name: str, engine: Callable) -> None:
    ENGINES[name] = engine


def draw(engine: str, labels: list[str], series: dict[str, list[float]], aspect: tuple[int, int] = (16, 9)) -> str:
    """The chart as SVG text; ARTIFACT faults say why it can't be drawn."""
    if engine not in ENGINES:
        raise Fault("ARTIFACT", f"there is no chart {engine}; there are {', '.join(sorted(ENGINES))}")
    if not labels or any(len(v) != len(labels) for v in series.values()):
        raise Fault("ARTIFACT", "a chart needs rows")
    frame = ENGINES[engine](labels, series, aspect)
    body = "\n".join(frame.out)
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {WIDTH} {frame.height:g}" font-family="sans-serif" font-size="12">\n{OWNED}\n{body}\n</svg>\n'


def _drawn(checked, sheet, c) -> str | None:
    """A chart as SVG; None where a column that it reads was lost to an upstream error. `checked`: a result or a running check."""
    label = sheet.header_of(c.label)
    names = [sheet.header_of(n) for n in c.series]
    if label is None or None in names:
        raise Fault("ARTIFACT", f"{c.label if label is None else c.series[names.index(None)]} is no column")
    values = {}
    for n in names:
        if n in sheet.rules and (sheet.id, n) not in checked.cells:
            return None
        got = checked.cells.get((sheet.id, n), [])
        if n in sheet.rules and any(v is None for v in got):
            return None
        if not got or any(v is None or isinstance(v, (str, bool)) or not hasattr(v, "as_tuple") for v in got):
            raise Fault("ARTIFACT", f"{n} isn't a column of numbers")
        values[n] = [float(v) for v in got]
    if len({str(checked.units.get((sheet.id, n))) for n in names}) > 1:
        raise Fault("ARTIFACT", "the series have different units")
    if len({checked.decorations.get((sheet.id, n)) for n in names}) > 1:
        raise Fault("UNIT", "a chart's series must be decorated alike")
    return draw(c.engine, [r.text for r in sheet.table.column(sheet.columns[label].ix)], values, c.aspect)


def draw_all(result) -> tuple[dict[tuple[str, str], str], list[Finding]]:
    """SVG of every chart of a checked document, and findings for those that can't be drawn."""
    out, found = {}, []
    for sheet in result.model.sheets.values():
        for c in sheet.charts:
            try:
                svg = _drawn(result, sheet, c)
                if svg is None:
                    raise Fault("ARTIFACT", "a column of the chart could not be computed")
                out[sheet.id, c.name] = svg
            except Fault as f:
                found.append(Finding(f.code, sheet.id, c.name, f.message, start=c.at))
    return out, found


def check_charts(checker) -> list[Finding]:
    """Findings of a check about charts: what can't be drawn, has no image line or shares one, and files that are missing, old or someone else's.

    Charts that upstream errors keep from being drawn are counted in one NOTE for each sheet. Without a reader files aren't looked at.
    """
    placed, unplaced = paths(checker)
    homeless = {(f.sheet, f.name): f for f in unplaced}
    found = []
    for sheet in checker.model.sheets.values():
        skipped = 0
        for c in sheet.charts:
            node = (sheet.id, c.name)
            try:
                svg = _drawn(checker, sheet, c)
                if svg is None:
                    skipped += 1
                    continue
                if node in homeless:
                    found.append(homeless[node])
                    continue
                try:
                    where = gate(placed[node], ".svg")
                except Fault as f:
                    raise Fault("ARTIFACT", f.message) from None
                if checker.read is None:
                    continue
                try:
                    old = checker.read(where).decode()
                except OSError:
                    old = None
                how = state(old, svg)
                if how == "foreign":
                    raise Fault("ARTIFACT", f"{where} exists and isn't one of these charts")
                if how != "current":
                    found.append(Finding("STALE", sheet.id, c.name, f"{where} is missing" if how == "missing" else f"{where} is out of date; draw the charts again", start=c.at))
            except (Fault, UnicodeDecodeError) as f:
                found.append(Finding(getattr(f, "code", "ARTIFACT"), sheet.id, c.name, getattr(f, "message", str(f)), start=c.at))
        if skipped:
            found.append(Finding("NOTE", sheet.id, message=f"{skipped} chart{'' if skipped == 1 else 's'} not built (upstream errors)"))
    return found


def paths(result) -> tuple[dict[tuple[str, str], str], list[Finding]]:
    """The file of each chart, from the image line that its anchor follows; a chart without one, and two charts on one path, are ARTIFACT findings."""
    named = {(a.sheet, a.name): a for a in result.model.doc.anchors if a.kind == "image"}
    out, found, taken = {}, [], {}
    for sheet in result.model.sheets.values():
        for c in sheet.charts:
            a = named.get((sheet.id, c.name))
            if a is None:
                found.append(Finding("ARTIFACT", sheet.id, c.name, "no image line shows the chart", start=c.at))
            elif a.text in taken:
                found.append(Finding("ARTIFACT", sheet.id, c.name, f"{a.text} shows {taken[a.text]} already", start=a.start, end=a.end))
            else:
                taken[a.text] = f"{sheet.id}.{c.name}"
                out[sheet.id, c.name] = a.text
    return out, found


def state(existing: str | None, drawn: str) -> str:
    """current, stale, missing or foreign, of the file that a chart is written to."""
    return "missing" if existing is None else "current" if existing == drawn else "stale" if OWNED in existing else "foreign"
