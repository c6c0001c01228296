"""Documents: tables, formula blocks, anchors, markers and prose figures, each with character offsets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# fixed values: the words that mark formulas in a document
FENCE, ANCHOR = "vmark", "vmark="
MARKER = "vmark:"
NO_FORMULAS = f"<!--{MARKER}no-formulas-->"

CODE = re.compile(r"(`+)(?!`).+?(?<!`)\1(?!`)", re.S)
COMMENT = re.compile(r"<!--(.*?)-->", re.S)
ANCHOR_BODY = re.compile(rf"^{ANCHOR}([^\W\d][\w]*(?:\.[^\W\d]\w*)?)((?:\|[\w]+)*)$")
TAIL = re.compile(r"(\d{4}-\d{2}-\d{2}|[^\s\w\d.\-%*_`]{0,3}-?\d[\d.]*%?[^\W\d_]{0,4}|[^\s*_`]+)$")
VALUE = re.compile(r"(\*\*|__|\*|_|`)((?:(?!\1).)+)\1$", re.S)
IMAGE = re.compile(r"!\[[^\]]*\]\(([^)\s]+)[^)]*\)$")
RULE_CELL = re.compile(r"^\s*:?-+:?\s*$")
FIGURE = re.compile(r"(?<![\w.,/-])-?\d+(?:\.\d+)?%?(?![\w/]|[.,-]\d)")
OPENING, FENCED = re.compile(r"^ {0,3}(`{3,}|~{3,})\s*(.*)$"), re.compile(r"^ {0,3}(`{3,}|~{3,})")
RULE_LINE, REPORT = re.compile(r"^\s*\|?\s*:?-+"), re.compile(rf"^<!--{MARKER}report\b")


@dataclass(slots=True)
class Cell:
    text: str
    start: int  # of the text within the cell, without blanks and one pair of emphasis marks
    end: int
    raw_start: int = -1
    raw_end: int = -1


@dataclass
class Table:
    headers: list[Cell]
    rows: list[list[Cell]]
    start: int
    end: int

    def column(self, ix: int) -> list[Cell]:
        return [r[ix] if ix < len(r) else Cell("", -1, -1) for r in self.rows]


@dataclass
class Block:
    sheet: str | None
    body: str
    body_start: int
    start: int
    end: int
    info: str = ""
    table: int | None = None


@dataclass
class Anchor:
    sheet: str
    name: str
    rules: list[str]
    text: str  # the value as written, marks included
    start: int
    end: int
    kind: str  # delimited, tail or image


@dataclass
class Document:
    text: str
    tables: list[Table] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    anchors: list[Anchor] = field(default_factory=list)
    figures: list[tuple[str, int, int]] = field(default_factory=list)
    no_formulas: bool = False
    faults: list[tuple[int, str]] = field(default_factory=list)


def may_have_formulas(text: str) -> bool:
    """A cheap test before the full parse; never wrong about texts that have blocks or anchors."""
    return FENCE in text


#: What emphasis and code begin with (an empty cell has neither).
_EMPHASIS = ("*", "_", "`")


def split_row(line: str, offset: int) -> list[Cell]:
    """Cells of a pipe row with the offsets of their text. Escaped pipes and pipes in code don't part cells."""
    body = line.rstrip()
    if "\\" not in body and "`" not in body:
        return _plain_row(body, offset)
    cells, begin, i, code = [], 0, 0, False
    while i <= len(body):
        c = body[i] if i < len(body) else "|"
        if c == "\\" and i + 1 < len(body):
            i += 2
            continue
        if c == "`":
            code = not code
        if c == "|" and (not code or i == len(body)):
            cells.append((begin, i))
            begin = i + 1
        i += 1
    if body.lstrip().startswith("|"):
        cells = cells[1:]
    if body.endswith("|") and cells and cells[-1][0] >= len(body):
        cells = cells[:-1]
    return [trim_cell(body, a, b, offset) for a, b in cells]


def _plain_row(body: str, offset: int) -> list[Cell]:
    """The cells of a row without escapes and code."""
    parts, a, out = body.split("|"), 0, []
    last = len(parts) - 1
    for k, part in enumerate(parts):
        b = a + len(part)
        # what stands before the first pipe and behind the last one is a cell only if the row doesn't begin, or end, with a pipe
        if (k or (part and not part.isspace()) or not last) and (k < last or part or not last):
            left = part.lstrip(" \t")
            text = left.rstrip(" \t")
            if text[:1] in _EMPHASIS:
                out.append(trim_cell(body, a, b, offset))
            else:
                begin = b - len(left) + offset
                out.append(Cell(text, begin, begin + len(text), a + offset, b + offset))
        a = b + 1
    return out


def trim_cell(line: str, a: int, b: int, offset: int) -> Cell:
    raw = (a + offset, b + offset)
    text = line[a:b].lstrip(" \t")
    a = b - len(text)
    text = text.rstrip(" \t")
    b = a + len(text)
    if text[:1] not in _EMPHASIS:
        return Cell(text.replace("\\|", "|"), a + offset, b + offset, *raw)
    for mark in ("**", "__", "*", "_", "`"):
        if b - a > 2 * len(mark) and line[a:b].startswith(mark) and line[a:b].endswith(mark) and mark not in line[a + len(mark): b - len(mark)]:
            a, b = a + len(mark), b - len(mark)
            break
    return Cell(line[a:b].replace("\\|", "|"), a + offset, b + offset, *raw)


def locate(text: str) -> Document:
    """Parse a document once, keeping where everything stands."""
    doc = Document(text)
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, line.rstrip("\r")))
        at += len(line) + 1
    siblings: list[tuple[str, int]] = []  # kinds of top-level nodes in order
    prose: list[tuple[int, int]] = []
    i, n = 0, len(lines)
    while i < n:
        start, line = lines[i]
        if m := OPENING.match(line):
            mark, info = m[1], m[2].strip()
            j = i + 1
            while j < n and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*$", lines[j][1]):
                j += 1
            body_start = lines[i + 1][0] if i + 1 < n else len(text)
            body_end = lines[j][0] - 1 if j < n else len(text)
            words = info.split(None, 1)
            if words and words[0] == FENCE:
                rest = words[1] if len(words) > 1 else ""
                name = re.match(r"^#([^\W\d]\w*)\s*(.*)$", rest)
                end = lines[j][0] + len(lines[j][1]) if j < n else len(text)
                block = Block(name[1] if name else None, text[body_start: max(body_start, body_end)], body_start, start, end, name[2] if name else rest)
                if rest and not name:
                    doc.faults.append((start, f"a block's name begins with #: {rest}"))
                if siblings and siblings[-1][0] == "table":
                    block.table = siblings[-1][1]
                doc.blocks.append(block)
                siblings.append(("block", len(doc.blocks) - 1))
            else:
                siblings.append(("code", i))
            i = j + 1
            continue
        rule = split_row(lines[i + 1][1], 0) if "|" in line and i + 1 < n and "-" in lines[i + 1][1] else []
        if rule and all(RULE_CELL.match(c.text) for c in rule) and len(headers := split_row(line, start)) == len(rule):
            j, rows = i + 2, []
            while j < n and lines[j][1].strip() and "|" in lines[j][1]:
                rows.append(split_row(lines[j][1], lines[j][0]))
                j += 1
            rows = [r if len(r) == len(headers) else (r + [Cell("", r[-1].end if r else 0, r[-1].end if r else 0)] * len(headers))[: len(headers)] for r in rows]
            doc.tables.append(Table(headers, rows, start, lines[j - 1][0] + len(lines[j - 1][1])))
            siblings.append(("table", len(doc.tables) - 1))
            i = j
            continue
        if line.strip():
            j = i
            while j < n and lines[j][1].strip() and not FENCED.match(lines[j][1]):
                if j > i and "|" in lines[j][1] and j + 1 < n and RULE_LINE.match(lines[j + 1][1]) and "|" in lines[j + 1][1]:
                    break
                j += 1
            j = max(j, i + 1)
            end = lines[j - 1][0] + len(lines[j - 1][1])
            chunk = text[start:end]
            if not REPORT.match(chunk):
                siblings.append(("prose", i))
            prose.append((start, end))
            i = j
            continue
        i += 1
    for a, b in prose:
        chunk = text[a:b]
        if chunk.startswith("<!--") and "-->" not in chunk:  # a comment over blank lines
            close = text.find("-->", a)
            b = len(text) if close < 0 else close + 3
        scan_prose(doc, a, b)
    return doc


def scan_prose(doc: Document, a: int, b: int) -> None:
    text = doc.text
    spans, code = [], [m.span() for m in CODE.finditer(text[a:b])]
    for m in COMMENT.finditer(text, a, b):
        spans.append(m.span())
        if any(x < m.start() - a and m.end() - a < y for x, y in code):
            continue
        body = m[1].strip()
        if body.startswith(MARKER):
            rest = body[len(MARKER):]
            if rest.strip() == "no-formulas":
                doc.no_formulas = True
            elif r := re.match(r"^report\s+#([^\W\d]\w*)\s*(.*)$", rest, re.S):
                doc.blocks.append(Block(r[1], r[2], m.start() + m[0].find(r[2]) if r[2] else m.end(), m.start(), m.end(), "report"))
            else:
                doc.faults.append((m.start(), f"unknown marker {body}"))
        elif body.startswith(ANCHOR):
            anchor = ANCHOR_BODY.match(body.replace(" ", ""))
            if not anchor:
                doc.faults.append((m.start(), f"an anchor names one value: {body}"))
                continue
            sheet, _, name = anchor[1].rpartition(".")
            rules = [r for r in anchor[2].split("|") if r]
            before = text[a: m.start()]
            if v := IMAGE.search(before):
                doc.anchors.append(Anchor(sheet, name, rules, v[1], a + v.start(1), a + v.end(1), "image"))
            elif v := VALUE.search(before):
                doc.anchors.append(Anchor(sheet, name, rules, v[2], a + v.start(2), a + v.end(2), "delimited"))
            elif v := TAIL.search(before):
                doc.anchors.append(Anchor(sheet, name, rules, v[1], a + v.start(1), a + v.end(1), "tail"))
            else:
                doc.faults.append((m.start(), f"no value stands before the anchor of {anchor[1]}"))
    for m in FIGURE.finditer(text, a, b):
        if not any(x <= m.start() < y for x, y in spans) and "`" not in text[max(a, m.start() - 1): m.start()]:
            doc.figures.append((m[0], m.start(), m.end()))
