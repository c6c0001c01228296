"""CSV imports: clause parsing, path gate, content stamp, and an RFC 4180 reader with strict refusals."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from ..lang.values import Fault

CLAUSE = re.compile(
    r"^from\s+(?P<path>\"[^\"]+\"|\S+)(?:\s+delimited\s+(?P<sep>\"[^\"]\"|\S))?(?:\s+(?P<how>labelled|unlabelled)\s+(?P<names>.+?))?(?:\s+at\s+sha256:(?P<stamp>[0-9a-f]{64}))?\s*$"
)


@dataclass
class Import:
    path: str
    separator: str = ","
    labelled: bool | None = None
    names: list[str] = field(default_factory=list)
    stamp: str | None = None


def parse_clause(info: str) -> Import | None:
    """The import of a fence's info text, or None where it has none. Clauses come in a fixed order."""
    if not info.strip():
        return None
    m = CLAUSE.match(info.strip())
    if not m:
        raise Fault("IMPORT", f"not an import: {info.strip()} (from PATH [delimited c] [labelled a, b | unlabelled a, b] [at sha256:...])")
    names = [n.strip().strip('"') for n in (m["names"] or "").split(",") if n.strip()]
    return Import(m["path"].strip('"'), (m["sep"] or ",").strip('"'), None if m["how"] is None else m["how"] == "labelled", names, m["stamp"])


def gate(path: str, extension: str = ".csv") -> str:
    """A relative path inside the document's folder with the right extension, or an IMPORT fault."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path) or path.startswith(("/", "\\", "~")):
        raise Fault("IMPORT", f"{path} is not a relative path")
    if any(ord(c) < 32 for c in path) or "\\" in path:
        raise Fault("IMPORT", f"{path!r} holds characters that paths must not hold")
    if not path.lower().endswith(extension):
        raise Fault("IMPORT", f"{path} doesn't end in {extension}")
    depth = 0
    for part in path.split("/"):
        depth += -1 if part == ".." else 0 if part in ("", ".") else 1
        if depth < 0:
            raise Fault("IMPORT", f"{path} leaves the document's folder")
    return path


def parse_csv(text: str, separator: str = ",") -> list[list[str]]:
    """Rows of an RFC 4180 text. Mixed line ends, open quotes and empty files are refused."""
    if not text.strip():
        raise Fault("IMPORT", "the file is empty")
    ends = {e for e in re.findall(r"\r\n|\r|\n", re.sub(r'"[^"]*"', "", text))}
    if len(ends) > 1:
        raise Fault("IMPORT", "the file mixes line ends")
    rows, row, cell, i, quoted = [], [], [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            if c == '"' and text[i + 1: i + 2] == '"':
                cell.append('"')
                i += 1
            elif c == '"':
                quoted = False
            else:
                cell.append(c)
        elif c == '"' and not cell:
            quoted = True
        elif c == separator:
            row.append("".join(cell))
            cell = []
        elif c in "\r\n":
            if text[i: i + 2] == "\r\n":
                i += 1
            rows.append([*row, "".join(cell)])
            row, cell = [], []
        else:
            cell.append(c)
        i += 1
    if quoted:
        raise Fault("IMPORT", "a quotation is never closed")
    if cell or row:
        rows.append([*row, "".join(cell)])
    return rows


def stamp_state(content: bytes, stamp: str | None) -> str:
    """ok, unstamped or stale."""
    return "unstamped" if stamp is None else "ok" if hashlib.sha256(content).hexdigest() == stamp else "stale"


def read_import(spec: Import, content: bytes) -> tuple[list[str], list[list[str]]]:
    """(headers, rows) after all header checks."""
    rows = parse_csv(content.decode("utf-8-sig"), spec.separator)
    if spec.labelled is False:
        headers, body = spec.names, rows
    else:
        headers, body = [h.strip() for h in rows[0]], rows[1:]
        if spec.names and spec.names != headers:
            raise Fault("IMPORT", f"the header row is {', '.join(headers)}, not {', '.join(spec.names)}")
    if len(set(headers)) < len(headers):
        raise Fault("IMPORT", "a header stands twice")
    for n, r in enumerate(body, 1):
        if len(r) != len(headers):
            raise Fault("IMPORT", f"row {n} has {len(r)} cells, not {len(headers)}")
    return headers, body


def csv_frame(spark, path: str, spec: Import):
    """The import as a DataFrame of text columns, for files of any size: Spark splits and reads them."""
    reader = spark.read.option("sep", spec.separator).option("quote", '"').option("escape", '"').option("multiLine", True).option("inferSchema", False)
    if spec.labelled is False:
        return reader.option("header", False).csv(path).toDF(*spec.names)
    frame = reader.option("header", True).option("enforceSchema", False).csv(path)
    if spec.names and spec.names != frame.columns:
        raise Fault("IMPORT", f"the header row is {', '.join(frame.columns)}, not {', '.join(spec.names)}")
    return frame
