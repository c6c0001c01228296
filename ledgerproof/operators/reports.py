"""What people and programs read: texts and JSON of findings, values and plans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.syntax import source
from ..lang.units import format_unit, unit_json
from ..lang.values import show
from ..plans.findings import CODES, Finding, summary
from ..plans.graph import dependencies
from .documents import Result


def findings_text(path: str, findings: list[Finding]) -> str:
    """Findings in report order, aligned, with a closing count."""
    if not findings:
        return f"{path}: no findings"
    where = [".".join(p for p in (f.sheet, f.name) if p) for f in findings]
    wide = max(map(len, where), default=0)
    lines = [f"  {f.code:<10}{w:<{wide}}  {f.row_label + ': ' if f.row_label else ''}{f.message}" for f, w in zip(findings, where, strict=True)]
    s = summary(findings)
    return "\n".join([path, "", *lines, "", f"  {s['problems']} problems ({s['stale']} stale, {s['errors']} errors)"])


def result_json(result: Result) -> str:
    """The envelope of a check: findings, summary, values with units, assertions."""
    values = {
        ".".join(x for x in n if x): {"value": show(v, p if isinstance(p := result.places.get(n), int) else None), "unit": unit_json(result.units.get(n, {}))}
        for n, v in result.values.items()
    }
    asserts = [{"sheet": a.sheet, "text": a.text, "holds": a.holds} for a in result.assertions]
    return json.dumps({"findings": [f.row() for f in result.findings], "summary": summary(result.findings), "values": values, "assertions": asserts}, ensure_ascii=False)


# fixed values: the order in which a report on inference lists kinds
INFERENCE = ("column", "scalar", "alias", "unit", "constant", "near-miss", "ambiguous", "alternative")


def inference_text(found: list) -> str:
    """What inference says, by kind: rules that would be written first, then what a person has to decide."""
    lines = []
    for kind in INFERENCE:
        for p in (p for p in found if p.kind == kind):
            says = {
                "column": f"{p.rule}   {p.rows} rows, {p.strength}" + (f"; also written {p.echo}" if p.echo else ""),
                "scalar": f"{p.rule}   at {p.span[0]}" if p.span else p.rule,
                "near-miss": f"{p.rule}   one row of {p.rows} disagrees: " + "; ".join(f"row {r + 1} says {a}, not {b}" for r, a, b in p.misses),
                "ambiguous": f"{p.target}: " + " or ".join(p.alternatives),
                "alternative": f"{p.rule}   {p.reason}",
                "constant": f"{p.target} is also written {p.echo}",
            }.get(kind, p.rule)
            lines.append(f"  {kind:<12}{p.sheet + ': ' if p.sheet else ''}{says}")
    return "\n".join(lines) if lines else "  nothing to infer"


def inference_json(text: str) -> str:
    """Proposals and the edits that would write them, as JSON."""
    from .infer import plan_write, proposals

    rows = [{"kind": p.kind, "sheet": p.sheet, "name": p.target, "rule": p.rule if p.formula else "", "stage": p.stage, "rows": p.rows, "weak": p.kind == "column" and p.strength == "weak", "misses": p.misses, "alternatives": p.alternatives, "echo": p.echo, "reason": p.reason, "at": p.span} for p in proposals(text)]
    return json.dumps({"proposals": rows, "edits": [{"start": e.start, "end": e.end, "text": e.text, "kind": e.reason} for e in plan_write(text)]}, ensure_ascii=False)


def charts_json(result: Result, existing: dict[tuple[str, str], str] | None = None) -> str:
    """Every chart with its engine, series, path and state (given the files that exist), as JSON."""
    from .charts import draw_all, paths, state

    drawn, faults = draw_all(result)
    placed, homeless = paths(result)
    why = {(f.sheet, f.name): f.message for f in [*homeless, *faults]}
    rows = []
    for sheet in result.model.sheets.values():
        for c in sheet.charts:
            node = (sheet.id, c.name)
            svg = drawn.get(node)
            how = "error" if node in why else "skipped" if existing is None else state(existing.get(node), svg)
            rows.append({"sheet": sheet.id, "chart": c.name, "engine": c.engine, "series": c.series, "labels": c.label, "path": placed.get(node), "state": how, "message": why.get(node)})
    return json.dumps({"charts": rows}, ensure_ascii=False)


def explain(result: Result) -> list[dict]:
    """The plan of a document: each binding in order of evaluation with its formula, inputs, width and unit."""
    out = []
    for node in result.order:
        sheet = result.model.sheets[node[0]]
        if node[1].startswith("assert "):
            b = sheet.asserts[int(node[1][7:])]
        else:
            b = sheet.rules.get(node[1]) or sheet.scalars[node[1]]
        needs = dependencies(result.model, sheet.id, b.expr, node[1] in sheet.rules).nodes
        places = result.places.get(node)
        out.append({
            "id": ".".join(x for x in node if x), "kind": "assertion" if node[1].startswith("assert ") else "column" if node[1] in sheet.rules else "param" if b.param else "scalar",
            "formula": source(b.expr), "needs": [".".join(x for x in n if x) for n in needs], "width": places if isinstance(places, int) else None,
            "unit": format_unit(result.units[node]) if result.units.get(node) else None,
        })
    return out


def findings_json(findings: DataFrame) -> DataFrame:
    """(doc_id, json) of a corpus' findings: one JSON array of each document, in report order."""
    item = F.struct("det", *[c for c in findings.columns if c not in ("doc_id", "det")])
    return findings.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("json"))


def ordered(findings: DataFrame, sheet_rank: str, det: str) -> DataFrame:
    """Findings (with a code) in report order, with the keys section, code_rank and sheet_rank that make it."""
    stale = F.col("code") == "STALE"
    rank = F.array_position(F.array(*[F.lit(c) for c in CODES]), F.col("code")).cast("int") - 1
    keys = findings.withColumn("section", F.when(stale, 0).otherwise(2)).withColumn("code_rank", F.when(stale, 0).otherwise(rank))
    keys = keys.withColumn("sheet_rank", F.when(stale, F.col(sheet_rank)).otherwise(0).cast("long"))
    return keys.orderBy("section", "code_rank", "sheet_rank", det).select(det, "code", "section", "code_rank", "sheet_rank")
