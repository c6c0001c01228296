"""Command line: check, fmt, infer, eval, explain, simulate one document, or list the functions.

    python -m ledgerproof check FILE [--json]
    python -m ledgerproof fmt FILE [--fix-dates] [--fix-units] [--write]
    python -m ledgerproof infer FILE [--write]
    python -m ledgerproof eval FILE [--get sheet.name] [--scenario FILE]
    python -m ledgerproof explain FILE | simulate FILE [--most N] | charts FILE | ref

Exit status: 0 fine, 1 problems found, 2 not understood.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from .functions.registry import reference
from .lang.values import Fault, show
from .operators import charts, documents, infer, repair, reports, sweep
from .plans.model import build
from .sources.csv_import import gate
from .sources.markdown import locate


def _option(args: list[str], name: str) -> str | None:
    return args[args.index(name) + 1] if name in args and args.index(name) + 1 < len(args) else None


def main(args: list[str]) -> int:
    if not args or args[0] not in ("check", "fmt", "infer", "eval", "explain", "simulate", "charts", "ref"):
        print(__doc__)
        return 2
    verb = args[0]
    if verb == "ref":
        print("\n".join(f"{r['signature']:<32}{r['about']}  e.g. {r['example']} = {r['result']}" for r in reference()))
        return 0
    if len(args) < 2:
        print(__doc__)
        return 2
    path = Path(args[1])
    text = path.read_text(encoding="utf-8")

    def read(name: str) -> bytes:
        target = (path.parent / gate(name)).resolve()
        if not target.is_relative_to(path.parent.resolve()):
            raise Fault("IMPORT", f"{name} leaves the document's folder")
        return target.read_bytes()

    if verb == "check":
        result = documents.check(text, read)
        print(reports.result_json(result) if "--json" in args else reports.findings_text(str(path), result.findings))
        return result.exit_code
    if verb == "fmt":
        fixed, counts, left = repair.fmt(text, "--fix-dates" in args, "--fix-units" in args, read)
        if "--write" in args and fixed != text:
            path.write_text(fixed, encoding="utf-8")
        print(json.dumps({"edits": counts, "left": len(left)}) if "--write" in args else fixed)
        return int(bool(left))
    if verb == "infer":
        if "--write" in args:
            path.write_text(infer.write(text), encoding="utf-8")
        print(reports.inference_json(text) if "--json" in args else reports.inference_text(infer.proposals(text)))
        return 0
    if verb == "eval":
        model = build(locate(text))
        given = {}
        if scenario := _option(args, "--scenario"):
            given = sweep.resolve_scenario(model, sweep.read_scenario(Path(scenario).read_text(encoding="utf-8")))
        result = documents.Checker(sweep.with_values(model, given), read).run()
        wanted = _option(args, "--get")
        for (sheet, name), v in result.values.items():
            key = f"{sheet}.{name}" if sheet else name
            places = result.places.get((sheet, name))
            if wanted in (None, key):
                print(show(v, places if isinstance(places, int) else None) if wanted else f"{key} = {show(v, places if isinstance(places, int) else None)}")
        failed = [k for k, a in enumerate(result.assertions) if a.holds is False]
        defaults = documents.check(text, read).assertions if given and failed else []
        for k in failed:
            also = {True: "; on the defaults it holds", False: "; on the defaults it fails too", None: "; on the defaults it can't be decided"}[defaults[k].holds] if k < len(defaults) else ""
            print(f"{result.assertions[k].sheet}: {result.assertions[k].text} does not hold{also}", file=sys.stderr)
        return int(bool(failed))
    if verb == "explain":
        for row in reports.explain(documents.check(text, read)):
            print(f"{row['id']:<28}{row['kind']:<10}{row['formula']}   reads {', '.join(row['needs']) or 'inputs'}; width {row['width']}; unit {row['unit']}")
        return 0
    if verb == "charts":
        result = documents.check(text, read)
        drawn, faults = charts.draw_all(result)
        placed, _ = charts.paths(result)
        for (sheet, name), svg in drawn.items():
            where = placed.get((sheet, name))
            target = path.parent / (gate(where, ".svg") if where else f"{path.stem}-{sheet}-{name}.svg")
            target.parent.mkdir(parents=True, exist_ok=True)
            old = target.read_text(encoding="utf-8") if target.exists() else None
            state = charts.state(old, svg)
            if state in ("missing", "stale"):
                target.write_text(svg, encoding="utf-8")
            print(f"{target.name}: {state}")
        return int(bool(faults))
    most = _option(args, "--most")
    sim = sweep.simulate(text, int(most) if most else None)
    for blocked in sim.blocked:
        print(f"blocked: {blocked}")
    for title, lines in sim.reports.items():
        print("\n".join(["", title, "", *[f"  {x}" for x in lines]]))
    return int(bool(sim.blocked))


if __name__ == "__main__":
    try:
        sys.exit(main(sys.argv[1:]))
    except (Fault, OSError, UnicodeDecodeError) as e:
        print(f"{type(e).__name__}: {getattr(e, 'message', e)}", file=sys.stderr)
        sys.exit(2)
