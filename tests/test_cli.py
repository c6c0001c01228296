import json

import pytest

from ledgerproof.__main__ import main
from tests.test_documents import COLDER
from tests.test_sheets import SWEEP


@pytest.fixture
def log(tmp_path):
    path = tmp_path / "a.md"
    path.write_text(COLDER)
    return path


def test_check_and_repair(log, capsys):
    assert main(["check", str(log)]) == 1 and "STALE" in capsys.readouterr().out
    assert main(["check", str(log), "--json"]) == 1 and json.loads(capsys.readouterr().out)["summary"]["stale"] > 0
    assert main(["fmt", str(log), "--write"]) == 0
    assert main(["check", str(log)]) == 0


def test_values_and_plans(log, capsys, tmp_path):
    assert main(["eval", str(log), "--get", "boiler.typical"]) == 0 and capsys.readouterr().out.strip() == "32.2"
    assert main(["explain", str(log)]) == 0 and "boiler.Pace" in capsys.readouterr().out
    sweep = tmp_path / "s.md"
    sweep.write_text(SWEEP)
    (tmp_path / "s.json").write_text('{"hours": "20"}')
    assert main(["simulate", str(sweep)]) == 0 and "hours=0 disc=0%" in capsys.readouterr().out
    assert main(["eval", str(sweep), "--scenario", str(tmp_path / "s.json")]) == 1
    said = capsys.readouterr()
    assert "plan.margin = -500.00" in said.out and "margin >= 0 does not hold; on the defaults it holds" in said.err
    assert main(["ref"]) == 0 and "EOMONTH" in capsys.readouterr().out
    assert main(["infer", str(log), "--json"]) == 0 and "proposals" in json.loads(capsys.readouterr().out)
    assert main(["infer", str(log)]) == 0 and main(["nonsense"]) == 2 and main(["check"]) == 2


def test_charts(tmp_path, capsys):
    doc = tmp_path / "c.md"
    doc.write_text("| M | A |\n|--|--|\n| x | 1 |\n\n```vmark #s\nchart c as bar of A labelled M\n```\n")
    assert main(["charts", str(doc)]) == 0 and "missing" in capsys.readouterr().out
    assert main(["charts", str(doc)]) == 0 and "current" in capsys.readouterr().out
