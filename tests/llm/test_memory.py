"""What a task's process gives back."""

from ledgerproof.llm import common


def test_what_an_operator_left_goes_back_to_the_system(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(dict(common._held)))
    monkeypatch.setattr(common, "_held", {("a",): 1})
    assert common.held(("b",), lambda: 2) == 2 and given == [{}]
    assert common.held(("b",), lambda: 3) == 2 and len(given) == 1
