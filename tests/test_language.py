from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerproof.functions.evaluate import evaluate
from ledgerproof.functions.finance import irr, npv, pmt
from ledgerproof.functions.registry import TABLE
from ledgerproof.lang.parser import ParseError, lex, parse_expression, parse_statement
from ledgerproof.lang.syntax import Binary, Call, Num, Ref, Unary, source
from ledgerproof.lang.units import UnitError, divide, format_unit, halve, multiply, parse_unit, same
from ledgerproof.lang.values import Fault, coerce, date_readings, month_end, number_of, quantize, show, show_percent, shown_places
from ledgerproof.plans.static import unit_of, width

D = Decimal


@pytest.mark.parametrize(("text", "value"), [("-2^2", -4), ("2^3^2", 512), ("1 - 2 - 3", -4), ("7 - 2 * 3", 1), ("|3 - 5|", 2), ("⌊7/2⌋", 3), ("⌈7/2⌉", 4), ("√(16)", 4), ("23%", D("0.23")), ("2 ⋅ 3", 6), ("ROUND(0 - 2.5, 0)", -3)])
def test_arithmetic(text, value):
    assert evaluate(parse_expression(text), None, None) == value


@pytest.mark.parametrize("text", ["1,000 + 1", "a < b < c", "(a < b) < c", "true", "a +", "1 2", "f(", "'x'", "a[", "3 @ 4"])
def test_refused(text):
    with pytest.raises(ParseError):
        parse_expression(text)


def test_depth_and_length():
    assert parse_expression("(" * 200 + "1" + ")" * 200) == Num(D(1), 0, "1")
    with pytest.raises(ParseError):
        parse_expression("(" * 300 + "1" + ")" * 300)
    with pytest.raises(ParseError):
        parse_expression("1" + "+1" * 300)
    assert len(lex("x" * 200_000)) == 2


@pytest.mark.parametrize(("line", "kind"), [("a = 1", "Binding"), ("assert a > 1", "Assertion"), ('"A b" is ab', "Alias"), ("[Mb] = [MB]", "UnitDefinition"), ("param p in [0, 1] lattice 0.5 = default 0", "Binding"), ("report gates", "Report"), ("report best scalar s.x direction min among feasible", "Report"), ("chart c as pie of A labelled B aspect 4:3", "Chart")])
def test_statements(line, kind):
    assert type(parse_statement(line)).__name__ == kind


names = st.sampled_from(["a", "b", "c"])
expressions = st.recursive(
    st.one_of(st.integers(0, 99).map(lambda n: Num(D(n), 0, str(n))), names.map(Ref)),
    lambda x: st.one_of(
        st.tuples(st.sampled_from(["+", "-", "*", "/", "^"]), x, x).map(lambda t: Binary(*t)), x.map(lambda e: Unary("-", e)), st.tuples(x, x).map(lambda t: Call("MOD", t))
    ),
    max_leaves=12,
)


@settings(max_examples=300, deadline=None)
@given(expressions)
def test_printing_and_reading_again(e):
    assert parse_expression(source(e)) == e


@pytest.mark.parametrize("f", TABLE.values(), ids=lambda f: f.name)
def test_documented_examples(f):
    columns = {"Amount": [D(10), D(20), D(30)], "Cash": [D(-48000), D(20000), D(20000), D(20000)], "Pair": [D(-100), D(110)]}
    got = evaluate(parse_expression(f.example[0]), None, lambda r: columns[r.name])
    assert show(got, None) == f.example[1]


def test_finance():
    flows = [D(-48000), D(20000), D(20000), D(20000)]
    assert quantize(npv(D("0.08"), flows), 2) == D("3541.94")
    assert quantize(irr(flows), 4) == D("0.1204")
    assert quantize(pmt(D("0.005"), D(36), D(48000)), 2) == D("1460.25")
    assert irr([D(-100), D(110)]) == D("0.1")
    for bad in ([D(1), D(2)], [D(-1), D(2), D(-1)], []):
        with pytest.raises(Fault):
            irr(bad)
    for rate, n in ((D(-1), D(3)), (D("0.1"), D(0)), (D("0.1"), D("1.5"))):
        with pytest.raises(Fault):
            pmt(rate, n, D(1))


@settings(max_examples=60, deadline=None)
@given(st.decimals("-0.5", "2", places=3), st.integers(2, 30))
def test_irr_inverts_npv(rate, n):
    flows = [D(-1000)] + [D(10 + k) for k in range(n)]
    got = irr(flows)
    assert abs(npv(got, flows)) < D("1e-20")


@pytest.mark.parametrize(("text", "value", "places"), [("1.50", D("1.50"), 2), ("30%", D("0.30"), 2), ("$ 5.0", D(5), 1), ("5 kg", D(5), 0), ("-$3", D(-3), 0), ("1,000.00", None, None), ("1e3", None, None), (".5", None, None), ("", None, None), ("n/a", None, None)])
def test_numbers_of_cells(text, value, places):
    assert number_of(text) == value
    assert shown_places(text) == places


def test_cells():
    assert coerce("2026-09-03") == date(2026, 9, 3)
    assert coerce("abc") == "abc"
    for bad, code in (("15.10.2026", "DATE"), ("11/12/2026", "DATE"), ("2026-02", "DATE"), ("2026-02-30", "DATE"), ("$5kg", "UNIT")):
        with pytest.raises(Fault) as e:
            coerce(bad)
        assert e.value.code == code
    assert date_readings("11/12/2026") == [date(2026, 12, 11), date(2026, 11, 12)]
    assert month_end(date(2026, 1, 15), D(2)) == date(2026, 3, 31)
    assert month_end(date(9999, 11, 1), D(1)) == date(9999, 12, 31)
    with pytest.raises(Fault):
        month_end(date(9999, 12, 31), D(1))
    assert show_percent(D("0.125"), 3) == "12.5%"
    assert show(D("-0.001"), 2) == "0.00"


def test_eager_faults():
    with pytest.raises(Fault):
        evaluate(parse_expression("IF(1 == 1, 0, 1 / 0)"), None, None)
    with pytest.raises(Fault):
        evaluate(parse_expression("1 == 1 or 1 / 0 > 1"), None, None)
    assert evaluate(parse_expression('1 == "x"'), None, None) is False
    with pytest.raises(Fault):
        evaluate(parse_expression('1 < "x"'), None, None)


def test_units():
    assert parse_unit("GB/s/GPU") == {"GB": 1, "s": -1, "GPU": -1}
    assert format_unit(parse_unit("m²⋅kg/s^2")) == "kg⋅m^2/s^2"
    assert parse_unit("1/h") == {"h": -1}
    assert multiply({"a": 1}, {"a": -1}) == {} and divide({"a": 1}, {"b": 1}) == {"a": 1, "b": -1}
    assert halve({"m": 2}) == {"m": 1} and halve({"m": 1}) is None
    assert same({"kmh": 1}, {"km": 1, "h": -1}, {"kmh": {"km": 1, "h": -1}})
    for bad in ("a/b⋅c", "%", "", "kg/", "2m"):
        with pytest.raises(UnitError):
            parse_unit(bad)
    units = {"d": {"m": 1}, "t": {"s": 1}, "n": None}
    assert unit_of(parse_expression("d / t"), lambda r: units[r.name], {}) == {"m": 1, "s": -1}
    assert unit_of(parse_expression("SQRT(d * d)"), lambda r: units[r.name], {}) == {"m": 1}
    for bad in ("d + t", "d < t", "d ^ n", "SQRT(d)"):
        with pytest.raises(Fault):
            unit_of(parse_expression(bad), lambda r: units[r.name], {})


@pytest.mark.parametrize(("text", "w"), [("a * b", 5), ("a + b", 3), ("a / b", None), ("a ^ 2", 4), ("ROUND(a, 1)", 1), ("COUNT(a)", 0), ("AVG(a)", None), ("d - d", 0), ("d + 1", "date"), ("EOMONTH(d, 1)", "date"), ("MOD(a, b)", 3), ("FLOOR(a, 1)", 0), ("25%", 2)])
def test_widths(text, w):
    assert width(parse_expression(text), lambda r: {"a": 2, "b": 3, "d": "date"}[r.name]) == w


@settings(max_examples=200, deadline=None)
@given(expressions, st.decimals("-50", "50", places=2), st.decimals("-50", "50", places=1), st.integers(-20, 20))
def test_a_derived_width_loses_no_digit(e, a, b, c):
    values = {"a": a, "b": b, "c": D(c)}
    w = width(e, lambda r: {"a": 2, "b": 1, "c": 0}[r.name])
    try:
        v = evaluate(e, lambda r: values[r.name], None)
    except Fault:
        return
    if w is not None and w <= 18 and len(v.as_tuple().digits) < 36:
        assert quantize(v, w) == v
