"""Values of the formula language: decimals, dates, texts and booleans, and how cell text becomes one."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta
from decimal import ROUND_HALF_UP, Context, Decimal, InvalidOperation, localcontext
from functools import lru_cache

#: Working precision of document mode; Spark columns carry at most 38 digits.
DIGITS, SPARK_DIGITS = 40, 38
CONTEXT = Context(prec=DIGITS, rounding=ROUND_HALF_UP)
Value = Decimal | date | str | bool


class Fault(Exception):
    """A failed evaluation: a finding code and what went wrong."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code, self.message = code, message


#: Digits within which rounding is exact.
_ROUNDING = Context(prec=80, rounding=ROUND_HALF_UP)


@lru_cache(maxsize=256)
def _unit(places: int) -> Decimal:
    return Decimal((0, (1,), -places))


def quantize(value: Decimal, places: int) -> Decimal:
    """Half-up rounding to `places` decimals; zero is never negative."""
    out = value.quantize(_unit(places), ROUND_HALF_UP, _ROUNDING)
    return out if out else out.copy_abs()


def fits(value: Decimal, places: int, digits: int = DIGITS) -> bool:
    """Whether the integer digits and `places` decimals stay within the ceiling."""
    return max(0, value.adjusted() + 1 if value else 1) + places <= digits


def kind(value: Value) -> str:
    return "bool" if isinstance(value, bool) else "num" if isinstance(value, Decimal) else "date" if isinstance(value, date) else "str"


NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
DECORATED = re.compile(r"^(?P<sign>-?)(?P<pre>[^\d\s.\-%]*)\s*(?P<num>-?\d+(?:\.\d+)?)\s*(?P<post>%|[^\d\s.\-%]*)$")
ISO = re.compile(r"^(\d{4})-(\d{2})-(\d{2})$")
LOOSE_DATE = re.compile(r"^(\d{1,4})[./-](\d{1,2})[./-](\d{1,4})$")


@dataclass(frozen=True)
class Decoration:
    """What stands around a number: a prefix such as $ or a suffix such as kg or %."""

    prefix: str = ""
    suffix: str = ""


@lru_cache(maxsize=1 << 14)
def decorated(text: str) -> tuple[Decimal, Decoration] | None:
    """Number and decoration of a cell, or None. A decoration on both sides is a UNIT fault."""
    m = DECORATED.match(text.strip())
    if not m or (m["sign"] and m["num"].startswith("-")):
        return None
    if m["pre"] and m["post"]:
        raise Fault("UNIT", f"{text.strip()!r} is decorated on both sides")
    return Decimal(m["sign"] + m["num"]), Decoration(m["pre"], m["post"])


@lru_cache(maxsize=1 << 14)
def number_of(text: str) -> Decimal | None:
    """The value of a numeric cell; percent texts are hundredths."""
    found = decorated(text)
    if found is None:
        return None
    value, how = found
    return value.scaleb(-2) if how.suffix == "%" else value


@lru_cache(maxsize=1 << 14)
def shown_places(text: str) -> int | None:
    """Decimals that a cell shows; a percent text counts two more. None for texts that are no numbers."""
    try:
        found = decorated(text)
    except Fault:
        return None
    if found is None:
        return None
    return max(0, -found[0].as_tuple().exponent) + 2 * (found[1].suffix == "%")


def iso_date(text: str) -> date | None:
    """A date for a full ISO text. Texts that only look like dates raise DATE with the possible readings."""
    text = text.strip()
    if m := ISO.match(text):
        try:
            return date(*map(int, m.groups()))
        except ValueError:
            raise Fault("DATE", f"{text} is not a date of the calendar") from None
    if m := LOOSE_DATE.match(text):
        readings = date_readings(text)
        if not readings:
            raise Fault("DATE", f"{text} is no date in either order")
        if len(readings) == 1:
            raise Fault("DATE", f"{text} is not an ISO date; it reads {readings[0].isoformat()}")
        a, b = readings
        raise Fault("DATE", f"{text} is ambiguous: {a.isoformat()} or {b.isoformat()}, {abs((a - b).days)} days apart")
    if re.match(r"^\d{4}-\d{2}$", text):
        raise Fault("DATE", f"{text} has no day")
    return None


def date_readings(text: str) -> list[date]:
    """Distinct valid dates of a d.m.y, m/d/y or y/m/d text, day first."""
    m = LOOSE_DATE.match(text.strip())
    if not m:
        return []
    a, b, c = m.groups()
    orders = [(a, b, c)] if len(a) == 4 else [(c, b, a), (c, a, b)]
    out: list[date] = []
    for y, mo, d in orders:
        try:
            got = date(int(y), int(mo), int(d))
        except ValueError:
            continue
        if len(y) == 4 and got not in out:
            out.append(got)
    return out


def coerce(text: str) -> Value:
    """The value of an input cell: number, ISO date, else text. Faults: DATE, UNIT."""
    found = number_of(text)
    if found is not None:
        return found
    day = iso_date(text)
    return text.strip() if day is None else day


def add_days(day: date, days: Decimal) -> date:
    if days != days.to_integral_value():
        raise Fault("TYPE", "a date moves by whole days")
    try:
        return day + timedelta(days=int(days))
    except OverflowError:
        raise Fault("DATE", "the date leaves the years 1 to 9999") from None


def month_end(day: date, months: Decimal) -> date:
    """The last day of the month `months` after that of `day`."""
    if months != months.to_integral_value():
        raise Fault("TYPE", "months are whole numbers")
    at = day.year * 12 + day.month - 1 + int(months)
    if not 12 <= at < 120000:
        raise Fault("DATE", "the month end leaves the years 1 to 9999")
    year, month = divmod(at, 12)
    first_after = (year * 12 + month + 1)
    if first_after == 120000:
        return date(9999, 12, 31)
    return date(first_after // 12, first_after % 12 + 1, 1) - timedelta(days=1)


def show(value: Value, places: int | None) -> str:
    """Text of a value at a width: fixed decimals, ISO dates, plain text."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, Decimal):
        if places is not None:
            return f"{quantize(value, places):f}"
        text = f"{value.normalize(CONTEXT):f}"
        return "0" if text == "-0" else text
    return value.isoformat() if isinstance(value, date) else value


def with_decoration(number: str, how: Decoration) -> str:
    """A number in the column's decoration; the sign stands before a prefix."""
    sign, body = ("-", number[1:]) if number.startswith("-") else ("", number)
    return f"{sign}{how.prefix}{body}{how.suffix}"


def show_percent(value: Decimal, places: int) -> str:
    """percent display: hundredths at two decimals fewer. Needs a width of two or more."""
    if places < 2:
        raise Fault("ANCHOR", "percent needs a width of at least 2")
    return f"{quantize(value.scaleb(2), places - 2):f}%"


def show_nbsp(text: str) -> str:
    return re.sub(r"[\s ]+", "&nbsp;", text.strip())


def to_decimal(text: str) -> Decimal:
    try:
        return Decimal(text)
    except InvalidOperation:
        raise Fault("TYPE", f"{text!r} is not a number") from None
