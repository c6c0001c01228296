"""Cell texts as columns: the coercion, width and display rules of documents in native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^(-?)([^\d\s.%-]*)\s*(-?\d+(?:\.\d+)?)\s*(%|[^\d\s.%-]*)$"
ISO = r"^\d{4}-\d{2}-\d{2}$"
LOOSE = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})$"


def number(text: Column) -> Column:
    """DECIMAL(38,12) of a number, percent or decorated text; null for others and for texts decorated on both sides."""
    t = F.trim(text)
    sign, pre, body, post = (F.regexp_extract(t, NUMBER, k) for k in range(1, 5))
    value = F.concat(sign, body).try_cast("decimal(38,12)")
    fine = t.rlike(NUMBER) & ~((pre != "") & (post != "")) & ~((sign == "-") & body.startswith("-"))
    return F.when(fine, F.when(post == "%", value / 100).otherwise(value).cast("decimal(38,12)"))


def places(text: Column) -> Column:
    """Decimals that a numeric text shows, two more for percents; null for others."""
    t = F.trim(text)
    shown = F.length(F.regexp_extract(t, r"\.(\d+)", 1))
    return F.when(number(text).isNotNull(), shown + F.when(t.endswith("%"), 2).otherwise(0))


def decoration(text: Column) -> Column:
    """prefix|suffix of a numeric text; null for others."""
    t = F.trim(text)
    return F.when(number(text).isNotNull(), F.concat_ws("|", F.regexp_extract(t, NUMBER, 2), F.regexp_extract(t, NUMBER, 4)))


def iso(text: Column) -> Column:
    """The date of a full ISO text, else null: partial dates are refused."""
    t = F.trim(text)
    return F.when(t.rlike(ISO), F.try_to_date(t, "yyyy-MM-dd"))


def kind_of(text: Column) -> Column:
    """num, date or str, in the order in which a cell is tried."""
    return F.when(number(text).isNotNull(), "num").when(iso(text).isNotNull(), "date").otherwise("str")


def date_reading(text: Column) -> Column:
    """decidable, ambiguous, same or none, of a d.m.y or m/d/y text."""
    t = F.trim(text)
    a, b, y = (F.regexp_extract(t, LOOSE, k) for k in (1, 2, 3))
    pad = lambda c: F.lpad(c, 2, "0")
    day_first = F.try_to_date(F.concat_ws("-", y, pad(b), pad(a)), "yyyy-MM-dd")
    month_first = F.try_to_date(F.concat_ws("-", y, pad(a), pad(b)), "yyyy-MM-dd")
    both = day_first.isNotNull() & month_first.isNotNull()
    return F.when(~t.rlike(LOOSE), "none").when(both & (day_first == month_first), "same").when(both, "ambiguous").when(day_first.isNotNull() | month_first.isNotNull(), "decidable").otherwise("none")


def fixed(value: Column, width: int) -> Column:
    """Text with so many decimals."""
    return F.round(value, width).cast(f"decimal(38,{width})").cast("string")


def percent(value: Column, width: int) -> Column:
    """Text of hundredths at two decimals fewer than the width."""
    return F.concat(F.round(value * 100, width - 2).cast(f"decimal(38,{width - 2})").cast("string"), F.lit("%"))


def nbsp(text: Column) -> Column:
    """White space as no-break entities."""
    return F.regexp_replace(F.trim(text), r"[\s ]+", "&nbsp;")


def with_prefix(number_text: Column, prefix: str) -> Column:
    """A prefix between sign and digits."""
    return F.when(number_text.startswith("-"), F.concat(F.lit("-" + prefix), F.substr(number_text, F.lit(2)))).otherwise(F.concat(F.lit(prefix), number_text))


def matches_stored(text: Column, value: Column, width: int) -> Column:
    """Whether a stored text says the value at a width."""
    return F.coalesce(F.round(number(text), width) == F.round(value, width), F.lit(False))
