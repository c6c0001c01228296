"""Present value, internal rate of return and annuity payments in decimal arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Context, Decimal, localcontext

from ..lang.values import CONTEXT, Fault, quantize

#: Working digits of sums of discounted flows, and the width at which a root counts as found.
WIDE = Context(prec=60, rounding=ROUND_HALF_UP)
ROOT_WIDTH = Decimal(1).scaleb(-42)
#: Distance from a tie within which a root is searched to the end before it is rounded.
TIE = Decimal(1).scaleb(-20)


def npv(rate: Decimal, flows: Sequence[Decimal]) -> Decimal:
    """Value of the flows at `rate` a period; the first one isn't discounted."""
    if not flows:
        raise Fault("TYPE", "NPV of an empty column")
    if rate <= -1:
        raise Fault("TYPE", "NPV needs a rate above -1")
    with localcontext(WIDE):
        step, total = 1 / (1 + rate), Decimal(0)
        for flow in reversed(flows):
            total = total * step + flow
    return CONTEXT.plus(total)


def irr(flows: Sequence[Decimal]) -> Decimal:
    """The rate at which the flows are worth nothing. They must change sign exactly once."""
    signs = [f > 0 for f in flows if f]

    def values(rates: list[Decimal]) -> list[Decimal]:
        out = []
        for rate in rates:
            step, total = 1 / (1 + rate), Decimal(0)
            for flow in reversed(flows):
                total = total * step + flow
            out.append(total)
        return out

    return irr_of(sum(a != b for a, b in zip(signs, signs[1:], strict=False)), values)


def irr_shown(flows: Sequence[Decimal], places: int) -> Decimal | None:
    """What `irr` gives, rounded to `places`, from two exact prices; None where only the whole search can tell (and where it would fault).

    Floats propose the rounded rate. With one sign change there is one root, and it rounds to the proposal if the values just inside the two
    ties around it have different signs; a root nearer to a tie than TIE, or outside the first bracket, is left to the search.
    """
    signs = [f > 0 for f in flows if f]
    if sum(a != b for a, b in zip(signs, signs[1:], strict=False)) != 1:
        return None
    near = [float(f) for f in reversed(flows)]

    def value(rate: float) -> float:
        step, total = 1 / (1 + rate), 0.0
        for flow in near:
            total = total * step + flow
        return total

    low, high = -0.9, 1.0
    v_low, v_high = value(low), value(high)
    if not v_low * v_high < 0 or math.isinf(v_low * v_high):
        return None
    for turn in range(60):
        mid = (low + high) / 2 if turn % 3 == 2 else high - v_high * (high - low) / (v_high - v_low)
        mid = mid if low < mid < high else (low + high) / 2
        v_mid = value(mid)
        if (v_mid > 0) == (v_low > 0):
            moved, low, v_low = mid - low, mid, v_mid
        else:
            moved, high, v_high = high - mid, mid, v_mid
        if v_mid == 0 or high - low < 1e-13 or moved < 1e-15:
            break
    shown = quantize(Decimal(mid), places)
    with localcontext(WIDE):
        reach = Decimal(5).scaleb(-places - 1) - TIE
        if not Decimal("-0.9") < shown - reach < shown + reach < 1:
            return None
        ends = []
        for rate in (shown - reach, shown + reach):
            step, total = 1 / (1 + rate), Decimal(0)
            for flow in reversed(flows):
                total = total * step + flow
            ends.append(total)
    return shown if ends[0] * ends[1] < 0 else None


@dataclass
class Bracket:
    """The search for the root of a value function that can price several rates at once. `asked` are the rates to price next; `tell` takes their values.

    With one sign change the value is monotone in the discount factor's sign pattern, so a bracket holds one root;
    it is narrowed by a secant step that falls back to halving, and short exact decimals are recognised. The state is a few numbers and words, so that many
    searches can advance together and be written between their steps.
    """

    phase: str = "open"  # open, narrow, ends, short or done
    asked: list[Decimal] = field(default_factory=lambda: [Decimal("-0.9"), Decimal(1)])
    low: Decimal = Decimal("-0.9")
    high: Decimal = Decimal(1)
    v_low: Decimal = Decimal(0)
    v_high: Decimal = Decimal(0)
    last: str = ""
    turn: int = 0
    root: Decimal | None = None

    def tell(self, values: list[Decimal]) -> None:
        """TYPE faults where no rate is in reach. To be called in the context WIDE."""
        if self.phase == "open":
            self.v_low, self.v_high = values
            if self.v_low and (self.v_low > 0) == (self.v_high > 0):
                if self.high >= Decimal("1e12") and self.low <= Decimal("-0.999999999999"):
                    raise Fault("TYPE", "IRR has no rate in reach")
                self.high = self.high * 4 if self.high < Decimal("1e12") else self.high
                self.low = (self.low - 9) / 10 if self.low > Decimal("-0.999999999999") else self.low
                self.asked = [self.low, self.high]
                return
            self._next()
        elif self.phase == "narrow":
            (mid,), (v_mid,) = self.asked, values
            if (v_mid > 0) == (self.v_low > 0):
                self.low, self.v_low = mid, v_mid
                if self.last == "low":
                    self.v_high /= 2
                self.last = "low"
            else:
                self.high, self.v_high = mid, v_mid
                if self.last == "high":
                    self.v_low /= 2
                self.last = "high"
            self.turn += 1
            if self.high - self.low < ROOT_WIDTH:
                self.phase, self.asked = "ends", [self.low, self.high]
            else:
                self._next()
        elif self.phase == "ends":
            at_low, at_high = values
            self.root = self.low if at_low == 0 else self.high if at_high == 0 else (self.low + self.high) / 2
            short = [self.root.quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP, context=WIDE) for places in range(13)]
            self.phase, self.asked = "short", [r for r in short if r > -1]
        else:
            self.root = next((r for r, v in zip(self.asked, values, strict=True) if v == 0), self.root)
            self.phase, self.asked = "done", []

    def _next(self) -> None:
        if self.turn == 400 or self.v_low == 0 or self.v_high == 0:
            self.phase, self.asked = "ends", [self.low, self.high]
            return
        low, high, v_low, v_high = self.low, self.high, self.v_low, self.v_high
        mid = (low + high) / 2 if self.turn % 3 == 2 or v_high == v_low else high - v_high * (high - low) / (v_high - v_low)
        self.phase, self.asked = "narrow", [mid if low < mid < high else (low + high) / 2]


def irr_of(sign_changes: int, values: Callable[[list[Decimal]], list[Decimal]]) -> Decimal:
    """The root that a Bracket finds, for flows of which `sign_changes` follow another sign."""
    if sign_changes != 1:
        raise Fault("TYPE", "IRR needs flows that change sign exactly once")
    with localcontext(WIDE):
        search = Bracket()
        while search.phase != "done":
            search.tell(values(search.asked))
    return CONTEXT.plus(search.root)


def pmt(rate: Decimal, periods: Decimal, present: Decimal) -> Decimal:
    """The level payment that repays `present` over `periods` at `rate`."""
    if rate <= -1:
        raise Fault("TYPE", "PMT needs a rate above -1")
    if periods <= 0 or periods != periods.to_integral_value():
        raise Fault("TYPE", "PMT needs a positive whole number of periods")
    with localcontext(WIDE):
        if rate == 0:
            return CONTEXT.plus(present / periods)
        return CONTEXT.plus(present * rate / (1 - (1 + rate) ** -int(periods)))
