"""The library of 101 formulaic alphas, in two namespaces.

`PANEL_ALPHAS` (98) takes ranks and scales over a date. Not in it are 007 (which
needs the day of the month), 048 and 054 (neutralised by industry). Simplified
against the published list, as the library that these follow has them: 056, 058,
059, 063, 067, 069, 070, 076, 079, 080, 082, 087, 089-091, 093, 097, 100.

`TICKER_ALPHAS` (82) takes them over an instrument's whole history, so it looks
ahead; its windows begin with one known cell, and it has no 048, 056, 058, 059, 063,
067, 069, 070, 076, 079, 080, 082, 087, 089-091, 093, 097, 100.

Formulas are built of shared terms. What both namespaces have is written once; the
dialect says what a function means, and its softer forms (`corr0`, `or0`, `or1`,
`safe`, `level`) do nothing but in the ticker namespace.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factorloom.functions import core, ticker
from factorloom.functions.core import _pairwise, over
from factorloom.functions.formulas import DATE, INSTRUMENT, ROW, Cell, Dialect, Formula, Sheet

# --- the two dialects --------------------------------------------------------

_SHORT = {"mean": "ts_mean", "total": "ts_sum", "least": "ts_min", "most": "ts_max", "std": "ts_std", "delta": "ts_delta", "corr": "ts_corr", "corr0": "ts_corr", "cov": "ts_cov", "place": "ts_rank", "argmax": "ts_argmax", "argmin": "ts_argmin", "fade": "decay_linear", "product": "ts_product", "level": "ts_mean", "year": "ts_sum", "delay": "delay"}
_same = lambda x: x
_ROWS = {**ROW, "lower": core.ele_min, "upper": core.ele_max, "ln": core.log, "or0": _same, "or1": _same, "safe": lambda x, _: x, "below": ROW["<"]}

PANEL_DIALECT = Dialect(_ROWS, {**INSTRUMENT, **{k: getattr(core, v) for k, v in _SHORT.items()}}, "date", DATE)


def _whole(value: Column, x: Column, n: int) -> Column:
    """Null unless every cell of the window is known."""
    return F.when(F.count(x).over(over(n)) == F.count(F.lit(1)).over(over(n)), value)


def _corr(x: Column, y: Column, n: int) -> Column:
    a, b = _pairwise(x, y)
    w = over(n)
    return F.try_divide(F.covar_pop(a, b).over(w), F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w))


def _first_null(x: Column, n: int) -> Column:
    """Place of the window's oldest unknown cell."""
    return ticker._from_start(F.min(F.when(x.isNull(), core._row())).over(over(n)), n)


_TICKER_ROWS = {
    **_ROWS, "lower": F.least, "upper": F.greatest, "ln": lambda x: F.when(x > 0, F.ln(x)), "log": ticker.log, "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "or0": lambda x: F.coalesce(x, F.lit(0.0)), "or1": lambda x: F.coalesce(x, F.lit(1.0)),
    "safe": lambda x, d: F.when(x == 0, d).otherwise(x), "where": lambda c, a, b: F.when(c != 0, a).otherwise(b),
}
_TICKER_WINDOWS = {
    "mean": ticker.sma, "total": ticker.ts_sum, "least": ticker.ts_min, "most": ticker.ts_max, "std": ticker.stddev, "delta": core.ts_delta, "delay": core.delay, "corr": _corr, "corr0": ticker.correlation, "cov": ticker.covariance, "place": ticker.ts_rank,
    "argmax": lambda x, n: F.coalesce(_first_null(x, n), ticker.ts_argmax(x, n)), "argmin": lambda x, n: F.coalesce(_first_null(x, n), ticker.ts_argmin(x, n)), "fade": lambda x, n: _whole(ticker.decay_linear(x, n), x, n),
    "product": lambda x, n: _whole(ticker.product(x, n), x, n), "level": lambda x, n: ticker.ts_sum(x, n) / n, "year": ticker.sma,
}

TICKER_DIALECT = Dialect(_TICKER_ROWS, _TICKER_WINDOWS, "instrument", {"rank": ticker.rank, "scale": ticker.scale}, ticker.rank)

# --- terms that formulas share -----------------------------------------------


class Terms:
    """A sheet's names, and the terms that many formulas have in common."""

    def __init__(self, sheet: Sheet):
        self.sheet = sheet

    def __getattr__(self, name: str):
        return getattr(self.sheet, name)

    def usual(self, n: int) -> Cell:
        """Mean volume."""
        return self.mean(self.volume, n)

    def busy(self) -> Cell:
        """Volume to its mean of 20."""
        return self.volume / self.usual(20)

    def mid(self) -> Cell:
        return (self.high + self.low) / 2

    def body(self) -> Cell:
        return self.close - self.open

    def mix(self, a: Cell, b: Cell, share: float, rest: float) -> Cell:
        return a * share + b * rest

    def ranks(self, a: Cell, b: Cell) -> tuple[Cell, Cell]:
        return self.rank(a), self.rank(b)

    def lean(self) -> Cell:
        """How much nearer to the low than to the high the close is."""
        return (self.close - self.low) - (self.high - self.close)

    def bend(self) -> Cell:
        """The slope of the ten rows before the last ten, less that of the last ten."""
        then = self.delay(self.close, 10)
        return (self.delay(self.close, 20) - then) / 10 - (then - self.close) / 10

    def bent(self, limit: float, otherwise: Cell | None = None) -> Cell:
        return self.where(self.bend() < limit, 1.0, -self.delta(self.close, 1) if otherwise is None else otherwise)

    def steady(self, n: int) -> Cell:
        """The last change where all of n went its way, else its opposite."""
        d = self.delta(self.close, 1)
        return self.where(self.least(d, n) > 0, d, self.where(self.most(d, n) < 0, d, -d))

    def in_ranks(self, field: str, n: int) -> Cell:
        """Minus the correlation of a field's rank with that of volume."""
        return -self.corr(*self.ranks(getattr(self, field), self.volume), n)

    def over_low(self, x: Cell, n: int) -> Cell:
        return self.rank(x - self.least(x, n))

    def drop(self, *steps: int) -> Cell:
        """-1 where the close has risen from one lag to another, else 0."""
        a, b = (self.close if s == 0 else self.delay(self.close, s) for s in steps)
        return self.where(a - b > 0, -1.0, 0.0) if steps[0] == 0 else self.where(a - b < 0, -1.0, 0.0)


Built = dict[str, Formula]


def _made(terms: dict) -> Built:
    return {f"alpha{k:03d}": lambda sheet, f=f: f(Terms(sheet)) for k, f in terms.items()}


# --- families ----------------------------------------------------------------

#: Field and window of the formulas that correlate its rank with that of volume.
_IN_RANKS = {3: ("open", 10), 89: ("open", 10), 90: ("close", 10), 91: ("high", 10), 93: ("low", 10), 100: ("open", 10)}
#: Where the bend of the close counts as down.
_BENDS = {49: -0.1, 51: -0.05}
#: Formulas that are the rank of one correlation less that of another.
_LEADS = {
    67: lambda t: [t.corr(t.usual(20), x, 5) for x in (t.high, t.low)],
    76: lambda t: [t.corr(t.vwap, t.usual(n), 5) for n in (50, 20)],
    79: lambda t: [t.corr(t.close, t.volume, 10), t.corr(t.delay(t.close, 1), t.delay(t.close, 2), 250)],
    80: lambda t: [t.place(x, 5) for x in (t.close, t.volume)],
    82: lambda t: [t.corr(x, t.rank(t.volume), 10) for x in (t.close, t.vwap)],
    87: lambda t: [t.corr(*t.ranks(x, t.volume), 10) for x in (t.close, t.open)],
}
#: Length of the second mean volume.
_FLOORS = {58: 5, 59: 40}
#: The two sides of the formulas that are -1 where the first is below the second, else 0.
_BELOW = {
    61: lambda t: (t.over_low(t.vwap, 16), t.rank(t.corr(t.vwap, t.usual(180), 18))),
    62: lambda t: (t.rank(t.corr(t.vwap, t.mean(t.usual(20), 22), 10)), t.rank(2 * t.rank(t.open) < t.rank(t.mid()) + t.rank(t.high))),
    64: lambda t: (t.rank(t.corr(t.mean(t.mix(t.open, t.low, 0.178404, 0.821596), 13), t.mean(t.usual(120), 13), 17)), t.rank(t.delta(t.mix(t.mid(), t.vwap, 0.178404, 0.821596), 4))),
    65: lambda t: (t.rank(t.corr(t.mix(t.open, t.vwap, 0.00817205, 0.99182795), t.mean(t.usual(60), 9), 6)), t.over_low(t.open, 14)),
    68: lambda t: (t.place(t.corr(*t.ranks(t.high, t.usual(15)), 9), 14), t.rank(t.delta(t.mix(t.close, t.low, 0.518371, 0.481629), 2))),
    74: lambda t: (t.rank(t.corr(t.close, t.total(t.usual(30), 37), 15)), t.rank(t.corr(*t.ranks(t.mix(t.high, t.vwap, 0.0261661, 0.9738339), t.volume), 11))),
    75: lambda t: (t.rank(t.corr(t.vwap, t.volume, 4)), t.rank(t.corr(*t.ranks(t.low, t.usual(50)), 12))),
    81: lambda t: (t.rank(t.log(t.product(t.rank(t.rank(t.corr(t.vwap, t.total(t.usual(10), 50), 8) ** 4)), 15))), t.rank(t.corr(*t.ranks(t.vwap, t.volume), 5))),
    86: lambda t: (t.place(t.corr(t.close, t.total(t.usual(20), 15), 6), 20), t.rank((t.open + t.close) - (t.vwap + t.open))),
    95: lambda t: (t.over_low(t.open, 12), t.place(t.rank(t.corr(t.total(t.mid(), 19), t.total(t.usual(40), 19), 13) ** 5), 12)),
    99: lambda t: (t.rank(t.corr(t.total(t.mid(), 20), t.total(t.usual(60), 20), 9)), t.rank(t.corr(t.low, t.volume, 6))),
}
#: The two values of the formulas that take the lower, the higher, or minus the higher of them.
_LOWER = {
    77: lambda t: (t.rank(t.fade((t.mid() + t.high) - (t.vwap + t.high), 20)), t.rank(t.fade(t.corr(t.mid(), t.usual(40), 3), 6))),
    88: lambda t: (t.rank(t.fade((t.rank(t.open) + t.rank(t.low)) - (t.rank(t.high) + t.rank(t.close)), 8)), t.place(t.fade(t.corr(t.place(t.close, 8), t.place(t.usual(60), 21), 8), 7), 3)),
    92: lambda t: (t.place(t.fade(t.mid() + t.close < t.low + t.open, 15), 19), t.place(t.fade(t.corr0(*t.ranks(t.low, t.usual(30)), 8), 7), 7)),
}
_HIGHER = {71: lambda t: (t.place(t.fade(t.corr(t.place(t.close, 3), t.place(t.usual(180), 12), 18), 4), 16), t.place(t.fade(t.rank((t.low + t.open) - 2 * t.vwap) ** 2, 16), 4))}


def _shrinking(t: Terms) -> Cell:
    price = t.mix(t.open, t.low, 0.147155, 0.852845)
    return t.place(t.fade(-(t.delta(price, 2) / price), 3), 17)


_NOT_HIGHER = {
    73: lambda t: (t.rank(t.fade(t.delta(t.vwap, 5), 3)), _shrinking(t)),
    96: lambda t: (t.place(t.fade(t.corr(*t.ranks(t.vwap, t.volume), 4), 4), 8), t.place(t.fade(t.argmax(t.corr(t.place(t.close, 7), t.place(t.usual(60), 4), 4), 13), 14), 13)),
}
#: Base and exponent of the formulas that are a power of ranks.
_POWERS = {
    78: lambda t: (t.rank(t.corr(t.total(t.mix(t.low, t.vwap, 0.352233, 0.647767), 20), t.total(t.usual(40), 20), 7)), t.rank(t.corr(*t.ranks(t.vwap, t.volume), 6))),
    85: lambda t: (t.rank(t.corr(t.mix(t.high, t.close, 0.876703, 0.123297), t.usual(30), 10)), t.rank(t.corr(t.place(t.mid(), 4), t.place(t.volume, 10), 7))),
    94: lambda t: (t.over_low(t.vwap, 12), t.place(t.corr(t.place(t.vwap, 20), t.place(t.usual(60), 4), 18), 3)),
}

# --- single formulas ---------------------------------------------------------


def _turning(t: Terms) -> Cell:
    d = t.delta(t.close, 1)
    return t.rank(t.sign(d) + t.sign(t.delay(d, 1)) + t.sign(t.delay(d, 2)))


def _above_bands(t: Terms) -> Cell:
    slow, fast, dev = t.level(t.close, 8), t.level(t.close, 2), t.std(t.close, 8)
    return t.where(slow + dev < fast, -1.0, t.where(fast < slow - dev, 1.0, t.where(t.busy() >= 1, 1.0, -1.0)))


def _weighed(t: Terms) -> Cell:
    parts = (
        (2.21, t.corr(t.body(), t.delay(t.volume, 1), 15)), (0.7, t.open - t.close), (0.73, t.place(t.delay(-t.returns, 6), 5)), (1.0, t.abs(t.corr(t.vwap, t.usual(20), 6))), (0.6, (t.mean(t.close, 200) - t.open) * t.body()),
    )
    first, *others = (w * t.rank(x) for w, x in parts)
    return sum(others, first)


def _range_place(t: Terms) -> Cell:
    low = t.least(t.low, 12)
    return (t.close - low) / t.safe(t.most(t.high, 12) - low, 0.0001)


def _spread_to_price(t: Terms, price: Cell) -> Cell:
    spread = (t.high - t.low) / price
    return t.rank(t.delay(spread, 2)) * t.rank(t.rank(t.volume)) / (spread / (t.vwap - t.close))


def _momentum_of_product(t: Terms, later: str) -> Cell:
    grown = t.total(t.open, 5) * t.total(t.returns, 5)
    return -t.rank(grown - getattr(t, later)(grown, 10))


def _nested_ranks(t: Terms) -> Cell:
    falling = t.rank(t.rank(-t.rank(t.delta(t.close, 5))))
    return t.least(t.rank(t.rank(t.scale(t.log(t.total(falling, 2))))), 5) + t.place(t.delay(-t.returns, 6), 5)


_BOTH = {
    1: lambda t: t.rank(t.argmax(t.signedpower(t.where(t.returns < 0, t.std(t.returns, 20), t.close), 2), 5)) - 0.5,
    2: lambda t: -t.corr0(*t.ranks(t.delta(t.ln(t.volume), 2), (t.close - t.open) / t.open), 6),
    4: lambda t: -t.place(t.rank(t.low), 9),
    5: lambda t: t.rank(t.open - t.level(t.vwap, 10)) * -t.abs(t.rank(t.close - t.vwap)),
    6: lambda t: -t.corr0(t.open, t.volume, 10),
    9: lambda t: t.steady(5),
    10: lambda t: t.rank(t.steady(4)),
    11: lambda t: (t.rank(t.most(t.vwap - t.close, 3)) + t.rank(t.least(t.vwap - t.close, 3))) * t.rank(t.delta(t.volume, 3)),
    12: lambda t: t.sign(t.delta(t.volume, 1)) * -t.delta(t.close, 1),
    13: lambda t: -t.rank(t.cov(*t.ranks(t.close, t.volume), 5)),
    14: lambda t: -t.rank(t.delta(t.returns, 3)) * t.corr0(t.open, t.volume, 10),
    15: lambda t: -t.total(t.rank(t.corr0(*t.ranks(t.high, t.volume), 3)), 3),
    16: lambda t: -t.rank(t.cov(*t.ranks(t.high, t.volume), 5)),
    17: lambda t: -t.rank(t.place(t.close, 10)) * t.rank(t.delta(t.delta(t.close, 1), 1)) * t.rank(t.place(t.busy(), 5)),
    18: lambda t: -t.rank(t.std(t.abs(t.body()), 5) + t.body() + t.corr0(t.close, t.open, 10)),
    19: lambda t: -t.sign((t.close - t.delay(t.close, 7)) + t.delta(t.close, 7)) * (1 + t.rank(1 + t.total(t.returns, 250))),
    20: lambda t: -t.rank(t.open - t.delay(t.high, 1)) * t.rank(t.open - t.delay(t.close, 1)) * t.rank(t.open - t.delay(t.low, 1)),
    21: _above_bands,
    22: lambda t: -(t.delta(t.corr0(t.high, t.volume, 5), 5) * t.rank(t.std(t.close, 20))),
    23: lambda t: t.where(t.mean(t.high, 20) < t.high, -t.or0(t.delta(t.high, 2)), 0.0),
    24: lambda t: t.where(t.delta(t.level(t.close, 100), 100) / t.delay(t.close, 100) <= 0.05, t.least(t.close, 100) - t.close, -t.delta(t.close, 3)),
    25: lambda t: t.rank(-t.returns * t.usual(20) * t.vwap * (t.high - t.close)),
    26: lambda t: -t.most(t.corr0(t.place(t.volume, 5), t.place(t.high, 5), 5), 3),
    28: lambda t: t.scale(t.corr0(t.usual(20), t.low, 5) + t.mid() - t.close),
    29: _nested_ranks,
    30: lambda t: (1.0 - _turning(t)) * t.total(t.volume, 5) / t.total(t.volume, 20),
    31: lambda t: t.rank(t.rank(t.rank(t.fade(-t.rank(t.rank(t.delta(t.close, 10))), 10)))) + t.rank(-t.delta(t.close, 3)) + t.sign(t.scale(t.corr0(t.usual(20), t.low, 12))),
    32: lambda t: t.scale(t.mean(t.close, 7) - t.close) + 20 * t.scale(t.corr0(t.vwap, t.delay(t.close, 5), 230)),
    33: lambda t: t.rank(t.open / t.close - 1),
    34: lambda t: t.rank((1 - t.rank(t.or1(t.std(t.returns, 2) / t.std(t.returns, 5)))) + (1 - t.rank(t.delta(t.close, 1)))),
    35: lambda t: t.place(t.volume, 32) * (1 - t.place(t.close + t.high - t.low, 16)) * (1 - t.place(t.returns, 32)),
    36: _weighed,
    37: lambda t: t.rank(t.corr(t.delay(t.open - t.close, 1), t.close, 200)) + t.rank(t.open - t.close),
    38: lambda t: -t.rank(t.place(t.close, 10)) * t.rank(t.or1(t.close / t.open)),
    39: lambda t: -t.rank(t.delta(t.close, 7) * (1 - t.rank(t.fade(t.busy(), 9)))) * (1 + t.rank(t.year(t.returns, 250))),
    40: lambda t: -t.rank(t.std(t.high, 10)) * t.corr(t.high, t.volume, 10),
    41: lambda t: t.sqrt(t.high * t.low) - t.vwap,
    42: lambda t: t.rank(t.vwap - t.close) / t.rank(t.vwap + t.close),
    43: lambda t: t.place(t.busy(), 20) * t.place(-t.delta(t.close, 7), 8),
    44: lambda t: -t.corr0(t.high, t.rank(t.volume), 5),
    45: lambda t: -(t.rank(t.mean(t.delay(t.close, 5), 20)) * t.corr0(t.close, t.volume, 2) * t.rank(t.corr(t.total(t.close, 5), t.total(t.close, 20), 2))),
    46: lambda t: t.bent(0.0, t.where(t.bend() > 0.25, -1.0, -t.delta(t.close, 1))),
    47: lambda t: t.rank(1 / t.close) * t.busy() * (t.high * t.rank(t.high - t.close) / (t.mean(t.high, 5) / 5)) - t.rank(t.vwap - t.delay(t.vwap, 5)),
    50: lambda t: -t.most(t.rank(t.corr(*t.ranks(t.volume, t.vwap), 5)), 5),
    52: lambda t: -t.delta(t.least(t.low, 5), 5) * t.rank((t.total(t.returns, 240) - t.total(t.returns, 20)) / 220) * t.place(t.volume, 5),
    53: lambda t: -t.delta(t.lean() / t.safe(t.close - t.low, 0.0001), 9),
    55: lambda t: -t.corr0(*t.ranks(_range_place(t), t.volume), 6),
    57: lambda t: -(t.close - t.vwap) / t.fade(t.rank(t.argmax(t.close, 30)), 2),
    60: lambda t: t.scale(t.rank(t.argmax(t.close, 10))) - 2 * t.scale(t.rank(t.lean() * t.volume / t.safe(t.high - t.low, 0.0001))),
    66: lambda t: -(t.rank(t.fade(t.delta(t.vwap, 4), 7)) + t.place(t.fade((t.mix(t.low, t.low, 0.96633, 0.03367) - t.vwap) / (t.open - t.mid()), 11), 7)),
    72: lambda t: t.rank(t.fade(t.corr(t.mid(), t.usual(40), 9), 10)) / t.rank(t.fade(t.corr(t.place(t.vwap, 4), t.place(t.volume, 19), 7), 3)),
    98: lambda t: t.rank(t.fade(t.corr(t.vwap, t.total(t.usual(5), 26), 5), 7)) - t.rank(t.fade(t.place(t.argmin(t.corr(*t.ranks(t.open, t.usual(15)), 21), 9), 7), 8)),
    101: lambda t: t.body() / (t.high - t.low + 0.001),
    **{k: lambda t, f=f: t.lower(*f(t)) for k, f in _LOWER.items()},
    **{k: lambda t, f=f: t.upper(*f(t)) for k, f in _HIGHER.items()},
    **{k: lambda t, f=f: -t.upper(*f(t)) for k, f in _NOT_HIGHER.items()},
    **{k: lambda t, f=f, s=-1 if k == 94 else 1: s * (lambda a, b: a**b)(*f(t)) for k, f in _POWERS.items()},
    **{k: lambda t, x=x: t.bent(x) for k, x in _BENDS.items()},
}

_PANEL_ONLY = {
    8: lambda t: _momentum_of_product(t, "delay"),
    27: lambda t: t.where(t.rank(t.mean(t.corr(*t.ranks(t.volume, t.vwap), 6), 2) / 2.0) > 0.5, -1.0, 1.0),
    56: lambda t: sum((t.drop(*s) for s in ((0, 10), (0, 5), (0, 1), (1, 5), (5, 10), (10, 20))), t.drop(0, 20)),
    63: lambda t: -t.rank(t.fade(t.corr(*t.ranks(t.close, t.usual(20)), 10), 10)),
    69: lambda t: t.rank(t.usual(20)) + t.rank(t.least(t.low, 20)) - t.rank(t.most(t.high, 20)),
    70: lambda t: -t.rank(t.delta(t.close, 1)) * t.rank(t.usual(20)),
    83: lambda t: _spread_to_price(t, t.mean(t.close, 5) / 5),
    84: lambda t: t.signedpower(t.place(t.vwap - t.most(t.vwap, 15), 21), 5),  # an exponent that is a series counts as 5 there
    97: lambda t: -(t.rank(t.fade(t.delta(t.vwap, 5), 3)) + t.rank(t.fade(t.delta(t.close, 5), 3))),
    **{k: lambda t, a=a: t.in_ranks(*a) for k, a in _IN_RANKS.items()},
    **{k: lambda t, f=f: (lambda a, b: t.rank(a) - t.rank(b))(*f(t)) for k, f in _LEADS.items()},
    **{k: lambda t, n=n: t.rank(t.corr(t.least(t.low, 5), t.usual(n), 5)) - t.most(t.rank(t.corr(t.low, t.usual(20), 5)), 5) for k, n in _FLOORS.items()},
    **{k: lambda t, f=f: -t.below(*f(t)) for k, f in _BELOW.items()},
}

_TICKER_ONLY = {
    3: lambda t: -t.corr0(*t.ranks(t.open, t.volume), 10),
    7: lambda t: t.where(t.usual(20) >= t.volume, -1.0, -t.place(t.abs(t.delta(t.close, 7)), 60) * t.sign(t.delta(t.close, 7))),
    8: lambda t: _momentum_of_product(t, "delta"),  # a change where the formula's text has a lag
    27: lambda t: 1.0 + 0.0 * t.rank(t.total(t.corr0(*t.ranks(t.volume, t.vwap), 6), 2) / 2.0),  # 1 wherever the rank is known: what was set to -1 is set again
    54: lambda t: -(t.low - t.close) * t.open**5 / (t.safe(t.low - t.high, -0.0001) * t.close**5),
    83: lambda t: _spread_to_price(t, t.level(t.close, 5)),
    84: lambda t: t.place(t.vwap - t.most(t.vwap, 15), 21) ** t.delta(t.close, 5),
    **{k: lambda t, f=f, s=1 if k in (61, 75, 95) else -1: s * t.below(*f(t)) for k, f in _BELOW.items()},  # three give 1 where the others give -1
}

PANEL_ALPHAS: Built = dict(sorted(_made({**_BOTH, **_PANEL_ONLY}).items()))
TICKER_ALPHAS: Built = dict(sorted(_made({**_BOTH, **_TICKER_ONLY}).items()))
