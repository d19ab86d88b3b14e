"""Many formulas over one dense panel, as a graph of shared cells.

A formula is a function of the sheet's names: `lambda f: -f.ts_corr(f.rank(f.open),
f.rank(f.volume), 10)`. Arithmetic joins cells of one row; a call of a window
function is a cell of its own, made once however many formulas take it.

Calls are put into passes: over an instrument's dates, then over the other kind of
group, and so on. The calls of a pass share one shuffle and one sort; what they
take and give are plain columns. Passes of many calls are cut into stages of at
most WIDTH calls. Each stage is written once and read by the next, with the
columns that are still needed, so that plans stay small: they grow neither with
the number of formulas nor with their depth.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions import core, ticker
from factorloom.sources.stages import Stages

#: Window calls to a stage.
WIDTH = 110
#: Formulas with no more calls than this are one plan without stored stages.
ONE_PLAN = 48

Row = Callable[..., Column]


def _power(a: Column, b: Column) -> Column:
    """a to the power b; 1 where b is 0 or a is 1, also where the other is unknown; null where undefined."""
    p = F.pow(a, b)
    return F.when((b == 0) | (a == 1), 1.0).when(~F.isnan(p), p)


#: Functions of one row; a comparison gives 1 or 0, 0 where a side is null.
ROW: dict[str, Row] = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide, "**": _power, "neg": lambda a: -a, ">": core.greater, "<": lambda a, b: core.greater(b, a),
    "<=": lambda a, b: F.when(a <= b, 1.0).otherwise(0.0), ">=": lambda a, b: F.when(a >= b, 1.0).otherwise(0.0),
    "abs": F.abs, "sign": core.sign, "log": core.log, "sqrt": core.sqrt, "signedpower": lambda a, p: F.signum(a) * _power(F.abs(a), p), "where": core.if_, "ele_min": core.ele_min, "ele_max": core.ele_max,
}
#: Functions over the cells of a date, and over an instrument's cells by date.
DATE = {"rank": core.rank, "scale": core.scale}
INSTRUMENT = {
    **{k: getattr(core, k) for k in ("ts_rank", "ts_cov", "ts_mean", "ts_std", "ts_var", "ts_skew", "ts_kurt", "ts_min", "ts_max", "ts_sum", "ts_delta", "ts_pct_change", "ts_zscore", "ts_slope", "ts_decay", "delay", "ts_argmax", "ts_argmin", "decay_linear", "ts_product", "ts_corr")},
    "correlation": core.ts_corr,
}
#: Rows before its own that a window function of n takes; n - 1 where not listed, None for all.
_BACK: dict[str, Callable[[int], int] | None] = {"delay": lambda n: n, "ts_delta": lambda n: n, "ts_pct_change": lambda n: n, "delta": lambda n: n, "ts_decay": None, "ema": None}


@dataclass(frozen=True)
class Dialect:
    """The functions that formulas may call. `other` are those over groups without an order: the key of the groups, and the functions."""

    row: Mapping[str, Row] = field(default_factory=lambda: ROW)
    instrument: Mapping[str, Row] = field(default_factory=lambda: INSTRUMENT)
    key: str = "date"
    other: Mapping[str, Row] = field(default_factory=lambda: DATE)
    rank: Row = core.rank


PANEL = Dialect()


@dataclass(frozen=True, eq=False)
class Cell:
    """A value of every row: a field, or a function of others. kind: 0 over an instrument's dates, 1 over the other groups, None for values of one row."""

    sheet: Sheet
    text: str
    name: str
    args: tuple[Cell | float, ...] = ()
    kind: int | None = None
    at: tuple[int, int] = (-1, 0)  # pass, and place in its chain of calls, after which the value is there
    reach: int | None = 0  # rows before its own that it depends on; None: all
    number: int = 0

    def __add__(self, o): return self.sheet.row("+", self, o)
    def __radd__(self, o): return self.sheet.row("+", o, self)
    def __sub__(self, o): return self.sheet.row("-", self, o)
    def __rsub__(self, o): return self.sheet.row("-", o, self)
    def __mul__(self, o): return self.sheet.row("*", self, o)
    def __rmul__(self, o): return self.sheet.row("*", o, self)
    def __truediv__(self, o): return self.sheet.row("/", self, o)
    def __rtruediv__(self, o): return self.sheet.row("/", o, self)
    def __pow__(self, o): return self.sheet.row("**", self, o)
    def __neg__(self): return self.sheet.row("neg", self)
    def __lt__(self, o): return self.sheet.row("<", self, o)
    def __gt__(self, o): return self.sheet.row(">", self, o)
    def __le__(self, o): return self.sheet.row("<=", self, o)
    def __ge__(self, o): return self.sheet.row(">=", self, o)


class Sheet:
    """The cells of formulas over the fields of a panel; equal cells are one. Its fields and functions are attributes."""

    def __init__(self, fields: list[str], dialect: Dialect = PANEL):
        self.dialect, self.cells = dialect, {}
        self.fields = {f: Cell(self, f, f) for f in fields}

    def __getattr__(self, name: str):
        if name in self.__dict__.get("fields", {}):
            return self.fields[name]
        d = self.__dict__["dialect"]
        for known, call in ((d.row, self.row), (d.instrument, lambda *a: self._windowed(0, *a)), (d.other, lambda *a: self._windowed(1, *a))):
            if name in known:
                return lambda *args: call(name, *args)
        raise AttributeError(name)

    def _kept(self, name: str, args: tuple, *more) -> Cell:
        text = f"{name}({', '.join(a.text if isinstance(a, Cell) else repr(a) for a in args)})"
        return self.cells.setdefault(text, Cell(self, text, name, args, *more, number=len(self.cells)))

    def row(self, name: str, *args: Cell | float) -> Cell:
        cells = [a for a in args if isinstance(a, Cell)]
        return self._kept(name, args, None, max(c.at for c in cells), _most(c.reach for c in cells))

    def _windowed(self, kind: int, name: str, *args: Cell | float) -> Cell:
        cells = [a for a in args if isinstance(a, Cell)]
        now, chain = max(c.at for c in cells)
        step = max(now, 0) + (max(now, 0) % 2 != kind)
        back = _BACK.get(name, lambda n: n - 1) if kind == 0 else (lambda n: 0) if self.dialect.key == "date" else None
        n = int(args[-1]) if not isinstance(args[-1], Cell) else 1
        below = _most(c.reach for c in cells)
        reach = None if back is None or below is None else below + back(n)
        return self._kept(name, args, kind, (step, chain + 1 if step == now else 1), reach)

    # --- columns ---

    def _column(self, cell: Cell | float) -> Column:
        """A cell of one row over the columns of fields and window calls."""
        if not isinstance(cell, Cell):
            return F.lit(float(cell))
        if cell.kind is not None:
            return F.col(self._named(cell))
        if not cell.args:
            return F.col(cell.name).cast("double")
        return self.dialect.row[cell.name](*map(self._column, cell.args))

    def _named(self, cell: Cell) -> str:
        return f"_{cell.number}" if cell.args else cell.name

    def _takes(self, cell: Cell | float) -> set[str]:
        """The columns that a cell of one row is computed from."""
        if not isinstance(cell, Cell):
            return set()
        if cell.kind is not None or not cell.args:
            return {self._named(cell)}
        return set().union(*map(self._takes, cell.args))

    def _needed(self, outputs: list[Cell]) -> list[Cell]:
        """The window calls that the outputs rest on."""
        found, left = {}, list(outputs)
        while left:
            c = left.pop()
            if isinstance(c, Cell) and c.text not in found:
                found[c.text] = c
                left += c.args
        return sorted((c for c in found.values() if c.kind is not None), key=lambda c: c.at)

    def _rank_call(self, cell: Cell) -> bool:
        return cell.kind == 1 and self.dialect.other[cell.name] is self.dialect.rank

    def _ranked(self, panel: DataFrame, ranks: list[Cell], arg: Callable[[Cell], str]) -> DataFrame:
        """The panel with the ranks of many columns: as long rows in one order by group and column, so that the plan has as many steps for many columns as for one."""
        key, mean_place = self.dialect.key, self.dialect.rank is core.rank
        taken = F.array(*[F.struct(F.lit(k).alias("k"), F.col(arg(c)).alias("x")) for k, c in enumerate(ranks)])
        long = panel.select("date", "instrument", F.explode(taken).alias("c")).select("date", "instrument", "c.k", "c.x")
        each = Window.partitionBy(key, "k")
        sorted_ = long.withColumns({"first": F.rank().over(each.orderBy(F.col("x").asc_nulls_last())), "ties": F.count(F.lit(1)).over(Window.partitionBy(key, "k", "x")), "n": F.count("x").over(each)})
        place = F.when(F.col("x").isNotNull(), F.col("first") + (F.col("ties") - 1) / 2)
        if mean_place:
            placed = sorted_.select("date", "instrument", "k", (place / F.col("n")).alias("r"))
        else:  # drawn to 0..1
            last = F.max(place).over(each)
            placed = sorted_.select("date", "instrument", "k", F.try_divide(place - 1, last - 1).alias("r"))
        held = placed.groupBy("date", "instrument").agg(F.array_sort(F.collect_list(F.struct("k", "r")))["r"].alias("_ranks"))
        both = panel.join(held, ["date", "instrument"])
        return both.select(*panel.columns, *[F.get("_ranks", F.lit(k)).alias(self._named(c)) for k, c in enumerate(ranks)])

    def _staged(self, panel: DataFrame, calls: list[Cell]) -> DataFrame:
        """The panel with some calls of one pass."""
        kind = calls[0].kind
        panel = panel.repartition("instrument" if kind == 0 else self.dialect.key)
        known = self.dialect.instrument if kind == 0 else self.dialect.other
        for chain in sorted({c.at[1] for c in calls}):
            now = [c for c in calls if c.at[1] == chain]
            plain = {a.text: a for c in now for a in c.args if isinstance(a, Cell) and a.args and a.kind is None}
            names = {t: f"_arg{i}" for i, t in enumerate(plain)}
            arg = lambda a: names.get(a.text) or self._named(a)
            base = panel.columns
            panel = panel.select("*", *[self._column(a).alias(names[t]) for t, a in plain.items()])
            ranks = [c for c in now if self._rank_call(c)]
            if len(ranks) > 1:
                panel = self._ranked(panel, ranks, lambda c: arg(c.args[0]))
                now = [c for c in now if c not in ranks]
                base = [*base, *[self._named(c) for c in ranks]]
            columns = [known[c.name](*[F.col(arg(a)).cast("double") if isinstance(a, Cell) else a for a in c.args]).cast("double").alias(self._named(c)) for c in now]
            panel = panel.select(*base, *columns)
        return panel

    def added(self, panel: DataFrame, outputs: Mapping[str, Cell], width: int = WIDTH) -> DataFrame:
        """date, instrument and the outputs. With more than ONE_PLAN window calls, or `width`, the stages are stored at once; else nothing runs yet."""
        calls = self._needed([*outputs.values()])
        groups: list[list[Cell]] = []
        for c in calls:  # ranks of any number are one step of the plan
            many = sum(self._rank_call(x) is False for x in groups[-1]) if groups else 0
            if not groups or groups[-1][0].at[0] != c.at[0] or many >= width:
                groups.append([])
            groups[-1].append(c)
        stages = Stages(panel.sparkSession, "formulas") if len(calls) > min(width, ONE_PLAN) else None
        wanted = set().union(*map(self._takes, outputs.values())) if outputs else set()
        if stages:
            panel = stages.store(panel)
        for i, group in enumerate(groups):
            later = wanted.union(*[self._takes(a) for g in groups[i + 1 :] for c in g for a in c.args])
            now = later.union(*[self._takes(a) for c in group for a in c.args])
            panel = panel.select("date", "instrument", *sorted(x for x in panel.columns if x in now))
            panel = self._staged(panel, group)
            panel = panel.select("date", "instrument", *[x for x in panel.columns if x in later])
            if stages:
                panel = stages.next(panel)
        return panel.select("date", "instrument", *[self._column(c).alias(n) for n, c in outputs.items()])


def _most(reaches) -> int | None:
    held = list(reaches)
    return None if None in held else max(held, default=0)


Formula = Callable[[Sheet], Cell]


def sheet_of(panel: DataFrame, dialect: Dialect = PANEL) -> Sheet:
    return Sheet([c for c in panel.columns if c not in ("date", "instrument")], dialect)


def reach(fields: list[str], formulas: Mapping[str, Formula], dialect: Dialect = PANEL) -> dict[str, int | None]:
    """How many rows before its own each formula depends on; None where on all, as exponential means do."""
    sheet = Sheet(fields, dialect)
    return {name: f(sheet).reach for name, f in formulas.items()}


def exposures(panel: DataFrame, formulas: Mapping[str, Formula], dialect: Dialect = PANEL, since: dt.date | None = None, width: int = WIDTH) -> DataFrame:
    """date, instrument and a column of values for each formula over the columns of a dense panel.

    With `since` only rows from that date on are returned, and only the dates that
    they depend on are read: the calendar is looked up for the date that lies the
    formulas' reach before, and a filter by that date goes to the scan, also to
    the folders of a panel that is stored by date. Values are those of the whole
    panel; where a formula depends on all dates, all are read.
    """
    sheet = sheet_of(panel, dialect)
    cells = {name: f(sheet) for name, f in formulas.items()}
    if since is None:
        return sheet.added(panel, cells, width)
    back = _most(c.reach for c in cells.values())
    if back is not None:
        before = panel.select("date").filter(F.col("date") < F.lit(since)).distinct().orderBy(F.desc("date")).limit(max(back, 1))
        first = before.agg(F.min("date")).first()[0] if back else None
        panel = panel.filter(F.col("date") >= F.lit(first or since))
        if "month" in panel.columns:  # an archive's folders
            panel = panel.filter(F.col("month") >= F.date_format(F.lit(first or since), "yyyy-MM")).drop("month")
    return sheet.added(panel, cells, width).filter(F.col("date") >= F.lit(since))


# --- technical seeds ---------------------------------------------------------

_least_one = lambda f: lambda x, n: f(x).over(core.over(n))

#: The seeds' own functions: windows that one known cell fills (two for a deviation).
SEED_FUNCTIONS = {"delay": core.delay, "sma": _least_one(F.avg), "total": _least_one(F.sum), "lowest": _least_one(F.min), "highest": _least_one(F.max), "std": _least_one(F.stddev_samp), "ema": ticker.ema}

_EPS = 1e-10

#: The seeds by name, with the lengths and constants of the list that they follow. Fundamental ones stand for themselves by prices.
SEEDS: dict[str, Formula] = {
    "PriceMomentum": lambda f: f.close - f.delay(f.close, 14),
    "VolumeMomentum": lambda f: f.volume - f.delay(f.volume, 14),
    "RSIMomentum": lambda f: f.rsi - f.delay(f.rsi, 14),
    "PriceReturn14d": lambda f: f.close / f.delay(f.close, 14) - 1,
    "RSI_manual": lambda f: (f.total(f.gain, 14) - f.total(f.loss, 14)) / (f.total(f.gain, 14) + f.total(f.loss, 14) + _EPS) * 100,
    "Stochastic_K": lambda f: ((f.close - f.lowest(f.low, 14)) - (f.highest(f.high, 14) - f.close)) / (f.highest(f.high, 14) - f.lowest(f.low, 14) + _EPS),
    "ATRMomentum": lambda f: f.atr - f.delay(f.atr, 14),
    "Price_vs_SMA14_delay7": lambda f: f.close - f.delay(f.sma(f.close, 14), 7),
    "MeanReversion": lambda f: f.sma(f.close, 20) - f.close,
    "ZScoreMeanReversion": lambda f: (f.close - f.sma(f.close, 20)) / (f.std(f.close, 20) + _EPS),
    "BollingerBands": lambda f: (f.close - f.sma(f.close, 20)) / (2 * f.std(f.close, 20) + _EPS),
    "EMA20_minus_Close": lambda f: f.ema(f.close, 20) - f.close,
    "MaxHigh20_minus_Close": lambda f: f.highest(f.high, 20) - f.close,
    "Close_minus_MinLow20": lambda f: f.close - f.lowest(f.low, 20),
    "InverseRSI": lambda f: 100 - f.rsi,
    "StandardDeviation": lambda f: f.std(f.close, 20),
    "ATR": lambda f: f.atr,
    "BollingerBandWidth": lambda f: 4 * f.std(f.close, 20) / (f.sma(f.close, 20) + _EPS),
    "VolRatio_10_50": lambda f: f.std(f.close, 10) / (f.std(f.close, 50) + _EPS),
    "HL_EMA_ratio": lambda f: f.ema(f.high - f.low, 10) / (f.delay(f.ema(f.high - f.low, 10), 10) + _EPS) - 1,
    "PE_proxy": lambda f: 1.0 / (f.close + _EPS),
    "PB_proxy": lambda f: 1.0 / (f.close + _EPS),
    "GrossProfitMargin_proxy": lambda f: f.close / f.delay(f.close, 60) - 1,
    "OperatingProfitMargin_proxy": lambda f: f.close / f.delay(f.close, 20) - 1,
    "EarningsGrowthRate_proxy": lambda f: f.close / f.delay(f.close, 90) - 1,
    "EBITDAGrowthRate_proxy": lambda f: f.volume * f.close / (f.delay(f.volume * f.close, 1) + _EPS) - 1,
    "Volume": lambda f: f.volume,
    "VolumeReturn14d": lambda f: (f.volume - f.delay(f.volume, 14)) / (f.delay(f.volume, 14) + _EPS),
    "Turnover_proxy": lambda f: f.volume / (f.close + _EPS),
    "AverageTradingVolume": lambda f: f.sma(f.volume, 20),
    "DailyRange": lambda f: (f.high - f.low) / (f.close + _EPS),
    "DollarVolume": lambda f: f.volume * f.close,
    "ExponentialMovingAverage": lambda f: f.ema(f.close, 20),
    "Stochastic_pct_K": lambda f: (f.close - f.lowest(f.low, 14)) / (f.highest(f.high, 14) - f.lowest(f.low, 14) + _EPS) * 100,
    "Stochastic_pct_D_inv": lambda f: (f.highest(f.high, 14) - f.close) / (f.highest(f.high, 14) - f.lowest(f.low, 14) + _EPS) * -100,
}


#: Steps that the seeds take from prices: rises and falls are 0 where the change is unknown; an unknown gap is 0, the range null where high or low is.
_SEED_ROWS = {
    **ROW, "rise": lambda d: F.when(d > 0, d).otherwise(0.0), "fall": lambda d: F.when(d < 0, -d).otherwise(0.0), "gap": lambda d: F.coalesce(d, F.lit(0.0)), "widest": lambda h, a, b: F.when(h.isNotNull(), F.greatest(h, a, b)),
}
SEED_DIALECT = Dialect(_SEED_ROWS, SEED_FUNCTIONS, "date", {})


def seeds(panel: DataFrame, formulas: Mapping[str, Formula] = SEEDS) -> DataFrame:
    """date, instrument and the technical seeds over high, low, close and volume of a dense panel.

    The true range has no absolute values and takes unknown gaps as 0, but is
    null where high or low is; rises and falls are 0 where the change is unknown.
    """
    sheet = Sheet(["high", "low", "close", "volume"], SEED_DIALECT)
    last = sheet.delay(sheet.close, 1)
    change = sheet.close - last
    gain, loss = sheet.rise(change), sheet.fall(change)
    ratio = sheet.ema(gain, 10) / (sheet.ema(loss, 10) + _EPS)
    span = sheet.widest(sheet.high - sheet.low, sheet.gap(sheet.high - last), sheet.gap(sheet.low - last))
    sheet.fields |= {"gain": gain, "loss": loss, "rsi": 100 - 100 / (1 + ratio), "atr": sheet.ema(span, 14)}
    return sheet.added(panel, {name: f(sheet) for name, f in formulas.items()})
