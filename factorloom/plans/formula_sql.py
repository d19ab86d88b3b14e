"""DuckDB SQL of formulas: the windows of each function in SQL, and the levels in which formulas nest them.

The names of the functions are those of the dialects of functions/alphas.py; what
they compute is said here once more, in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from factorloom.functions.formulas import Cell
from factorloom.plans.queries import _O, _RANK, _gate, _w

Template = Callable[..., str | list[str]]

_divided = lambda a, b: f"({a} / nullif({b}, 0))"
_flag = lambda c: f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"
_power = lambda a, b: f"CASE WHEN {b} = 0 OR {a} = 1 THEN 1.0 WHEN NOT isnan(pow({a}, {b})) THEN pow({a}, {b}) END"

_ROW: dict[str, Template] = {
    "+": lambda a, b: f"({a} + {b})", "-": lambda a, b: f"({a} - {b})", "*": lambda a, b: f"({a} * {b})", "/": _divided, "**": _power, "neg": lambda a: f"(-{a})", "<": lambda a, b: _flag(f"{a} < {b}"), ">": lambda a, b: _flag(f"{a} > {b}"), "<=": lambda a, b: _flag(f"{a} <= {b}"), ">=": lambda a, b: _flag(f"{a} >= {b}"),
    "below": lambda a, b: _flag(f"{a} < {b}"), "abs": lambda a: f"abs({a})", "sign": lambda a: f"sign({a})", "signedpower": lambda a, p: f"sign({a}) * pow(abs({a}), {p})",
}
PANEL_ROW = _ROW | {
    "where": lambda c, a, b: f"CASE WHEN {c} IS NULL OR {c} <> 0 THEN {a} ELSE {b} END", "lower": lambda a, b: f"CASE WHEN {a} IS NOT NULL THEN least({a}, {b}) END", "upper": lambda a, b: f"CASE WHEN {a} IS NOT NULL THEN greatest({a}, {b}) END",
    "ln": lambda a: f"CASE WHEN {a} IS NOT NULL THEN ln(greatest({a}, 1e-10)) END", "sqrt": lambda a: f"CASE WHEN {a} IS NOT NULL THEN sqrt(greatest({a}, 0.0)) END", "or0": lambda a: a, "or1": lambda a: a, "safe": lambda a, _: a,
}
PANEL_ROW["log"] = PANEL_ROW["ln"]
TICKER_ROW = _ROW | {
    "where": lambda c, a, b: f"CASE WHEN {c} <> 0 THEN {a} ELSE {b} END", "lower": lambda a, b: f"least({a}, {b})", "upper": lambda a, b: f"greatest({a}, {b})", "ln": lambda a: f"CASE WHEN {a} > 0 THEN ln({a}) END",
    "log": lambda a: f"coalesce(CASE WHEN {a} > 0 THEN ln({a}) END, 0.0)", "sqrt": lambda a: f"CASE WHEN {a} >= 0 THEN sqrt({a}) END", "or0": lambda a: f"coalesce({a}, 0.0)", "or1": lambda a: f"coalesce({a}, 1.0)", "safe": lambda a, d: f"CASE WHEN {a} = 0 THEN {d} ELSE {a} END",
}


def _over(name: str, least: Callable[[int], int] | None = None) -> Template:
    return lambda x, n: _gate(f"{name}({x}) OVER {_w(n)}", x, n, least(n)) if least else f"{name}({x}) OVER {_w(n)}"


_half, _mean, _pair, _third = (lambda n: min(max(2, n // 2), n)), (lambda n: max(1, n // 2)), (lambda n: min(max(3, n // 2), n)), (lambda n: min(max(2, 2 * n // 3), n))


def _both(x: str, y: str) -> tuple[str, str]:
    return f"CASE WHEN {y} IS NOT NULL THEN {x} END", f"CASE WHEN {x} IS NOT NULL THEN {y} END"


def _corr(x: str, y: str, n: int) -> str:
    a, b = _both(x, y)
    return f"covar_pop({x}, {y}) OVER {_w(n)} / nullif(stddev_pop({a}) OVER {_w(n)} * stddev_pop({b}) OVER {_w(n)}, 0)"


def _panel_place(x: str, n: int) -> str:
    cells = f"list({x}) FILTER ({x} IS NOT NULL) OVER {_w(n)}"
    share = f"(len(list_filter({cells}, lambda v: v < {x})) + (len(list_filter({cells}, lambda v: v = {x})) + 1) / 2.0) / len({cells}) / {n}"
    return f"CASE WHEN {x} IS NOT NULL THEN {_gate(share, x, n, _half(n))} END"


def _extreme(f: str, s: str) -> Template:
    """The place, from the window's start, of the oldest cell that is greatest or least."""
    return lambda x, n: f"({f}(i, CASE WHEN {x} IS NOT NULL THEN row({x}, {s}i) END) OVER {_w(n)} - greatest(i - {n - 1}, 0))"


_lags: dict[str, Template] = {"delay": lambda x, n: f"lag({x}, {n}) OVER {_O}", "delta": lambda x, n: f"{x} - lag({x}, {n}) OVER {_O}"}
PANEL_WINDOWS: dict[str, Template] = _lags | {
    "rank": lambda x: _RANK.format(x=x), "scale": lambda x: f"{x} / nullif(sum(abs({x})) OVER (PARTITION BY date), 0)", "mean": _over("avg", _mean), "total": _over("sum", _mean), "least": _over("min", _mean), "most": _over("max", _mean), "std": _over("stddev_pop", _third),
    "corr": lambda x, y, n: _gate(_corr(x, y, n), _both(x, y)[0], n, _pair(n)), "cov": lambda x, y, n: _gate(f"covar_samp({x}, {y}) OVER {_w(n)}", _both(x, y)[0], n, _pair(n)), "place": _panel_place,
    "argmax": lambda x, n: _gate(f"{n - 1} - {_extreme('arg_max', '-')(x, n)}", x, n, _half(n)), "argmin": lambda x, n: _gate(f"{n - 1} - {_extreme('arg_min', '')(x, n)}", x, n, _half(n)),
    "fade": lambda x, n: _gate(f"(sum({x} * i) OVER {_w(n)} + ({n} - i) * sum({x}) OVER {_w(n)}) / (least(i + 1, {n}) * {n} - least(i + 1, {n}) * (least(i + 1, {n}) - 1) / 2.0)", x, n, _half(n)), "product": _over("product", _half),
}
PANEL_WINDOWS |= {"corr0": PANEL_WINDOWS["corr"], "level": PANEL_WINDOWS["mean"], "year": PANEL_WINDOWS["total"]}

_ALL = "(PARTITION BY instrument)"
_whole = lambda sql, x, n: f"CASE WHEN count({x}) OVER {_w(n)} = count(*) OVER {_w(n)} THEN {sql} END"
_unknown = lambda x, n, other: f"coalesce(min(CASE WHEN {x} IS NULL THEN i END) OVER {_w(n)} - greatest(i - {n - 1}, 0), {other})"
TICKER_WINDOWS: dict[str, Template] = _lags | {
    "rank": lambda x: [f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY instrument, {x} IS NULL ORDER BY {x}) + (count(*) OVER (PARTITION BY instrument, {x}) - 1) / 2.0 END", f"({{0}} - 1) / nullif(max({{0}}) OVER {_ALL} - 1, 0)"],
    "scale": lambda x: f"({x} - avg({x}) OVER {_ALL}) / nullif(stddev_pop({x}) OVER {_ALL}, 0)", "mean": _over("avg"), "total": _over("sum"), "least": _over("min"), "most": _over("max"), "std": _over("stddev_pop"), "corr": _corr, "corr0": lambda x, y, n: f"coalesce({_corr(x, y, n)}, 0.0)",
    "cov": lambda x, y, n: f"covar_samp({x}, {y}) OVER {_w(n)}", "place": lambda x, n: f"CASE WHEN count({x}) OVER {_w(n)} = {n} THEN len(list_filter(list({x}) OVER {_w(n)}, lambda v: v < {x})) + 1.0 END",
    "argmax": lambda x, n: _unknown(x, n, _extreme("arg_max", "-")(x, n)), "argmin": lambda x, n: _unknown(x, n, _extreme("arg_min", "")(x, n)),
    "fade": lambda x, n: _whole(f"(sum({x} * i) OVER {_w(n)} - (i - least(i + 1, {n})) * sum({x}) OVER {_w(n)}) / least(i + 1, {n})", x, n), "product": lambda x, n: _whole(f"product({x}) OVER {_w(n)}", x, n), "level": lambda x, n: f"sum({x}) OVER {_w(n)} / {n}", "year": _over("avg"),
}


def formula_sql(base: str, fields: list[str], outputs: Mapping[str, Cell], row: Mapping[str, Template], windows: Mapping[str, Template], digits: int = 6) -> str:
    """SQL of the outputs over the table `g` (date, instrument, i, fields) of the clauses `base`: every level of windows is a table over the last."""
    levels: dict[str, int] = {}
    calls: dict[int, dict[str, Cell]] = {}

    def level(c: Cell) -> int:
        if c.text not in levels:
            below = max((level(a) for a in c.args if isinstance(a, Cell)), default=0)
            levels[c.text] = below + (c.kind is not None)
            if c.kind is not None:
                calls.setdefault(below + 1, {})[c.text] = c
        return levels[c.text]

    def said(c: Cell | float) -> str:
        if not isinstance(c, Cell):
            return repr(float(c))
        if c.kind is not None:
            return f"q{c.number}"
        return row[c.name](*map(said, c.args)) if c.args else c.name

    for c in outputs.values():
        level(c)
    steps = [f"s0 AS (SELECT date, instrument, i, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in fields)} FROM g)"]
    last = "s0"
    for k in sorted(calls):
        args = {a.text: a for c in calls[k].values() for a in c.args if isinstance(a, Cell)}
        names = {t: f"a{k}_{j}" if a.kind is None and a.args else said(a) for j, (t, a) in enumerate(args.items())}
        plain = [f"{said(a)} AS {names[t]}" for t, a in args.items() if a.kind is None and a.args]
        parts = {t: windows[c.name](*[names[a.text] if isinstance(a, Cell) else a for a in c.args]) for t, c in calls[k].items()}
        first = [f"CAST({p[0]} AS DOUBLE) AS h{calls[k][t].number}" for t, p in parts.items() if isinstance(p, list)]
        final = [f"CAST({p if isinstance(p, str) else p[1].format(f'h{calls[k][t].number}')} AS DOUBLE) AS q{calls[k][t].number}" for t, p in parts.items()]
        for n, columns in (("r", plain), ("h", first), ("s", final)):
            if columns:
                steps.append(f"{n}{k} AS (SELECT *, {', '.join(columns)} FROM {last})")
                last = f"{n}{k}"
    cells = ", ".join(f"round({said(c)}, {digits}) + 0.0 AS {n}" for n, c in outputs.items())
    return f"{base}, {', '.join(steps)} SELECT date, instrument, {cells} FROM {last}"
