"""DuckDB SQL for queries of other modules whose rows take more than one step to say."""

from __future__ import annotations

from factorloom.plans import dialects, library, queries, reports
from factorloom.plans.queries import _O, _panel, _w
from factorloom.plans.reports import _CORR, _DATES, _DAY, _LONG, _PAIRED, _SUMMARY, _place

_PAST = "(PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_BEFORE = "(PARTITION BY instrument ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _r(sql: str, name: str) -> str:
    return f"round(CAST({sql} AS DOUBLE), 6) AS {name}"


def _adjusted(x: str, alpha: float) -> str:
    """Mean of the cells so far by weights that fall by 1 - alpha a row; row numbers are i."""
    grown = f"pow({1 / (1 - alpha)!r}, i)"
    return f"(sum({x} * {grown}) OVER {_PAST} / nullif(sum(CASE WHEN {x} IS NOT NULL THEN {grown} END) OVER {_PAST}, 0))"


def _recursive(x: str, alpha: float, source: str) -> tuple[str, str]:
    """A WITH clause k over `source` and an expression over k: (1 - alpha) ** rows of the last mean and alpha of the cell, made to sum to 1."""
    clause = f"k AS (SELECT *, i - max(CASE WHEN {x} IS NOT NULL THEN i END) OVER {_BEFORE} AS gap FROM {source})"
    old = f"pow({1 - alpha!r}, gap)"
    cells = f"list(struct_pack(v := {x}, s := coalesce({old} / ({old} + {alpha!r}), 0.0))) FILTER ({x} IS NOT NULL) OVER {_PAST}"
    return clause, f"list_reduce({cells}, lambda a, b: struct_pack(v := b.s * a.v + (1 - b.s) * b.v, s := b.s)).v"


def _decay() -> str:
    clause, value = _recursive("close", 1 / 3, "g")
    return f"{_panel('supplier')}, {clause} SELECT date, instrument, {_r(f'CASE WHEN count(close) OVER {_PAST} >= 3 THEN {value} END', 'decay')} FROM k"


def _recursions() -> str:
    spans = f"h AS (SELECT *, close - lag(close) OVER {_O} AS change, CASE WHEN high - low IS NOT NULL THEN greatest(high - low, coalesce(high - lag(close) OVER {_O}, 0), coalesce(low - lag(close) OVER {_O}, 0)) END AS span FROM g)"
    clause, value = _recursive("span", 2 / 15, "h")
    up, down = (_adjusted(f"(CASE WHEN change IS NOT NULL THEN greatest({x}, 0) END)", 2 / 15) for x in ("change", "-change"))
    rsi = f"CASE WHEN {down} = 0 AND {up} > 0 THEN 100 ELSE 100 - 100 / (1 + {up} / nullif({down}, 0)) END"
    return f"{_panel('supplier')}, {spans}, {clause} SELECT date, instrument, {_r(rsi, 'rsi')}, {_r(_adjusted('close', 2 / 6), 'sma')}, {_r(value, 'atr')} FROM k"


def _ema_macd_mad() -> str:
    w = _w(5)
    null = f"min(CASE WHEN close IS NULL THEN i END) OVER {w}"
    back = lambda f, s: f"CASE WHEN count(close) OVER {w} > 0 THEN 1 + i - coalesce({null}, {f}(i, CASE WHEN close IS NOT NULL THEN row(close, {s}i) END) OVER {w}) END"
    a, b = "coalesce(close, 0)", "coalesce(volume, 0)"
    regresi = f"CASE WHEN i >= 4 THEN {a} - avg({a}) OVER {w} - covar_pop({a}, {b}) OVER {w} / nullif(var_pop({b}) OVER {w}, 0) * ({b} - avg({b}) OVER {w}) END"
    middle = f"m AS (SELECT *, quantile_cont(close, 0.5) OVER {w} AS mid, list(close) FILTER (close IS NOT NULL) OVER {w} AS cells FROM g)"
    return f"""{_panel('supplier')}, {middle} SELECT date, instrument, {_r(_adjusted('close', 2 / 6), 'ema')}, {_r(f"{_adjusted('close', 2 / 13)} - {_adjusted('close', 2 / 27)}", 'macd')},
        {_r("list_median(list_transform(cells, lambda v: abs(v - mid)))", 'mad')}, {_r(back('arg_max', '-'), 'highday')}, {_r(back('arg_min', ''), 'lowday')}, {_r(regresi, 'regresi')} FROM m"""


def _moments() -> str:
    w, flat = _w(8), f"min(volume) OVER {_w(8)} = max(volume) OVER {_w(8)}"
    cell = lambda f, least: f"CASE WHEN count(volume) OVER {w} < {least} THEN NULL WHEN {flat} THEN {-3.0 if f == 'kurtosis' else 0.0} ELSE {f}(volume) OVER {w} END"
    return f"{_panel('supplier')} SELECT date, instrument, {_r(cell('skewness', 5), 'skew')}, {_r(cell('kurtosis', 5), 'kurt')} FROM g"


def _full_moments() -> str:
    w, five = _w(6), _w(5)
    known = lambda sql: f"CASE WHEN count(volume) OVER {w} = 6 AND min(volume) OVER {w} < max(volume) OVER {w} THEN {sql} END"
    skew, kurt = known(f"skewness(volume) OVER {w} * 4 / sqrt(30)"), known(f"(kurtosis_pop(volume) OVER {w} + 3) * 25 / 36 - 3")
    dev = lambda x: f"greatest(stddev_pop({x}) OVER {five}, 1e-8)"
    warm = lambda sql: f"CASE WHEN i >= 4 THEN {sql} END"
    middle = f"m AS (SELECT *, quantile_cont(volume, 0.5) OVER {five} AS mid, list(volume) FILTER (volume IS NOT NULL) OVER {five} AS cells FROM g)"
    return f"""{_panel('supplier')}, {middle} SELECT date, instrument, {_r(skew, 'skew')}, {_r(kurt, 'kurt')}, {_r(warm("list_median(list_transform(cells, lambda v: abs(v - mid)))"), 'mad')},
        {_r(warm(f"covar_pop(open, volume) OVER {five} / ({dev('open')} * {dev('volume')})"), 'floored_corr')}, {_r(warm(f"avg(volume) OVER {five} / {dev('volume')}"), 'floored_ir')} FROM m"""


def _sampled_moments() -> str:
    cells = f"m AS (SELECT *, avg(volume) OVER {_w(8)} AS mean, list(volume) FILTER (volume IS NOT NULL) OVER {_w(8)} AS cells FROM g)"
    head, body = _moments().split(" SELECT date, instrument, ", 1)
    return f"{head}, {cells} SELECT date, instrument, {_r('CASE WHEN len(cells) >= 4 THEN list_sum(list_transform(cells, lambda v: abs(v - mean))) / len(cells) END', 'mad')}, {body.removesuffix('g')}m"


_TARGETS = queries.ORACLE_SQL["top_weights"].rsplit(" SELECT date, instrument, round(w", 1)[0] + ", t AS (SELECT date, instrument, w / sum(w) OVER (PARTITION BY date) AS w FROM y)"


def _features() -> str:
    names, day = list(library._RAW), "OVER (PARTITION BY date)"
    each = lambda f: ", ".join(f(k) for k in names)
    raw = f"x0 AS (SELECT date, instrument, {', '.join(f'CAST({s} AS DOUBLE) AS {k}' for k, s in library._RAW.items())} FROM b)"
    mid = f"x1 AS (SELECT *, {each(lambda k: f'quantile_cont({k}, 0.5) {day} AS m_{k}')} FROM x0)"
    width = f"x2 AS (SELECT *, {each(lambda k: f'3 * 1.4826 * quantile_cont(abs({k} - m_{k}), 0.5) {day} AS w_{k}')} FROM x1)"
    cut = f"x3 AS (SELECT date, instrument, {each(lambda k: f'CASE WHEN {k} IS NOT NULL THEN greatest(m_{k} - w_{k}, least(m_{k} + w_{k}, {k})) END AS {k}')} FROM x2)"
    return f"{library._FILLED}, {raw}, {mid}, {width}, {cut} SELECT date, instrument, {each(lambda k: f'round(({k} - avg({k}) {day}) / (stddev_samp({k}) {day} + 1e-10), 6) AS {k}')} FROM x3"


def _by_day(x: str) -> str:
    return f"coalesce(({x} - avg({x}) OVER d) / nullif(stddev_pop({x}) OVER d, 0), 0)"


_REGIONS = "JOIN supplier ON instrument = CAST(s_suppkey AS VARCHAR) JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_SHRUNK = f"""{_SUMMARY}, sizes AS (SELECT factor, mean_ic, abs(icir) AS size, count(*) OVER () AS n, min(greatest(2, days)) OVER () AS rounds FROM s),
    drawn AS (SELECT *, greatest(0.05, least(0.5, 1 / (1 + greatest(0, var_pop(size) OVER () * rounds - 1)))) AS draw, size * size / (sum(size * size) OVER () + 1e-12) AS share FROM sizes),
    mixed AS (SELECT *, (1 - draw) * share + draw / n AS w FROM drawn),
    shrunk AS (SELECT factor, CASE WHEN sum(size) OVER () < 1e-8 THEN 1.0 / n ELSE w / (sum(w) OVER () + 1e-12) END AS weight, CASE WHEN abs(mean_ic) <= 1e-10 THEN 1.0 ELSE CAST(sign(mean_ic) AS DOUBLE) END AS sign FROM mixed)"""


def _factor_report() -> str:
    of = reports.ORACLE_SQL
    share = "1 - count(*) FILTER (a AND b) / count(*) FILTER (a OR b)"
    turnover = of["top_turnover"].replace(f"round({share}, 6)", share)
    return f"""SELECT * FROM ({of['ic_summaries']}) LEFT JOIN (SELECT * EXCLUDE (days) FROM ({of['spread_stats']})) USING (factor) LEFT JOIN ({of['monotonicity']}) USING (factor)
        LEFT JOIN (SELECT factor, round(avg(turnover), 6) AS turnover FROM ({turnover}) GROUP BY factor) USING (factor)"""


def _overfitting(split: str = "DATE '1996-01-01'") -> str:
    few = "n_in < 50 OR n_out < 50"
    return f"""{_PAIRED.format(least=3)}, n AS (SELECT factor, count(*) FILTER (date < {split}) AS n_in, count(*) FILTER (date >= {split}) AS n_out FROM x GROUP BY factor),
        side AS (SELECT factor, date < {split} AS early, avg(spearman) AS ic, CASE WHEN count(*) < 20 THEN 0 ELSE avg(spearman) / nullif(stddev_pop(spearman), 0) END AS icir FROM ic WHERE spearman IS NOT NULL GROUP BY ALL),
        j AS (SELECT n.*, coalesce(e.ic, 0) AS a, coalesce(l.ic, 0) AS b, coalesce(e.icir, 0) AS c, coalesce(l.icir, 0) AS d FROM n LEFT JOIN side e ON e.factor = n.factor AND e.early LEFT JOIN side l ON l.factor = n.factor AND NOT l.early),
        r AS (SELECT *, CASE WHEN a * b > 0 THEN least(1.5, abs(b) / nullif(abs(a), 0)) ELSE -0.5 END AS ratio FROM j)
        SELECT factor, round(CASE WHEN {few} THEN 0.5 WHEN abs(a) <= 0.001 THEN CASE WHEN abs(b) <= 0.001 THEN 0.5 ELSE 0.3 END WHEN ratio > 1 THEN 0.8 + 0.1 * least(ratio - 1, 0.5) WHEN ratio > 0.8 THEN 0.7 + 0.3 * (ratio - 0.8) / 0.2
            WHEN ratio > 0.5 THEN 0.4 + 0.3 * (ratio - 0.5) / 0.3 WHEN ratio > 0 THEN 0.2 + 0.2 * ratio / 0.5 ELSE 0.1 END, 6) AS overfitting,
            round(CASE WHEN {few} THEN 1.0 WHEN abs(c) < 0.1 THEN CASE WHEN abs(d) < 0.1 THEN 1.0 ELSE 0.5 END ELSE d / nullif(c, 0) END, 6) AS decay FROM r"""


def _five_scores() -> str:
    return f"""{_SUMMARY.replace('>= 10', '>= 3')}, {_DATES}, pl AS (SELECT factor, date, instrument, i, ({_place('value')}) / count(value) OVER {_DAY} AS r FROM x JOIN dates USING (factor, date)),
        moved AS (SELECT a.factor, a.date, avg(abs(a.r - b.r)) AS d FROM pl a JOIN pl b ON a.factor = b.factor AND a.instrument = b.instrument AND a.i = b.i + 1 WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY a.factor, a.date HAVING count(*) >= 3),
        steady AS (SELECT factor, 1 - avg(d) AS turnover FROM moved GROUP BY factor)
        SELECT factor, round(mean_ic, 6) AS effectiveness, round(icir, 6) AS stability, round(turnover, 6) AS turnover, coalesce(diversity, 1) AS diversity, overfitting FROM s LEFT JOIN steady USING (factor) LEFT JOIN ({reports.ORACLE_SQL['diversity']}) USING (factor)
            LEFT JOIN ({_overfitting()}) USING (factor) WHERE factor IN (SELECT factor FROM known GROUP BY factor HAVING count(*) >= 100)"""


def _composite() -> str:
    """The standard scores of mad_scores before rounding, mixed by weights that fall with the place of a factor's name."""
    steps, value = reports.ORACLE_SQL["mad_scores"].removeprefix(_LONG).rsplit("SELECT factor, date, instrument, round(", 1)
    scores = f"z AS (SELECT factor, date, instrument, {value.removesuffix(', 6) AS value FROM c')} AS value FROM c)"
    return f"""{_SUMMARY}{steps}, {scores}, raw AS (SELECT factor, exp(-0.3 * (row_number() OVER (ORDER BY factor) - 1)) AS raw, CASE WHEN abs(mean_ic) <= 1e-10 THEN 1.0 ELSE CAST(sign(mean_ic) AS DOUBLE) END AS sign FROM s),
        w AS (SELECT factor, sign * raw / sum(raw) OVER () AS w FROM raw), sc AS (SELECT date, instrument, sum(w * value) AS score FROM z JOIN w USING (factor) GROUP BY ALL)
        SELECT date, instrument, round(CASE WHEN count(score) OVER d < 5 THEN score ELSE (score - avg(score) OVER d) / (stddev_samp(score) OVER d + 1e-8) END, 6) + 0 AS score FROM sc WINDOW d AS (PARTITION BY date)"""


def _performance() -> str:
    head, body = library.ORACLE_SQL["held_returns"].rsplit(" SELECT w.date, round(", 1)
    ret = body.replace(", 6) AS ret", " AS ret", 1)
    return f"""{head.rstrip()}, hr AS (SELECT w.date, {ret}), v AS (SELECT *, product(1 + ret) OVER (ORDER BY date) AS nav FROM hr), dn AS (SELECT *, nav / max(nav) OVER (ORDER BY date) - 1 AS down FROM v),
        f AS (SELECT count(*) AS n, arg_max(nav, date) AS nav, stddev_samp(ret) * sqrt(12) AS vol, abs(min(down)) AS dd, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win FROM dn),
        old AS (SELECT d.next AS date, instrument, w AS was FROM w JOIN d USING (date) WHERE d.next IS NOT NULL), new AS (SELECT * FROM w WHERE date IN (SELECT next FROM d)),
        mv AS (SELECT coalesce(new.date, old.date) AS date, new.w, was FROM new FULL JOIN old ON new.date = old.date AND new.instrument = old.instrument),
        t AS (SELECT date, CASE WHEN count(CASE WHEN was IS NOT NULL THEN w END) = 0 THEN 1 ELSE sum(abs(coalesce(w, 0) - coalesce(was, 0))) / 2 END AS t FROM mv GROUP BY date),
        a AS (SELECT *, pow(nav, 12.0 / n) - 1 AS annual, (SELECT sum(t) FROM t) AS moved, (SELECT count(DISTINCT date) FROM w) AS n_portfolios FROM f)
        SELECT round(nav - 1, 4) AS total_return, round(annual, 4) AS annual_return, round(vol, 4) AS volatility, round(coalesce(annual / nullif(vol, 0), 0), 4) AS sharpe, round(dd, 4) AS max_drawdown, round(coalesce(annual / nullif(dd, 0), 0), 4) AS calmar,
            round(win, 4) AS win_rate, round(coalesce(moved / nullif(n_portfolios, 0), 0), 4) AS avg_turnover, n AS n_periods, n_portfolios FROM a"""


_MASKED = "covar_pop({a}, {b}) / CASE WHEN stddev_pop({a}) < 1e-3 OR stddev_pop({b}) < 1e-3 THEN 1 ELSE stddev_pop({a}) * stddev_pop({b}) END"

ORACLE_SQL: dict[str, str] = {
    "d1_moments": _moments(),
    "d1_ts_decay": _decay(),
    "d3_moments": _full_moments(),
    "d4_moments": _sampled_moments(),
    "d2_ema_macd_mad": _ema_macd_mad(),
    "d2_recursions": _recursions(),
    "technical_features": _features(),
    "return_correlation": f"""{_panel('brand')}, f AS (SELECT date, instrument, last_value(close IGNORE NULLS) OVER {_PAST} AS c FROM g), r AS (SELECT date, instrument, coalesce(c / nullif(lag(c) OVER {_O}, 0) - 1, 0) AS r FROM f),
        pr AS (SELECT covar_pop(a.r, b.r) / nullif(stddev_pop(a.r) * stddev_pop(b.r), 0) AS c FROM r a JOIN r b ON a.date = b.date AND a.instrument < b.instrument GROUP BY a.instrument, b.instrument) SELECT round(avg(c), 6) AS correlation FROM pr""",
    "weight_turnover": f"""{_TARGETS}, d AS (SELECT date, lead(date) OVER (ORDER BY date) AS next FROM (SELECT DISTINCT date FROM t)), old AS (SELECT next AS date, instrument, w AS was FROM t JOIN d USING (date) WHERE next IS NOT NULL),
        new AS (SELECT * FROM t WHERE date IN (SELECT next FROM d)), moved AS (SELECT coalesce(new.date, old.date) AS date, w, was FROM new FULL JOIN old ON new.date = old.date AND new.instrument = old.instrument)
        SELECT date, round(CASE WHEN count(CASE WHEN was IS NOT NULL THEN w END) = 0 THEN 1 ELSE sum(abs(coalesce(w, 0) - coalesce(was, 0))) / 2 END, 6) AS turnover FROM moved GROUP BY date""",
    "weights_on_grid": f"""{_TARGETS}, s AS (SELECT g.date, g.instrument, CASE WHEN g.date IN (SELECT date FROM t) THEN coalesce(t.w, 0) END AS w FROM g LEFT JOIN t ON g.date = t.date AND g.instrument = t.instrument),
        f AS (SELECT date, instrument, round(coalesce(last_value(w IGNORE NULLS) OVER {_PAST}, 0), 6) AS weight FROM s) SELECT * FROM f WHERE date >= DATE '1995-01-01'""",
    "industry_size_residuals": f"""{_panel('supplier')}, k AS (SELECT date, instrument, close AS v, ln(greatest(amount, 1e-10)) AS s, r_name AS ind FROM p {_REGIONS}),
        c AS (SELECT *, v - avg(v) OVER (PARTITION BY date, ind) AS y, s - avg(s) OVER (PARTITION BY date, ind) AS x, count(*) OVER (PARTITION BY date) AS n FROM k)
        SELECT date, instrument, round(CASE WHEN n < 20 THEN v ELSE y - coalesce(sum(x * y) OVER d / nullif(sum(x * x) OVER d, 0), 0) * x END, 4) + 0 AS value FROM c WINDOW d AS (PARTITION BY date)""",
    "shrunk_weights": f"{_SHRUNK} SELECT factor, round(weight, 6) AS weight, sign FROM shrunk",
    "penalised_weights": f"""{_SHRUNK}, r AS (SELECT factor, date, instrument, ({_place('value')}) / count(value) OVER {_DAY} AS r FROM x WHERE value IS NOT NULL),
        pp AS (SELECT a.factor AS a, b.factor AS b, CASE WHEN count(*) >= 100 THEN coalesce(abs({_CORR.format(a='a.r', b='b.r')}), 0) ELSE 0 END AS rho FROM r a JOIN r b ON a.date = b.date AND a.instrument = b.instrument AND a.factor < b.factor GROUP BY a.factor, b.factor),
        e AS (SELECT en.factor, sum(rho * weight) AS e FROM (SELECT a AS factor, b AS other, rho FROM pp UNION ALL SELECT b, a, rho FROM pp) en JOIN shrunk ON shrunk.factor = en.other GROUP BY en.factor),
        cut AS (SELECT factor, sign, weight / (1 + coalesce(e, 0) / CASE WHEN 1 - weight < 1e-10 THEN 1 ELSE 1 - weight END) AS w FROM shrunk LEFT JOIN e USING (factor))
        SELECT factor, round(w / sum(w) OVER (), 6) AS weight, sign FROM cut""",
    "factor_report": _factor_report(),
    "overfitting": _overfitting(),
    "five_scores": _five_scores(),
    "composite_scores": _composite(),
    "simple_performance": _performance(),
    "risk_managed": f"""{_panel('supplier')}, b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY date ORDER BY volume DESC, instrument) <= 20),
        r AS (SELECT *, volume - min(volume) OVER (PARTITION BY date) + 1e-6 AS raw FROM b), w AS (SELECT *, raw / sum(raw) OVER (PARTITION BY date) AS w, quantile_cont(amount, 0.1) OVER (PARTITION BY date) AS edge FROM r),
        m AS (SELECT date, instrument, least(w, 0.15) AS w FROM w WHERE amount >= edge AND high <> low AND w >= 0.01), k AS (SELECT date, instrument, r_name, w / sum(w) OVER (PARTITION BY date) AS w FROM m {_REGIONS}),
        c AS (SELECT date, instrument, w * least(1.0, 0.3 / sum(w) OVER (PARTITION BY date, r_name)) AS w FROM k) SELECT date, instrument, round(w / sum(w) OVER (PARTITION BY date), 6) AS weight FROM c""",
    "normalised_ic": f"""{_LONG}, n AS (SELECT factor, date, instrument, {_by_day('value')} AS v, {_by_day('target')} AS t FROM x WINDOW d AS (PARTITION BY factor, date)), rk AS (SELECT *, {_place('v')} AS rv, {_place('t')} AS rt FROM n),
        c AS (SELECT factor, date, coalesce({_MASKED.format(a='v', b='t')}, 0) AS ic, coalesce({_MASKED.format(a='rv', b='rt')}, 0) AS rank_ic FROM rk GROUP BY factor, date)
        SELECT factor, count(*) AS days, round(avg(ic), 6) AS ic, round(avg(rank_ic), 6) AS rank_ic, round(avg(rank_ic) / nullif(stddev_samp(rank_ic), 0), 6) AS rank_icir FROM c GROUP BY factor""",
}
#: The queries that these are the SQL of.
QUERIES = {k: {**queries.QUERIES, **dialects.QUERIES, **reports.QUERIES, **library.QUERIES}[k] for k in ORACLE_SQL}
