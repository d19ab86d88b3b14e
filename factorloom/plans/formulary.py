"""Queries over the formula libraries of both namespaces, with SQL for the formulas that two engines agree on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.functions import alphas, formulas
from factorloom.plans import formula_sql as sql
from factorloom.plans.library import alpha_panel
from factorloom.plans.queries import _O, _panel

FIELDS = ["open", "high", "low", "close", "volume", "vwap", "returns"]
DIGITS = 8

#: Formulas that rank, compare or divide values which are equal but for rounding; engines that add in other orders part there.
_PANEL_TIES = {f"alpha{k:03d}" for k in (13, 15, 16, 17, 29, 31, 43, 45, 85, 88, 94, 96, 98)}
_TICKER_TIES = {f"alpha{k:03d}" for k in (13, 15, 16, 18, 19, 29, 31, 36, 37, 45, 50, 52, 53, 54, 71, 75, 78, 81, 84, 85, 88, 94, 96)}

PANEL_CORE = {k: f for k, f in alphas.PANEL_ALPHAS.items() if k not in _PANEL_TIES}
TICKER_CORE = {k: f for k, f in alphas.TICKER_ALPHAS.items() if k not in _TICKER_TIES}
#: Formulas of short reach, and the first date that the query of recent dates returns.
RECENT = {k: alphas.PANEL_ALPHAS[k] for k in ("alpha003", "alpha006", "alpha012", "alpha025", "alpha033", "alpha041", "alpha053", "alpha097", "alpha101")}
SINCE = dt.date(1998, 1, 1)


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alpha_panel(spark, sf_dir).select("date", "instrument", *FIELDS)


def _round(df: DataFrame) -> DataFrame:
    return df.select("date", "instrument", *[(F.round(c, DIGITS) + 0.0).alias(c) for c in df.columns[2:]])


def alpha_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formulas over dates that have SQL."""
    return _round(formulas.exposures(_fields(spark, sf_dir), PANEL_CORE, alphas.PANEL_DIALECT))


def ticker_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 82 formulas over an instrument's history."""
    return _round(formulas.exposures(_fields(spark, sf_dir), alphas.TICKER_ALPHAS, alphas.TICKER_DIALECT))


def ticker_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of them that have SQL."""
    return _round(formulas.exposures(_fields(spark, sf_dir), TICKER_CORE, alphas.TICKER_DIALECT))


def recent_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas for the dates from SINCE on, computed from the dates within their reach alone."""
    return _round(formulas.exposures(_fields(spark, sf_dir), RECENT, alphas.PANEL_DIALECT, SINCE))


QUERIES = {f.__name__: f for f in (alpha_core, ticker_library, ticker_core, recent_formulas)}

_BASE = _panel("brand").replace("g AS (SELECT d.date", "dense AS (SELECT d.date") + f""",
    filled AS (SELECT *, last_value(close IGNORE NULLS) OVER {_O} AS last_close FROM dense),
    g AS (SELECT *, last_close / nullif(lag(last_close) OVER {_O}, 0) - 1 AS returns, amount / nullif(volume, 0) AS vwap FROM filled)"""


def _sql(book: dict[str, formulas.Formula], dialect: formulas.Dialect, row: dict, windows: dict) -> str:
    sheet = formulas.Sheet(FIELDS, dialect)
    return sql.formula_sql(_BASE, FIELDS, {k: f(sheet) for k, f in book.items()}, row, windows, DIGITS)


ORACLE_SQL: dict[str, str] = {
    "alpha_core": _sql(PANEL_CORE, alphas.PANEL_DIALECT, sql.PANEL_ROW, sql.PANEL_WINDOWS),
    "ticker_core": _sql(TICKER_CORE, alphas.TICKER_DIALECT, sql.TICKER_ROW, sql.TICKER_WINDOWS),
    "recent_formulas": f"SELECT * FROM ({_sql(RECENT, alphas.PANEL_DIALECT, sql.PANEL_ROW, sql.PANEL_WINDOWS)}) WHERE date >= DATE '{SINCE}'",
}
