"""Every panel query against its SQL on DuckDB, and what SQL can't express against pandas."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

from factorloom.plans import queries
from factorloom.streaming import bars

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem", "events", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        frame[c] = pd.to_datetime(frame[c]) if c == "date" else frame[c]
    return frame.sort_values([c for c in ("date", "instrument", "query_id", "place") if c in frame]).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = ordered(queries.QUERIES[name](spark, SF).toPandas()), ordered(duck.sql(queries.ORACLE_SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_against_pandas(spark):
    dense = queries.panels.densify(queries.panels.supplier_panel(spark, SF)).toPandas()
    own = dense.sort_values(["instrument", "date"]).groupby("instrument")
    moments = queries.QUERIES["d1_moments"](spark, SF).toPandas().sort_values(["instrument", "date"]).reset_index(drop=True)
    for k, f in (("skew", lambda s: s.rolling(8, min_periods=5).skew()), ("kurt", lambda s: s.rolling(8, min_periods=5).kurt())):
        np.testing.assert_allclose(moments[k].to_numpy(float), own["volume"].transform(f).to_numpy(), atol=1e-5)
    decay = queries.QUERIES["d1_ts_decay"](spark, SF).toPandas().sort_values(["instrument", "date"])["decay"].to_numpy(float)
    np.testing.assert_allclose(decay, own["close"].transform(lambda s: s.ewm(span=5, adjust=False, min_periods=3).mean()).to_numpy(), rtol=1e-6)


def test_backtest_is_the_sequential_one(spark):
    prices = queries.panels.densify(queries.panels.brand_panel(spark, SF)).select("date", "instrument", "close")
    targets = queries._targets(spark, SF)
    p, t = (x.toPandas().pivot(index="date", columns="instrument", values=v) for x, v in ((prices, "close"), (targets, "weight")))
    t, nav, want, w = t.reindex(index=p.index, columns=p.columns).fillna(0.0), 1.0, [], None
    for i in range(len(p)):
        ratio = (p.iloc[i] / p.iloc[i - 1]).fillna(0.0) if i else None
        drifted = w if w is None else (w * ratio / (w * ratio).sum() if (w * ratio).sum() else w * 0)
        moved = 0.0
        if i % 3 == 0:
            w = t.iloc[i]
            moved = 0.0 if drifted is None else float((w - drifted).abs().sum()) / 2
        else:
            w = drifted
        gross = float((w * ((p.iloc[i + 1] / p.iloc[i]) - 1).fillna(0.0)).sum()) if i + 1 < len(p) else 0.0
        r = (1 - moved * 0.001) * (1 + gross) - 1
        nav *= 1 + r
        want.append((r, nav, moved))
    got = queries.portfolio.backtest(prices, targets, 3, 0.001).orderBy("date").select("ret", "nav", "turnover").toPandas()
    np.testing.assert_allclose(got.to_numpy(float), np.array(want), atol=1e-9)


def test_stream_gives_the_batch_bars(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    out = bars.daily_bars(bars.event_stream(spark, SF, batch.schema))
    q = out.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    got, want = spark.table("daily").toPandas(), bars.daily_bars(batch).toPandas()
    pd.testing.assert_frame_equal(ordered(got), ordered(want), rtol=1e-9)
