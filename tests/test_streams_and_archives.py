"""Streams against tables, archives that are updated, and the recursive mean."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import numeric
from factorloom.sources import files
from factorloom.streaming import running
from tests.test_queries import spark  # noqa: F401

KIND = "event_id long, user_id long, ts timestamp, value double"


@pytest.fixture
def rocks(spark):  # noqa: F811
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", running.ROCKSDB)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def events(n=120, users=4):
    rng = np.random.default_rng(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, int(rng.integers(users)), start + dt.timedelta(minutes=float(rng.integers(0, 60 * 24 * 6))), float(np.round(rng.normal(), 3))) for i in range(n)]
    return rows + [(n, 0, start + dt.timedelta(days=50), 1.0), (n + 1, 0, start + dt.timedelta(days=50), 2.0)]


def folded(df):
    return {(r[0], r[1]): tuple(round(x, 9) if isinstance(x, float) else x for x in r[2:]) for r in df.collect()}


def streamed(spark, build, parts, folder, name):
    """What the stream gives over parts that arrive one after the other, stopped and begun again from its checkpoint in between."""
    for k, part in enumerate(parts):
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        source = spark.readStream.schema(KIND).parquet(f"{folder}/in")
        build(source).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/{name}")


def shuffled_parts(rows):
    """Three parts: the second half first within what the watermark of ten days allows, then a far event that lets it pass all."""
    rng = np.random.default_rng(1)
    early = [r for r in rows if r[2] < dt.datetime(2024, 2, 1)]
    order = rng.permutation(len(early))
    half = len(early) // 2
    return [[early[i] for i in order[:half]], [early[i] for i in order[half:]], rows[len(early) :], [(10_000, 9, dt.datetime(2024, 6, 1), 0.0)]]


def test_running_means_of_a_late_stream_are_the_tables(rocks, tmp_path):
    rows = events()
    want = folded(running.running_means(rocks.createDataFrame(rows, KIND), forget_days=20).select("instrument", "event_id", "ts", "mean"))
    got = folded(streamed(rocks, lambda s: running.running_means(s, lateness="10 days", forget_days=20), shuffled_parts(rows), str(tmp_path), "means").filter("instrument != '9'").select("instrument", "event_id", "ts", "mean"))
    assert got == want and len(got) == len(rows)
    assert want["0", 120][1] == 1.0  # forgotten before


def test_session_bars_of_a_late_stream_are_the_tables(rocks, tmp_path):
    rows = events()
    build = lambda e: running.session_bars(e, "3 hours", "10 days")
    want = folded(build(rocks.createDataFrame(rows, KIND)).select("instrument", "start", "open", "high", "low", "close", "volume", "amount"))
    got = folded(streamed(rocks, build, shuffled_parts(rows), str(tmp_path), "bars").filter("instrument != '9'").select("instrument", "start", "open", "high", "low", "close", "volume", "amount"))
    assert got == want and len(got) > 20


def test_batch_means_by_hand(spark):  # noqa: F811
    rows = [(1, 1, dt.datetime(2024, 1, 1), 4.0), (1, 1, dt.datetime(2024, 1, 1), 4.0), (3, 1, dt.datetime(2024, 1, 2), 8.0), (2, 1, dt.datetime(2024, 1, 2), 6.0), (4, None, dt.datetime(2024, 1, 2), 6.0), (5, 2, None, 6.0), (6, 2, dt.datetime(2024, 1, 1), None)]
    got = running.running_means(spark.createDataFrame(rows, KIND), alpha=0.5).orderBy("ts", "event_id").collect()
    assert [(r.event_id, r.mean) for r in got] == [(1, 4.0), (2, 5.0), (3, 6.5)]


def test_archive_updates(spark, tmp_path):  # noqa: F811
    path = f"{tmp_path}/archive"
    kind = "date date, instrument string, close double, volume long"
    day = lambda m, d: dt.date(2024, m, d)
    first = [(day(m, d), i, float(m * d), d) for m in (1, 2, 3) for d in (1, 2) for i in ("a", "b")] + [(None, "a", 1.0, 1)]
    second = [(day(2, 2), "a", -1.0, 0), (day(2, 3), "c", 5.0, 5), (day(4, 1), "a", 6.0, 6), (day(4, 1), "a", 7.0, 1)]
    held = lambda: sorted((r.date, r.instrument, r.close, r.volume) for r in spark.read.parquet(path).collect())
    files.update_archive(spark.createDataFrame(first, kind), path)
    untouched = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "archive" / "month=2024-01").glob("*.parquet")}
    files.update_archive(spark.createDataFrame(second, kind), path)
    whole = {r[:2]: r for r in first + second if r[0]}
    want = sorted(whole.values() if (day(4, 1), "a") not in whole else [*[r for k, r in whole.items() if k != (day(4, 1), "a")], (day(4, 1), "a", 7.0, 1)])
    assert held() == want
    files.update_archive(spark.createDataFrame(second, kind), path)
    assert held() == want
    assert untouched == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "archive" / "month=2024-01").glob("*.parquet")}
    files.update_archive(spark.createDataFrame([(day(5, 1), "a", 1.5)], "date date, instrument string, close double"), path)
    assert held()[-1] == (day(5, 1), "a", 1.5, None) and len(held()) == len(want) + 1
    files.update_archive(spark.createDataFrame([], kind), path)
    assert len(held()) == len(want) + 1


@pytest.mark.parametrize("n", [1, 3, 5])
def test_recursive_mean(spark, n):  # noqa: F811
    rng = np.random.default_rng(5)
    x = pd.DataFrame(rng.normal(size=(40, 3)), columns=["a", "b", "c"])
    x = x.mask(rng.random(x.shape) < 0.3)
    x.loc[:6, "c"] = np.nan
    frame = spark.createDataFrame([(i, c, None if np.isnan(v) else float(v)) for c in x for i, v in enumerate(x[c])], "date int, instrument string, x double")
    got = frame.select("date", "instrument", numeric.ts_ema("x", n).alias("y")).toPandas().pivot(index="date", columns="instrument", values="y")
    alpha = 2 / (n + 1)
    for c in x:
        last, want = np.nan, []
        for t, v in enumerate(x[c]):
            if t == n - 1:
                known = x[c][:n].dropna()
                last = known.mean() if len(known) else np.nan
            elif t >= n:
                last = last if np.isnan(v) else v if np.isnan(last) else alpha * v + (1 - alpha) * last
            want.append(last)
        np.testing.assert_allclose(got[c].to_numpy(float), want, rtol=1e-9, atol=1e-12)
