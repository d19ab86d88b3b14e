"""Reading and writing of panels, factors and results as files of Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorloom.operators.selection import finite
from factorloom.sources.panels import by_instrument, drop_idle_dates, forward_fill
from factorloom.sources.stages import Stages

#: Names under which a net asset value may stand, the best first.
NAV_NAMES = ("portfolio_value", "value", "nav", "net_value")


def archive_path(top: str, universe: str, start: str, end: str) -> str:
    return f"{top.rstrip('/')}/{universe}_{start}_{end}"


def write_archive(panel: DataFrame, top: str, universe: str, start: str, end: str, force: bool = False) -> str:
    """The panel without idle dates, as Parquet under the name of its universe and span; kept if it is there, unless `force`."""
    path = archive_path(top, universe, start, end)
    drop_idle_dates(panel).write.mode("overwrite" if force else "ignore").parquet(path)
    return path


def read_archive(spark: SparkSession, top: str, universe: str, start: str, end: str) -> DataFrame:
    """The archive of exactly that universe and span; its absence is Spark's error for a missing path."""
    return spark.read.parquet(archive_path(top, universe, start, end))


def update_archive(panel: DataFrame, path: str) -> None:
    """Brings rows (date, instrument, fields) into an archive that is stored by month, which is made where it lacks.

    Of a date and instrument the new row replaces the old one; rows that stand twice
    in `panel` count once, the one whose fields come last in order. Only the months
    that `panel` touches are read and written, each as a whole, so that history has
    one version and the same update twice changes nothing. The merged months are
    stored beside the archive before they take the place of the old ones: a run
    that breaks off leaves the archive as it was, or may be run again. Rows
    without date or instrument are left out; fields that one side lacks are null.
    """
    spark = panel.sparkSession
    stages = Stages(spark, "archive")
    named = lambda df: df.filter("date is not null and instrument is not null")
    month = F.date_format("date", "yyyy-MM").alias("month")
    rest = F.struct(*[c for c in panel.columns if c not in ("date", "instrument")]) if len(panel.columns) > 2 else F.lit(1)
    new = stages.store(named(panel).groupBy("date", "instrument").agg(F.max(rest).alias("row")).select("date", "instrument", *(["row.*"] if len(panel.columns) > 2 else []), month))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        months = new.select("month").distinct()
        old = spark.read.parquet(path).withColumn("month", F.col("month").cast("string"))
        kept = old.join(months, "month", "left_semi").join(new.select("date", "instrument"), ["date", "instrument"], "left_anti")
        merged = stages.store(kept.unionByName(new, allowMissingColumns=True))
    else:
        merged = new
    merged.repartition("month").sortWithinPartitions("month", "instrument", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def capped_universe(panel: DataFrame, most: int) -> DataFrame:
    """The rows of the first `most` instruments by name; also the small part of a panel that runs for debugging take."""
    return panel.join(panel.select("instrument").distinct().orderBy("instrument").limit(most), "instrument", "left_semi").select(panel.columns)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """A long table of bars with lower-case names (vol is volume), vwap as the mean of high, low and close where it lacks one, returns, and gaps filled forward, then backward; columns without any value are left out."""
    raw = spark.read.parquet(path)
    bars = raw.toDF(*["volume" if c.lower() == "vol" else c.lower() for c in raw.columns])
    bars = bars.withColumnsRenamed({"ticker": "instrument"} if "instrument" not in bars.columns else {})
    known = bars.agg(*[F.count(c).alias(c) for c in bars.columns]).first().asDict()
    bars = bars.select([c for c in bars.columns if known[c]])
    after = by_instrument().rowsBetween(0, Window.unboundedFollowing)
    numbers = [c for c in bars.columns if c not in ("date", "instrument")]
    filled = bars.select("date", "instrument", *[F.coalesce(forward_fill(c), F.first(c, ignorenulls=True).over(after)).alias(c) for c in numbers])
    if "vwap" not in numbers and {"high", "low", "close"} <= set(numbers):
        filled = filled.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3)
    if "returns" not in numbers and "close" in numbers:
        filled = filled.withColumn("returns", F.try_divide(F.col("close"), F.lag("close").over(by_instrument())) - 1)
    return filled


def write_table(panel: DataFrame, path: str, debug_instruments: int = 100) -> None:
    """The panel with `$` before its fields, and beside it the same of its first instruments."""
    named = panel.select("date", "instrument", *[F.col(c).alias(f"${c}") for c in panel.columns if c not in ("date", "instrument")])
    named.write.mode("overwrite").parquet(f"{path}/all")
    capped_universe(named, debug_instruments).write.mode("overwrite").parquet(f"{path}/debug")


def write_split(train: DataFrame, test: DataFrame, path: str) -> DataFrame:
    """One CSV table for each field and side, and a table split_info (side, first, last, dates, instruments), which is returned."""
    for side, panel in (("train", train), ("test", test)):
        for field in (c for c in panel.columns if c not in ("date", "instrument", "is_context")):
            panel.select("date", "instrument", field).write.mode("overwrite").option("header", True).csv(f"{path}/{side}/{field}")
    about = lambda side, p: p.agg(F.lit(side).alias("side"), F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("date").alias("dates"), F.count_distinct("instrument").alias("instruments"))
    info = about("train", train).union(about("test", test))
    info.write.mode("overwrite").option("header", True).csv(f"{path}/split_info")
    return info


def write_results(path: str, metrics: DataFrame, weights: DataFrame, daily: DataFrame, history: DataFrame | None = None) -> None:
    """Metrics, weights and daily figures as CSV, a history as JSON; not a number and infinities become null."""
    clean = lambda df: df.select([finite(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    for name, df in (("metrics", metrics), ("weights", weights), ("daily", daily)):
        clean(df).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    if history is not None:
        clean(history).write.mode("overwrite").json(f"{path}/history")


def read_nav(spark: SparkSession, path: str) -> DataFrame:
    """date, nav from a CSV table whose first column is the date and whose value stands under one of NAV_NAMES, else in the second column."""
    raw = spark.read.option("header", True).csv(path)
    lower = {c.lower(): c for c in raw.columns[1:]}
    name = next((lower[n] for n in NAV_NAMES if n in lower), raw.columns[1])
    return raw.select(F.to_date(F.col(f"`{raw.columns[0]}`")).alias("date"), F.col(f"`{name}`").cast("double").alias("nav"))


def save_memory(memory: DataFrame, path: str) -> None:
    memory.write.mode("overwrite").json(path)


def load_memory(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The stored memory with the columns and types of `like`; what a file lacks is null."""
    return spark.read.schema(like.schema).json(path)


def tail_split(panel: DataFrame, share: float, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """The panel before and from the last `share` of its dates on; with fewer than `least` dates all of it and nothing."""
    dates = panel.select("date").distinct()
    n = dates.count()  # the calendar
    if n < least:
        return panel, panel.limit(0)
    first = int(n * (1 - share))
    placed = dates.withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1)
    boundary = placed.filter(F.col("_i") == first).first()
    if boundary is None:
        return panel, panel.limit(0)
    return panel.filter(F.col("date") < F.lit(boundary["date"])), panel.filter(F.col("date") >= F.lit(boundary["date"]))


def stepped(grid: DataFrame, reports: DataFrame, columns: list[str]) -> DataFrame:
    """The grid's cells (date, instrument) with the columns of the newest report (instrument, date) up to each date, held until the next one.

    Both sides go into one order by instrument and date and are filled forward,
    so no cell is compared with all reports; of reports of one date the last of
    the columns' order counts.
    """
    known = reports.groupBy("instrument", "date").agg(F.max(F.struct(*columns)).alias("_r")).select("date", "instrument", F.lit(0).alias("_side"), "_r")
    cells = grid.select("date", "instrument", F.lit(1).alias("_side"), F.lit(None).cast(known.schema["_r"].dataType).alias("_r"))
    past = Window.partitionBy("instrument").orderBy("date", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return known.unionByName(cells).withColumn("_l", F.last("_r", ignorenulls=True).over(past)).filter("_side = 1").select("date", "instrument", *[F.col(f"_l.{c}").alias(c) for c in columns])


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells that both factors (date, instrument, value) have and know: date, instrument, a, b."""
    x, y = a.select("date", "instrument", F.col("value").alias("a")), b.select("date", "instrument", F.col("value").alias("b"))
    return x.join(y, ["date", "instrument"], "full").na.drop(subset=["a", "b"])
