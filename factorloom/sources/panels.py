"""Price panels, one row per (date, instrument), from the line items, and preparation of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_TIE = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")


def bars(lines: DataFrame, instrument: str) -> DataFrame:
    """Monthly open, high, low, close, volume and amount of each instrument; first and last price under a total order of the lines."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    tie = F.struct(*_TIE)
    return (
        lines.groupBy(F.col(instrument).cast("string").alias("instrument"), F.trunc("l_shipdate", "month").alias("date"))
        .agg(F.min_by(price, tie).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, tie).alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"))
        .select("date", "instrument", "open", "high", "low", "close", "volume", "amount")
    )


def brand_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), spark.read.parquet(f"{sf_dir}/part.parquet")
    return bars(lines.join(part.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey"), "p_brand")


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey")


def supplier_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instrument, industry: each supplier's region."""
    supplier, nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "nation", "region"))
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").cast("string").alias("instrument"), F.col("r_name").alias("industry"))


def densify(panel: DataFrame) -> DataFrame:
    """A row for every date that any instrument has and every instrument: cells that the panel lacks are null. A cell stands in the panel once.

    Each instrument's cells come together by date, and the calendar, which comes
    from the same shuffled rows, is laid over them: the panel is made once. Both
    have the size of the calendar, not of the data.
    """
    names = [c for c in panel.columns if c not in ("date", "instrument")]
    cell = F.struct(*names) if names else F.struct(F.lit(1).alias("_"))
    held = panel.groupBy("instrument").agg(F.collect_list(F.struct("date", cell.alias("cell"))).alias("held"))
    dates = held.select(F.explode("held.date").alias("date")).agg(F.array_sort(F.collect_set("date")).alias("dates"))
    idle = F.transform(F.array_except("dates", "held.date"), lambda d: F.struct(d.alias("date"), F.lit(None).cast(held.schema["held"].dataType.elementType["cell"].dataType).alias("cell")))
    full = held.join(F.broadcast(dates)).select("instrument", F.explode(F.concat("held", idle)).alias("row"))
    return full.select("row.date", "instrument", *[F.col(f"row.cell.{c}").alias(c) for c in names])


def by_instrument() -> Window:
    return Window.partitionBy("instrument").orderBy("date")


def forward_fill(x: Column | str) -> Column:
    return F.last(x, ignorenulls=True).over(by_instrument().rowsBetween(Window.unboundedPreceding, 0))


def interpolate(x: str) -> Column:
    """Linear between known cells by row, held after the last one, null before the first."""
    at = F.row_number().over(by_instrument())
    known = F.when(F.col(x).isNotNull(), F.struct(at.alias("at"), F.col(x).alias("x")))
    before = F.last(known, ignorenulls=True).over(by_instrument().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(known, ignorenulls=True).over(by_instrument().rowsBetween(0, Window.unboundedFollowing))
    share = F.try_divide(at - before["at"], after["at"] - before["at"])
    return F.coalesce(F.col(x), before["x"] + share * (after["x"] - before["x"]), before["x"])


def drop_idle_dates(panel: DataFrame) -> DataFrame:
    """Without the dates on which no instrument has a close."""
    open_dates = panel.filter("close is not null").select("date").distinct()
    return panel.join(open_dates, "date", "left_semi")


def winsorize(panel: DataFrame, x: str, percent: float = 3.0) -> DataFrame:
    """x clipped to its percent and 100 - percent quantiles over each instrument's history."""
    edges = panel.groupBy("instrument").agg(F.percentile(x, F.array(F.lit(percent / 100), F.lit(1 - percent / 100))).alias("edge"))
    clipped = F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("edge")[0]), F.col("edge")[1]))
    return panel.join(edges, "instrument").withColumn(x, clipped).select(panel.columns)


def clip_sigma(panel: DataFrame, x: str, k: float = 3.0) -> DataFrame:
    """x clipped to k sample deviations around its mean over each instrument's history."""
    own = Window.partitionBy("instrument")
    mean, dev = F.avg(x).over(own), F.stddev_samp(x).over(own)
    return panel.withColumn(x, F.when(F.col(x).isNull(), None).when(dev.isNull(), F.col(x)).otherwise(F.least(F.greatest(F.col(x), mean - k * dev), mean + k * dev)))


def split(panel: DataFrame, boundary: Column, context: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train (dates before the boundary) and test (from it on, after `context` earlier dates that is_context marks)."""
    dates = panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))
    first = dates.filter(F.col("date") >= boundary).agg(F.min("i").alias("first"))
    marked = panel.join(F.broadcast(dates), "date").join(F.broadcast(first))
    test = marked.filter(F.col("i") >= F.col("first") - context).withColumn("is_context", F.col("i") < F.col("first"))
    return marked.filter("i < first").select(panel.columns), test.select(*panel.columns, "is_context")


def forward_return(k: int, price: str = "close") -> Column:
    return F.try_divide(F.lead(price, k).over(by_instrument()), F.col(price)) - 1


def padded_return(k: int = 1, price: str = "close") -> Column:
    """Change of the forward-filled price over k rows."""
    filled = forward_fill(price)
    return F.try_divide(filled, F.lag(filled, k).over(by_instrument())) - 1
