"""The tradable universe: dollar volume, structural filter, top-N selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.scalars import EXCHANGES, is_fund

#: Days looked back for bars, bars averaged, price and dollar-volume floors, size of the universe.
LOOKBACK_DAYS, ADV_BARS = 40, 20
MIN_PRICE, MIN_ADV, MAX_SYMBOLS = 5.0, 1e7, 1000


def candidates(assets: DataFrame) -> DataFrame:
    """Tradable, listed on a major exchange, no slash in the symbol, not a fund by name."""
    return assets.where(F.col("tradable") & F.col("exchange").isin(*EXCHANGES) & ~F.contains("symbol", F.lit("/")) & ~is_fund(F.col("name")))


def dollar_volume(daily: DataFrame, day: str, bars: int = ADV_BARS, lookback: int = LOOKBACK_DAYS) -> DataFrame:
    """symbol, price (last close), adv_dollar (mean close x volume of the last bars) up to and including day.

    daily: symbol, day (date), close, volume.  Symbols without bars in the window are dropped.
    """
    until = F.lit(day).cast("date")
    recent = daily.where((F.col("day") >= F.date_sub(until, lookback)) & (F.col("day") <= until))
    ranked = recent.withColumn("_rn", F.row_number().over(Window.partitionBy("symbol").orderBy(F.col("day").desc())))
    return ranked.where(F.col("_rn") <= bars).groupBy("symbol").agg(
        F.max_by("close", "day").alias("price"), F.avg(F.col("close") * F.col("volume")).alias("adv_dollar")
    )


def select(stats: DataFrame, min_price: float = MIN_PRICE, min_adv: float = MIN_ADV, max_symbols: int = MAX_SYMBOLS) -> DataFrame:
    """rank, symbol, price, adv_dollar of the most traded symbols; ties by symbol.

    The top max_symbols are taken first (a bounded number), so ranking needs no sort of everything.
    """
    top = stats.where((F.col("price") >= min_price) & (F.col("adv_dollar") >= min_adv)).orderBy(F.col("adv_dollar").desc(), "symbol").limit(max_symbols)
    rank = F.row_number().over(Window.orderBy(F.col("adv_dollar").desc(), "symbol")).cast("long")
    return top.select(rank.alias("rank"), "symbol", "price", "adv_dollar")


def write(chosen: DataFrame, root: str, day: str) -> None:
    chosen.select(F.lit(day).alias("trade_date"), "*", F.lit(day).alias("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(root)


def latest(spark, root: str) -> DataFrame:
    """The universe of the newest day, in rank order; an error if there is none."""
    try:
        all_days = spark.read.parquet(root)
    except Exception as e:
        raise FileNotFoundError(f"no universe in {root}") from e
    newest = all_days.agg(F.max("date")).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no universe in {root}")
    return all_days.where(F.col("date") == F.lit(newest)).orderBy("rank")
