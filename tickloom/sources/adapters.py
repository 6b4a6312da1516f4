"""From source rows to bars, trades and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import clock


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with ticker, ts_ns, seq and the number k of its props."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("T"), F.pmod("user_id", F.lit(4)).cast("string")).alias("ticker"),
        clock.to_ns(F.col("ts")).alias("ts_ns"),
        F.col("event_id").alias("seq"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def trades_of(ev: DataFrame) -> DataFrame:
    return ev.where(F.col("event_type").isin("purchase", "click", "signup")).select(
        "ticker", "ts_ns", F.col("value").alias("price"), (F.col("k") + 1).cast("double").alias("size"), "seq"
    )


def quotes_of(ev: DataFrame) -> DataFrame:
    half = F.col("value") * (F.col("k") + 1) / 1e5
    return ev.where(F.col("event_type").isin("view", "error")).select(
        "ticker",
        "ts_ns",
        (F.col("value") - half).alias("bid"),
        (F.col("value") + half).alias("ask"),
        (F.col("k") + 1).cast("double").alias("bid_size"),
        (F.pmod("seq", F.lit(17)) + 1).cast("double").alias("ask_size"),
        "seq",
    )


def bars_of(trades: DataFrame) -> DataFrame:
    """One-minute bars; ts_ns is the opening minute."""
    at = F.struct("ts_ns", "seq")
    notional, size = F.sum(F.col("price") * F.col("size")), F.sum("size")
    return (
        trades.withColumn("m", clock.minute_bucket(F.col("ts_ns")))
        .groupBy("ticker", "m")
        .agg(
            F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", at).alias("close"), size.alias("volume"), F.count("*").alias("trade_count"),
            F.when(size > 0, notional / size).otherwise(F.max_by("price", at)).alias("vwap"),
        )
        .select("ticker", (F.col("m") * clock.MINUTE_NS).alias("ts_ns"), "open", "high", "low", "close", "volume", "trade_count", "vwap")
    )


def vendor_bars(raw: DataFrame) -> DataFrame:
    """Rows of a vendor (symbol, timestamp, OHLCV); a missing trade count is 0, a missing vwap the close."""
    return raw.select(
        F.col("symbol").alias("ticker"), clock.to_ns(F.col("timestamp")).alias("ts_ns"),
        *(F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")),
        F.coalesce(F.col("trade_count").cast("long"), F.lit(0).cast("long")).alias("trade_count"),
        F.coalesce(F.col("vwap").cast("double"), F.col("close").cast("double")).alias("vwap"),
    )


def vendor_trades(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("symbol").alias("ticker"), clock.to_ns(F.col("timestamp")).alias("ts_ns"), F.col("price").cast("double"), F.col("size").cast("double"))


def vendor_quotes(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.col("symbol").alias("ticker"), clock.to_ns(F.col("timestamp")).alias("ts_ns"),
        F.col("bid_price").cast("double").alias("bid"), F.col("ask_price").cast("double").alias("ask"),
        F.col("bid_size").cast("double"), F.col("ask_size").cast("double"),
    )


def load(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, trades and quotes of the events table."""
    ev = events(spark, sf_dir)
    trades = trades_of(ev)
    return bars_of(trades), trades, quotes_of(ev)
