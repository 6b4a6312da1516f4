"""The event tape: trades, quotes and bars of a ticker's session in one order.

Orders: ``replay`` puts the ticks of a minute before its bar and sorts them by time (a quote before a trade at the same
instant, then by arrival); ``arrival`` takes the arrival numbers as they are.
Every step partitions by (ticker, session_date), so one exchange serves the tape and all windows over its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import clock, kernels

KEYS = ["ticker", "session_date"]


def order_columns(order: str = "replay") -> list[Column]:
    if order == "replay":
        return [F.col(c) for c in ("minute_bucket", "is_bar", "ts_ns", "rank", "seq")]
    if order == "arrival":
        return [F.col("seq")]
    raise ValueError("order is replay or arrival")


def build(bars: DataFrame, trades: DataFrame | None = None, quotes: DataFrame | None = None) -> DataFrame:
    """The union of the streams with kind, session_date, minute_bucket, is_bar, rank and seq (0 where there is none)."""
    parts = []
    for kind, rank, df in (("quote", 0, quotes), ("trade", 1, trades), ("bar", 2, bars)):
        if df is not None:
            seq = F.col("seq").cast("long") if "seq" in df.columns else F.lit(0).cast("long")
            parts.append(df.withColumn("seq", seq).withColumn("kind", F.lit(kind)).withColumn("rank", F.lit(rank)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c in ("bid", "ask", "bid_size", "ask_size", "price", "size"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("double"))
    return out.select(
        "*",
        clock.session_date(F.col("ts_ns")).alias("session_date"),
        clock.minute_bucket(F.col("ts_ns")).alias("minute_bucket"),
        (F.col("kind") == "bar").cast("int").alias("is_bar"),
    )


def with_quotes(tape: DataFrame, order: str = "replay") -> DataFrame:
    """The prevailing quote of each row (as-of join backward): q_mid, q_bid, q_ask, q_bid_size, q_ask_size."""
    w = kernels.so_far(Window.partitionBy(*KEYS).orderBy(*order_columns(order)))
    quote = F.when(F.col("kind") == "quote", F.struct(((F.col("bid") + F.col("ask")) / 2).alias("mid"), "bid", "ask", "bid_size", "ask_size"))
    out = tape.withColumn("_q", F.last(quote, ignorenulls=True).over(w))
    return out.select("*", *(F.col(f"_q.{c}").alias(f"q_{c}") for c in ("mid", "bid", "ask", "bid_size", "ask_size"))).drop("_q")


def with_bar_index(tape: DataFrame, order: str = "replay") -> DataFrame:
    """bar_idx: the bar that consumes the row (as-of join forward); ticks after the last bar get the next number."""
    w = Window.partitionBy(*KEYS).orderBy(*order_columns(order)).rowsBetween(Window.unboundedPreceding, -1)
    return tape.withColumn("bar_idx", F.coalesce(F.sum("is_bar").over(w), F.lit(0)))
