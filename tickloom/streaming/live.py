"""Live processing with Structured Streaming.

``run_live`` appends each micro-batch of raw bars, trades and quotes and recomputes the sessions it touches with the batch plan, so a
stream and a backfill agree by construction; late rows of an earlier session only touch that session.
``build_bars`` makes minute bars from a stream of trades under a watermark.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions import clock
from tickloom.plans import features
from tickloom.sources.stores import FeatureStore, RawStore, _exists


def build_bars(trades: DataFrame, late: str = "2 minutes") -> DataFrame:
    """Streaming minute bars; a bar is emitted once its minute is past the watermark."""
    at = F.struct("ts_ns")
    t = trades.withColumn("ts", F.timestamp_micros(F.call_function("div", F.col("ts_ns"), F.lit(1000)))).withWatermark("ts", late)
    bars = t.groupBy("ticker", F.window("ts", "1 minute")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("size").alias("volume"), F.count("*").alias("trade_count"), F.sum(F.col("price") * F.col("size")).alias("notional"),
    )
    return bars.select(
        "ticker", (F.unix_micros("window.start") * 1000).alias("ts_ns"), "open", "high", "low", "close", "volume", "trade_count",
        F.when(F.col("volume") > 0, F.col("notional") / F.col("volume")).otherwise(F.col("close")).alias("vwap"),
    )


def _add(raw: RawStore, kind: str, rows: DataFrame, days: list[str], held: str) -> None:
    """Add rows to the raw store.  A batch that runs again finds what it held and adds nothing twice."""
    spark = raw.spark
    if not _exists(spark, f"{held}/_SUCCESS"):
        known = raw.read(kind, days).drop("date")
        both = known.unionByName(rows.select(*known.columns))
        if kind == "bars":  # equal ticks are different ticks
            both = both.dropDuplicates(["ticker", "ts_ns"])
        both.write.mode("overwrite").parquet(held)  # a partition can't be read and replaced in one job
    raw.write(kind, spark.read.parquet(held))


def apply_batch(batch: DataFrame, batch_id: int, raw: RawStore, store: FeatureStore, run: str | None = None) -> None:
    """Store a micro-batch and rewrite the features of the sessions that it touches, from all the raw rows of their days.

    batch: rows of the kinds of the raw store, told by a column kind; without one they are bars.
    run: names the stream, if a batch of it that is given again is to count once.
    """
    spark = batch.sparkSession
    if "kind" not in batch.columns:
        batch = batch.withColumn("kind", F.lit("bars"))
    batch = batch.persist()
    try:
        days = [r[0] for r in batch.select(clock.session_date(F.col("ts_ns")).cast("string")).distinct().collect()]  # few
        if not days:
            return
        pending = f"{raw.root}/_pending/{run or uuid.uuid4().hex}"
        for r in batch.select("kind").distinct().collect():
            _add(raw, r["kind"], batch.where(F.col("kind") == r["kind"]), days, f"{pending}/{batch_id}/{r['kind']}")
        tickers = F.broadcast(batch.select("ticker").distinct()) if batch.count() < 1_000_000 else None
        rows = [df if tickers is None else df.join(tickers, "ticker", "left_semi") for df in raw.replay(days)]
        store.write(features.compute(*rows), "stream")  # by time, so that a new checkpoint, which counts from 0, wins too
        _delete(spark, f"{pending}/{batch_id - 1}" if run else pending)
    finally:
        batch.unpersist()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run_live(
    bars: DataFrame, raw: RawStore, store: FeatureStore, checkpoint: str, available_now: bool = True, trades: DataFrame | None = None, quotes: DataFrame | None = None
) -> StreamingQuery:
    """Start the live job on streams of bars and, if given, trades and quotes."""
    rows = bars.withColumn("kind", F.lit("bars"))
    for kind, df in (("trades", trades), ("quotes", quotes)):
        if df is not None:
            rows = rows.unionByName(df.withColumn("kind", F.lit(kind)), allowMissingColumns=True)

    def apply(df: DataFrame, i: int) -> None:
        run = json.loads(df.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        apply_batch(df, i, raw, store, run)

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
