"""A deterministic market simulator: a geometric walk a ticker, with quotes, trades and a bar each minute.

Random numbers are hashes of (seed, ticker, minute, what), so any partitioning gives the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.clock import MINUTE_NS


@dataclass(frozen=True)
class Simulation:
    """Defaults of the simulated session."""

    tickers: tuple[str, ...] = field(default=("AAA", "BBB"))
    minutes: int = 90
    trades_per_minute: int = 6
    quotes_per_minute: int = 4
    price: float = 100.0
    vol: float = 0.0008
    seed: int = 7
    start_ns: int = 1_782_307_800_000_000_000


def _uniform(seed: int, *what: Column | str) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *(F.lit(w) if isinstance(w, str) else w for w in what)), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _normal(seed: int, *what: Column | str) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, *what, "u"))) * F.cos(2 * F.pi() * _uniform(seed, *what, "v"))


def simulate(spark: SparkSession, sim: Simulation = Simulation()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, trades and quotes with seq in delivery order: all quotes of a minute, its trades, its bar."""
    names = F.array(*map(F.lit, sim.tickers))
    grid = spark.range(len(sim.tickers)).select(F.element_at(names, (F.col("id") + 1).cast("int")).alias("ticker"), F.col("id").alias("i"))
    grid = grid.withColumn("minute", F.explode(F.sequence(F.lit(0), F.lit(sim.minutes - 1))))
    step = sim.vol * _normal(sim.seed, F.col("ticker"), F.col("minute"), "step")
    w = Window.partitionBy("ticker").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("mid", sim.price * (1 + 0.01 * F.col("i")) * F.exp(F.sum(step).over(w)))
    begin = F.lit(sim.start_ns) + F.col("minute").cast("long") * MINUTE_NS
    per = sim.quotes_per_minute + sim.trades_per_minute + 1

    def ticks(n, share, first):
        t = grid.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n else grid.withColumn("j", F.lit(0)).where("false")
        at = begin + ((F.col("j") + 0.5) / max(n, 1) * share * MINUTE_NS).cast("long")
        return t.withColumn("ts_ns", at).withColumn("seq", F.col("minute").cast("long") * per + first + F.col("j"))

    q = ticks(sim.quotes_per_minute, 0.9, 0)
    half = F.col("mid") * (0.0001 + 0.0004 * _uniform(sim.seed, F.col("ticker"), F.col("seq"), "half"))

    def size(what):
        return (1 + F.floor(9 * _uniform(sim.seed, F.col("ticker"), F.col("seq"), what))).cast("double") * 100

    quotes = q.select("ticker", "ts_ns", (F.col("mid") - half).alias("bid"), (F.col("mid") + half).alias("ask"), size("b").alias("bid_size"), size("a").alias("ask_size"), "seq")
    t = ticks(sim.trades_per_minute, 0.95, sim.quotes_per_minute)
    price = F.col("mid") * (1 + 0.5 * sim.vol * _normal(sim.seed, F.col("ticker"), F.col("seq"), "price"))
    trades = t.select("ticker", "ts_ns", price.alias("price"), size("t").alias("size"), "seq")
    o = F.coalesce(F.lag("mid").over(Window.partitionBy("ticker").orderBy("minute")), F.col("mid"))
    wide = sim.vol * _uniform(sim.seed, F.col("ticker"), F.col("minute"), "wide")
    b = grid.withColumn("open", o).withColumn("close", F.col("mid"))
    b = b.withColumn("high", F.greatest("open", "close") * (1 + wide)).withColumn("low", F.least("open", "close") * (1 - wide))
    bars = b.select(
        "ticker", begin.alias("ts_ns"), "open", "high", "low", "close",
        (1000 + F.floor(9000 * _uniform(sim.seed, F.col("ticker"), F.col("minute"), "volume"))).cast("double").alias("volume"),
        F.lit(sim.trades_per_minute).cast("long").alias("trade_count"), ((F.col("high") + F.col("low") + F.col("close")) / 3).alias("vwap"),
        (F.col("minute").cast("long") * per + per - 1).alias("seq"),
    )
    return bars, trades, quotes
