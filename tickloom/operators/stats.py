"""Latency distributions, histograms, coverage and shard statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scalars import shard_of

#: Upper bounds of the compute histogram (milliseconds) and of the bar-to-vector histogram (seconds).
COMPUTE_BUCKETS_MS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)
LATENCY_BUCKETS_S = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)
QUANTILES = (0.5, 0.9, 0.95, 0.99)


def distribution(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, p50, p90, p95, p99 (linear interpolation) and max of x."""
    p = F.percentile(x, F.array(*map(F.lit, QUANTILES)))
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), p.alias("_p"), F.max(x).alias("max"))
    return out.select(*by, "n", "mean", *(F.col("_p")[i].alias(f"p{round(100 * q)}") for i, q in enumerate(QUANTILES)), "max")


def histogram(df: DataFrame, x: str, bounds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts (le, n) of x up to each bound; le is NULL for the last, unbounded one."""
    counts = df.groupBy(*by).agg(*(F.count_if(F.col(x) <= le).alias(f"_{i}") for i, le in enumerate(bounds)), F.count(x).alias("_all"))
    rows = [F.struct(F.lit(float(le)).alias("le"), F.col(f"_{i}").alias("n")) for i, le in enumerate(bounds)]
    rows.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("_all").alias("n")))
    return counts.select(*by, F.explode(F.array(*rows)).alias("r")).select(*by, "r.le", "r.n")


def histogram_quantile(hist: DataFrame, q: float, by: Sequence[str] = ()) -> DataFrame:
    """The q-quantile of each cumulative histogram (le, n; le is NULL for the unbounded bucket), linear inside a bucket.

    The lowest bucket starts at 0; a quantile in the unbounded bucket is the highest bound; NULL without values.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    rows = hist.withColumns({"_lo": F.lag("le").over(w), "_before": F.lag("n").over(w), "_all": F.max("n").over(Window.partitionBy(*by))})
    want = q * F.col("_all")
    hit = rows.withColumn("_k", F.row_number().over(w)).where((F.col("n") >= want) & (F.col("_all") > 0))
    first = hit.groupBy(*by).agg(F.min_by(F.struct("le", "n", "_lo", "_before", "_all"), "_k").alias("h"))
    lo, before = F.coalesce("h._lo", F.lit(0.0)), F.coalesce("h._before", F.lit(0))
    share = F.when(F.col("h.n") > before, (q * F.col("h._all") - before) / (F.col("h.n") - before)).otherwise(0.0)
    value = F.when(F.col("h.le").isNull(), F.col("h._lo")).otherwise(lo + (F.col("h.le") - lo) * share)
    return first.select(*by, value.alias("value"))


def slowest_first(costs: DataFrame) -> DataFrame:
    """Costs by feature, the highest p99 first, then by name."""
    return costs.orderBy(F.col("p99").desc_nulls_last(), "feature")


def totals(costs: DataFrame) -> DataFrame:
    """One row: features, the sum of their own costs and whether all are within the budget."""
    return costs.agg(F.count("*").alias("features"), F.sum("own").alias("own"), F.coalesce(F.bool_and("within"), F.lit(True)).alias("all_within"))


def marginal_cost(samples: DataFrame, baseline: str, budget: float) -> DataFrame:
    """Per feature: distribution, own cost (mean less the baseline's) and whether its p99 is within the budget."""
    d = distribution(samples, "ns", ["feature"])
    base = d.where(F.col("feature") == baseline).select(F.col("mean").alias("base"))
    return d.where(F.col("feature") != baseline).crossJoin(F.broadcast(base)).select("*", (F.col("mean") - F.col("base")).alias("own"), (F.col("p99") < budget).alias("within"))


def bar_latency(df: DataFrame, received_ns: str = "received_ns") -> DataFrame:
    """df with the seconds from the end of a bar to its receipt, at least 0."""
    return df.withColumn("latency_s", F.greatest((F.col(received_ns) - (F.col("ts_ns") + 60_000_000_000)) / 1e9, F.lit(0.0)))


def coverage(partitions: DataFrame) -> DataFrame:
    """date, tickers, level: distinct tickers a date as a byte of all tickers, newest first."""
    pairs = partitions.select("date", "ticker").distinct()
    total = F.broadcast(pairs.agg(F.greatest(F.count_distinct("ticker"), F.lit(1)).alias("universe")))
    per = pairs.groupBy("date").agg(F.count("*").alias("tickers"))
    return per.crossJoin(total).select("date", "tickers", F.bround(F.lit(255.0) * F.col("tickers") / F.col("universe"), 0).cast("long").alias("level")).orderBy(F.col("date").desc())


def shards(df: DataFrame, n: int) -> DataFrame:
    return df.select("ticker").distinct().withColumn("shard", shard_of(F.col("ticker"), n))


def shard_sizes(df: DataFrame, n: int) -> DataFrame:
    per = shards(df, n).groupBy("shard").count()
    return per.agg(F.min("count").alias("min_tickers"), F.max("count").alias("max_tickers"), F.count("*").alias("used_shards"))


def chunks(df: DataFrame, size: int, order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """df with the number of its chunk of size rows in order, from 0."""
    if size < 1:
        raise ValueError("a chunk has at least one row")
    return _numbered(df, order, by).withColumn("chunk", F.floor((F.col("_rn") - 1) / size)).drop("_rn")


def deal(df: DataFrame, hands: int, order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """df with the hand (from 0) that each row goes to when rows are dealt in turn."""
    if hands < 1:
        raise ValueError("at least one hand")
    return _numbered(df, order, by).withColumn("hand", F.pmod(F.col("_rn") - 1, F.lit(hands)).cast("long")).drop("_rn")


def _numbered(df: DataFrame, order: Sequence[Column | str], by: Sequence[str]) -> DataFrame:
    """Job lists and symbol lists are small; anything large is numbered within keys."""
    from pyspark.sql import Window

    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def sample_every(df: DataFrame, n: int, order: Sequence[Column | str], by: Sequence[str]) -> DataFrame:
    """Every nth row within each key (a report's feature, not a shortcut)."""
    from pyspark.sql import Window

    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rn", rn).where(F.col("_rn") % n == 0).drop("_rn")
