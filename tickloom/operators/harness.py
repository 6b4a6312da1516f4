"""What a feature group costs: batches of synthetic minutes, timed with and without the group."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators import stats
from tickloom.plans import features
from tickloom.sources.simulation import Simulation, simulate

#: Name of the run that keeps the tape but computes no group.
BASELINE = "state_only"
#: Minutes, trades and quotes a minute of the measured session.
MINUTES, TRADES, QUOTES = 4000, 8, 6


def slices(spark: SparkSession, minutes: int = MINUTES, trades: int = TRADES, quotes: int = QUOTES, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, trades and quotes of a synthetic session."""
    return simulate(spark, Simulation(tickers=("AAA",), minutes=minutes, trades_per_minute=trades, quotes_per_minute=quotes, seed=seed))


def _seconds(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def measure(spark: SparkSession, groups: Iterable[str] | None = None, minutes: int = MINUTES, rounds: int = 3, seed: int = 0) -> DataFrame:
    """(feature, ns): nanoseconds a bar of each group and of the baseline, a row a round; the first round warms up."""
    frames = [df.cache() for df in slices(spark, minutes, seed=seed)]
    rows = []
    try:
        for name in (BASELINE, *(groups if groups is not None else features.REGISTRY)):
            for i in range(rounds + 1):
                df = features.bar_table(*frames) if name == BASELINE else features.compute(*frames, groups=[name])
                ns = 1e9 * _seconds(df) / minutes
                if i:
                    rows.append((name, ns))
    finally:
        for df in frames:
            df.unpersist()
    return spark.createDataFrame(rows, "feature string, ns double")


def report(samples: DataFrame, budget_ns: float) -> DataFrame:
    """Distribution, own cost and budget of each group, slowest first."""
    return stats.slowest_first(stats.marginal_cost(samples, BASELINE, budget_ns))


def table(costs: DataFrame) -> str:
    """The report as text, a line a group."""
    lines = [f"{'feature':<16}{'mean ns':>12}{'p50':>12}{'p99':>12}{'own':>12}  within"]
    lines += [f"{r.feature:<16}{r.mean:>12.0f}{r.p50:>12.0f}{r.p99:>12.0f}{r.own:>12.0f}  {'yes' if r.within else 'no'}" for r in costs.collect()]  # a row a group
    return "\n".join(lines)


def dump_json(costs: DataFrame, path: str) -> None:
    """The report as JSON lines."""
    costs.coalesce(1).write.mode("overwrite").json(path)
