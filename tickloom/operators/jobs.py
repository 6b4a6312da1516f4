"""Calendars, job lists and retention."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.operators import universe
from tickloom.plans import features
from tickloom.sources.stores import FeatureStore, RawStore

#: Days of each kind of raw data that are kept.
KEEP_DAYS = {"quotes": 35, "trades": 180, "bars": 180}


def trading_days(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Monday to Friday from start to end, both included."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day"))
    return days.where(F.weekday("day") < 5)


def missing_jobs(days: DataFrame, tickers: DataFrame, present: DataFrame) -> DataFrame:
    """The (day, ticker) pairs that present lacks.  The calendar is small, so the pairs are made by a broadcast."""
    return tickers.select("ticker").distinct().crossJoin(F.broadcast(days.select("day"))).join(present.select("day", "ticker").distinct(), ["day", "ticker"], "left_anti")


def ready_jobs(wanted: DataFrame, with_bars: DataFrame) -> DataFrame:
    """The wanted (day, ticker) pairs that have bars."""
    return wanted.join(with_bars.select("day", "ticker").distinct(), ["day", "ticker"], "left_semi")


def backfill_raw(raw: RawStore, frames: dict[str, DataFrame], days: Iterable[str], tickers: Iterable[str] | None = None, redo: bool = False) -> dict[str, int]:
    """Store vendor rows by kind (bars, trades, quotes) of the days that the store lacks (all of them with redo); the
    number of days written by kind."""
    wanted, done = set(days), {}
    for kind, rows in frames.items():
        have = set() if redo else {r["date"] for r in raw.read(kind).select("date").distinct().collect()}  # a row a day
        missing = sorted(wanted - have)
        if missing:
            rows = rows.where(clock.session_date(F.col("ts_ns")).cast("string").isin(*missing))
            raw.write(kind, rows if tickers is None else rows.where(F.col("ticker").isin(*tickers)))
        done[kind] = len(missing)
    return done


def backfill_features(raw: RawStore, store: FeatureStore, days: Iterable[str] | None = None, tickers: Iterable[str] | None = None, with_ticks: bool = True, redo: bool = False) -> None:
    """Compute the features of raw days that aren't settled yet (all of them with redo) and store them as backfill."""
    present = raw.read("bars", days, tickers).select("date").distinct()
    if not redo:
        present = present.join(F.broadcast(store.settled_dates()), "date", "left_anti")
    todo = [r["date"] for r in present.collect()]  # a row a day
    if todo:
        store.write(features.compute(*raw.replay(todo, tickers, with_ticks)), "backfill")


def build_universe(assets: DataFrame, daily: DataFrame, day: str, root: str, **limits) -> DataFrame:
    """The universe of a day: structural filter, dollar volume, selection; written and returned."""
    names = universe.candidates(assets).select("symbol").distinct()
    stats = universe.dollar_volume(daily.join(names, "symbol", "left_semi"), day)
    universe.write(universe.select(stats, **limits), root, day)
    return universe.latest(daily.sparkSession, root)


def expired(partitions: DataFrame, today: str | date, keep: dict[str, int] = KEEP_DAYS) -> DataFrame:
    """kind, day of the partitions older than their kind's days (strictly)."""
    limit = F.create_map(*(x for k, n in keep.items() for x in (F.lit(k), F.lit(n))))
    return partitions.where(F.col("day") < F.date_sub(F.lit(str(today)).cast("date"), F.element_at(limit, F.col("kind"))))


def prune(spark: SparkSession, root: str, today: str | date, keep: dict[str, int] = KEEP_DAYS, dry_run: bool = False) -> dict[str, int]:
    """Delete expired day partitions of a raw store through the file system of its path; counts by kind."""
    jvm, counts = spark._jvm, {}
    for kind in keep:
        base = jvm.org.apache.hadoop.fs.Path(f"{root}/{kind}")
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(base)] if fs.exists(base) else []
        days = [(kind, p.getName().removeprefix("date="), p) for p in found if p.getName().startswith("date=")]
        old = set()
        if days:
            df = spark.createDataFrame([(k, d) for k, d, _ in days], "kind string, day string").withColumn("day", F.col("day").cast("date"))
            old = {str(r["day"]) for r in expired(df, today, keep).collect()}  # a row a partition
        for _, d, p in days:
            if d in old and not dry_run:
                fs.delete(p, True)
        counts[kind] = len(old)
    return counts
