"""Parquet stores of raw ticks and of features.

The ticker is a column (no name is lost in a path), days are partitions (``date``), so reads prune by partition and push
the rest of the predicate to the files.  Feature rows carry ``write_seq``, by which the last write of a key wins.
"""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import clock
from tickloom.schema import BARS, QUOTES, TRADES, VERSION

KINDS = {"bars": BARS, "trades": TRADES, "quotes": QUOTES}
SOURCES = ("backfill", "stream")
KEYS = ["ticker", "ts_ns"]


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class RawStore:
    """Bars, trades and quotes by day."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def write(self, kind: str, rows: DataFrame) -> None:
        """Replace the days that rows hold; no rows, no files."""
        names = [c.split()[0] for c in KINDS[kind].split(", ")]
        day = clock.session_date(F.col("ts_ns")).cast("string")
        out = rows.select(*names, day.alias("date")).repartition("date", "ticker").sortWithinPartitions("ticker", "ts_ns")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(f"{self.root}/{kind}")

    def read(self, kind: str, days: Iterable[str] | None = None, tickers: Iterable[str] | None = None) -> DataFrame:
        schema = f"{KINDS[kind]}, date string"
        path = f"{self.root}/{kind}"
        if not _exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(path)
        if days is not None:
            df = df.where(F.col("date").isin(*days))
        if tickers is not None:
            df = df.where(F.col("ticker").isin(*tickers))
        return df

    def days(self, kind: str = "bars") -> DataFrame:
        return self.read(kind).select("date").distinct().orderBy("date")

    def tickers(self, day: str, kind: str = "bars") -> DataFrame:
        return self.read(kind, [day]).select("ticker").distinct().orderBy("ticker")

    def has(self, kind: str, day: str, ticker: str) -> bool:
        return bool(self.read(kind, [day], [ticker]).limit(1).count())

    def replay(self, days: Iterable[str] | None = None, tickers: Iterable[str] | None = None, with_ticks: bool = True):
        """Bars, trades and quotes for the feature engine (None without ticks)."""
        bars = self.read("bars", days, tickers).drop("date")
        return (bars, *(self.read(k, days, tickers).drop("date") if with_ticks else None for k in ("trades", "quotes")))


def last_write_wins(df: DataFrame, order: str = "write_seq") -> DataFrame:
    """One row a key: the one written last."""
    rn = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col(order).desc(), F.xxhash64("*").desc()))  # ties: the same row each time
    return df.withColumn("_rn", rn).where(F.col("_rn") == 1).drop("_rn")


def merge(settled: DataFrame, provisional: DataFrame) -> DataFrame:
    """The settled rows, and the provisional ones whose key isn't settled."""
    extra = provisional.join(settled.select(*KEYS), KEYS, "left_anti")
    return settled.unionByName(extra, allowMissingColumns=True)


class FeatureStore:
    """Feature rows by version, source and day."""

    def __init__(self, spark: SparkSession, root: str, version: str = VERSION):
        self.spark, self.root, self.version = spark, root, version

    def write(self, features: DataFrame, source: str, write_seq: int | None = None) -> None:
        """Append rows; a later write_seq (the time of the write, if none is given) replaces the keys of earlier ones on
        reading."""
        write_seq = time.time_ns() if write_seq is None else write_seq
        if source not in SOURCES:
            raise ValueError(f"source is one of {SOURCES}")
        out = features.select(
            "*", F.lit(write_seq).cast("long").alias("write_seq"), F.lit(self.version).alias("v"), F.lit(source).alias("source"),
            clock.session_date(F.col("ts_ns")).cast("string").alias("date"),
        )
        out.repartition("date", "ticker").write.mode("append").partitionBy("v", "source", "date").parquet(self.root)

    def scan(self, source: str, start_ns: int | None = None, end_ns: int | None = None) -> DataFrame | None:
        """Deduplicated rows of one source with start <= ts_ns < end; whole days outside are never read."""
        if source not in SOURCES:
            raise ValueError(f"source is one of {SOURCES}")
        if not _exists(self.spark, f"{self.root}/v={self.version}/source={source}"):
            return None
        here = f"{self.root}/v={self.version}/source={source}"  # files of other versions and sources aren't even listed
        df = self.spark.read.option("mergeSchema", "true").option("basePath", self.root).parquet(here)
        for bound, op in ((start_ns, "ge"), (end_ns, "lt")):
            if bound is not None:
                day = clock.session_date(F.lit(bound)).cast("string")
                df = df.where((F.col("ts_ns") >= bound) & (F.col("date").cast("string") >= day)) if op == "ge" else df.where((F.col("ts_ns") < bound) & (F.col("date").cast("string") <= day))
        return last_write_wins(df).drop("write_seq", "v", "source", "date")

    def read(self, start_ns: int | None = None, end_ns: int | None = None, names: Iterable[str] | None = None, source: str = "auto", provisional: str = "stream", ordered: bool = True) -> DataFrame:
        """Feature rows by key, in its order unless ordered is false (a sort of all rows).  auto: backfill settles, the
        provisional source fills in."""
        if source == "auto":
            settled, extra = self.scan("backfill", start_ns, end_ns), self.scan(provisional, start_ns, end_ns)
            df = merge(settled, extra) if settled is not None and extra is not None else settled if settled is not None else extra
        else:
            df = self.scan(source, start_ns, end_ns)
        if df is None:
            df = self.spark.createDataFrame([], "ticker string, ts_ns long")
        if names is not None:
            df = df.select(*KEYS, *(x for x in names if x in df.columns))
        return df.orderBy(*KEYS) if ordered else df

    def settled_dates(self) -> DataFrame:
        if not _exists(self.spark, f"{self.root}/v={self.version}/source=backfill"):
            return self.spark.createDataFrame([], "date string")
        df = self.spark.read.option("basePath", self.root).parquet(f"{self.root}/v={self.version}/source=backfill")
        return df.select(F.col("date").cast("string").alias("date")).distinct().orderBy("date")

    def partitions(self) -> DataFrame:
        """v, source, date, rows of every partition."""
        return self.spark.read.parquet(self.root).groupBy("v", "source", F.col("date").cast("string").alias("date")).agg(F.count("*").alias("rows"))
