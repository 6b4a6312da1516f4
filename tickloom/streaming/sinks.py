"""Sinks of the live job: console, metrics, and a counted feature writer."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from tickloom.operators import stats
from tickloom.plans import features
from tickloom.sources.stores import FeatureStore

#: Name of the observed metrics.
OBSERVED = "bars"


def console(df: DataFrame, sample_every: int = 1, rows: int = 20) -> DataStreamWriter:
    """A writer that prints ticker, time and the number of valid values of every nth bar of a batch."""

    def show(batch: DataFrame, _: int) -> None:
        out = batch.select("ticker", "ts_ns", features.valid_count(batch).alias("n_valid"))
        stats.sample_every(out, sample_every, ["ts_ns"], ["ticker"]).show(rows, truncate=False)

    return df.writeStream.foreachBatch(show)


def observed(df: DataFrame, seconds: str = "latency_s") -> DataFrame:
    """df that reports, a batch, its rows and the cumulative buckets of a latency column (NULLs are in none)."""
    buckets = [F.count_if(F.col(seconds) <= le).alias(f"le_{i}") for i, le in enumerate(stats.LATENCY_BUCKETS_S)]
    return df.observe(OBSERVED, F.count(F.lit(1)).alias("rows"), F.count(seconds).alias("values"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("sum"), *buckets)


class Metrics(StreamingQueryListener):
    """Sums of what ``observed`` reports, over all batches of the queries that it listens to."""

    def __init__(self):
        self.lock, self.sums = threading.Lock(), Counter()

    def add(self, row) -> None:
        with self.lock:
            self.sums.update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(OBSERVED)
        if row is not None:
            self.add(row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def histogram(self, spark) -> DataFrame:
        """(le, n) as of now; le is NULL for the unbounded bucket."""
        with self.lock:
            rows = [(float(le), int(self.sums[f"le_{i}"])) for i, le in enumerate(stats.LATENCY_BUCKETS_S)] + [(None, int(self.sums["values"]))]
        return spark.createDataFrame(rows, "le double, n long")


class CountedWriter:
    """Writes batches to a feature store and counts rows submitted, written and dropped.  A batch that fails is dropped
    only if ``drop`` says so; else the query stops and takes it up again from its checkpoint."""

    def __init__(self, store: FeatureStore, source: str = "stream", drop: bool = False):
        self.store, self.source, self.drop = store, source, drop
        self.submitted = self.written = self.dropped = 0

    def __call__(self, batch: DataFrame, _: int = 0) -> None:
        batch = batch.persist()
        try:
            n = batch.count()
            self.submitted += n
            try:
                self.store.write(batch, self.source)
                self.written += n
            except Exception:
                if not self.drop:
                    raise
                self.dropped += n
        finally:
            batch.unpersist()
