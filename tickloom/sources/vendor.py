"""Vendor rows as a Python data source: a partition for each day and chunk of symbols, with retries.

There is no network code.  ``fetch`` stands for the vendor: it is any function of (kind, day, symbols) that returns rows,
and ``from_files`` makes one of a folder of CSV files (``kind/day.csv`` with a header and the columns of the schema).
"""

from __future__ import annotations

import csv
import os
import random
import time
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tickloom.sources.stores import KINDS

#: Tries, first and longest wait in seconds, symbols of a request.
TRIES, FIRST_WAIT, LONGEST_WAIT, SYMBOLS = 8, 1.0, 60.0, 200


class VendorError(Exception):
    """A request that may succeed when it is repeated."""


def with_retry(call: Callable, tries: int = TRIES, wait: Callable[[float], None] = time.sleep, seed: int | None = None):
    """What call returns; after the kth VendorError it waits min(2 ** (k - 1), 60) seconds, give or take half of that."""
    rng = random.Random(seed)
    for k in range(1, tries + 1):
        try:
            return call()
        except VendorError:
            if k == tries:
                raise
            wait(min(FIRST_WAIT * 2 ** (k - 1), LONGEST_WAIT) * rng.uniform(0.5, 1.5))


def chunked(items: Iterable[str], size: int = SYMBOLS) -> list[list[str]]:
    items = list(items)
    return [items[i : i + size] for i in range(0, len(items), size)]


def from_files(root: str) -> Callable[[str, str, list[str]], Iterator[tuple]]:
    def fetch(kind: str, day: str, symbols: list[str]) -> Iterator[tuple]:
        path = os.path.join(root, kind, f"{day}.csv")
        if not os.path.exists(path):
            return
        columns = [c.split() for c in KINDS[kind].split(", ")]
        make = {"string": str, "long": int, "double": float}
        with open(path, newline="") as f:
            for row in csv.DictReader(f):
                if row["ticker"] in symbols:
                    yield tuple(make[k](row[c]) if row[c] != "" else None for c, k in columns)

    return fetch


class Request(InputPartition):
    def __init__(self, day: str, symbols: list[str]):
        self.day, self.symbols = day, symbols


class VendorReader(DataSourceReader):
    def __init__(self, kind: str, days: list[str], symbols: list[str], fetch: Callable):
        self.kind, self.days, self.symbols, self.fetch = kind, days, symbols, fetch

    def partitions(self) -> list[InputPartition]:
        return [Request(d, part) for d in self.days for part in chunked(self.symbols)]

    def read(self, partition: Request) -> Iterator[tuple]:
        yield from with_retry(lambda: list(self.fetch(self.kind, partition.day, partition.symbols)))


def source(fetch: Callable) -> type[DataSource]:
    """A data source over fetch, for ``spark.dataSource.register``."""

    class Vendor(DataSource):
        @classmethod
        def name(cls) -> str:
            return "vendor_market_data"

        def schema(self) -> str:
            return KINDS[self.options.get("kind", "bars")]

        def reader(self, schema) -> DataSourceReader:
            o = self.options
            return VendorReader(o.get("kind", "bars"), o.get("days", "").split(","), [s for s in o.get("symbols", "").split(",") if s], fetch)

    return Vendor


def read(spark: SparkSession, fetch: Callable, kind: str, days: Iterable[str], symbols: Iterable[str]) -> DataFrame:
    """Rows of a kind of the days and symbols; a replay is ``features.compute`` over the three kinds."""
    spark.dataSource.register(source(fetch))
    return spark.read.format("vendor_market_data").options(kind=kind, days=",".join(days), symbols=",".join(symbols)).load()
