"""Builders of small market data."""

OPEN_NS = 1_782_307_800_000_000_000  # 2026-06-24 09:30 in New York
MIN = 60_000_000_000
DAY = 86_400_000_000_000


def bar(ticker, minute, close, open=None, high=None, low=None, volume=1000.0, trade_count=50, start=OPEN_NS):
    o = close if open is None else open
    return (ticker, start + minute * MIN, o, max(o, close) if high is None else high, min(o, close) if low is None else low, close, volume, trade_count, close)


def bars_df(spark, rows):
    from tickloom.schema import BARS

    return spark.createDataFrame(rows, BARS)


def by_minute(df, ticker="AAA", start=OPEN_NS):
    return {(r.ts_ns - start) // MIN: r for r in df.where(df.ticker == ticker).collect()}
