"""Scalar functions of the batch operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of fund names, listing exchanges.
FUND_PATTERN = (
    r"(?i)\b(ETF|ETN|ProShares|Direxion|iShares|SPDR|Invesco|VanEck|Global X|WisdomTree|UltraPro|Ultra[- ]?Short|"
    r"Leveraged|Inverse|Index Fund|Income Fund|Exchange[- ]Traded|Bull|Bear|[1-3]X)\b"
)
EXCHANGES = ("NASDAQ", "NYSE", "AMEX", "ARCA", "BATS")


def is_fund(name: Column) -> Column:
    """Whether a name looks like a fund's; a null name doesn't."""
    return F.coalesce(name, F.lit("")).rlike(FUND_PATTERN)


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    """|a - b| <= atol + rtol |b|, missing on both sides being close and on one side not."""
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise((a == b) | near)


def shard_of(ticker: Column, n: int) -> Column:
    if n < 1:
        raise ValueError("at least one shard")
    return F.pmod(F.crc32(ticker.cast("binary")), F.lit(n)).cast("int")


def ratio(num: Column, den: Column) -> Column:
    """num / den where den is above 0, else NULL."""
    return F.when(den > 0, num / den)


def clean(x: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(x), x)


def path_name(symbol: Column) -> Column:
    return F.regexp_replace(symbol, "/", "_")


def parse_tickers(text: Column) -> Column:
    """Array of the comma-separated tickers, trimmed, upper-cased, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda s: F.upper(F.trim(s))), lambda s: s != "")
