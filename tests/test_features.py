import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.helpers import DAY, MIN, OPEN_NS, bar, bars_df, by_minute
from tickloom.functions import clock, kernels
from tickloom.plans import features, tape
from tickloom.schema import FEATURES, QUOTES, TICK_GROUPS, TRADES
from tickloom.sources.simulation import Simulation, simulate

BAR_GROUPS = [g for g in features.REGISTRY if g not in TICK_GROUPS]


def test_catalog_has_the_columns_in_order():
    assert len(features.REGISTRY) == 23 and len(FEATURES) == 65
    with pytest.raises(ValueError):
        features.register(features.FeatureGroup("", ("x",), lambda: {}))


def test_hand_computed_returns_and_candle(spark):
    rows = [bar("AAA", i, c) for i, c in enumerate([100.0, 101.0, 102.0, 100.0])] + [bar("AAA", 4, 104.0, open=100.0, high=106.0, low=99.0)]
    got = by_minute(features.compute(bars_df(spark, rows), groups=["returns", "candle", "rsi", "gap"]))
    assert got[3].returns_r_1 == pytest.approx(100 / 102 - 1) and got[3].returns_r_2 == pytest.approx(100 / 101 - 1)
    assert got[3].returns_r_5 is None and got[0].rsi_rsi_14 is None and got[1].rsi_rsi_14 == 100
    assert (got[4].candle_body, got[4].candle_upper_wick, got[4].candle_lower_wick) == pytest.approx((4 / 7, 2 / 7, 1 / 7))
    assert got[3].candle_body == pytest.approx(1.0) or got[3].candle_body == 0


def walk(n, seed=5):
    rng = random.Random(seed)
    x, out = 100.0, []
    for _ in range(n):
        x *= math.exp(rng.gauss(0, 0.002))
        out.append(x)
    return out


def test_bar_groups_match_pandas(spark):
    closes = walk(70)
    rng = random.Random(2)
    rows = [bar("AAA", i, c, open=c * (1 + rng.uniform(-1, 1) / 500), volume=float(rng.randint(100, 900)), trade_count=rng.randint(1, 60)) for i, c in enumerate(closes)]
    got = by_minute(features.compute(bars_df(spark, rows), groups=BAR_GROUPS))
    c = pd.Series(closes)
    r1 = c.pct_change()
    v = pd.Series([r[6] for r in rows])
    delta = c.diff()[1:]
    gain, loss = (delta.clip(lower=0).ewm(span=27, adjust=False).mean(), (-delta).clip(lower=0).ewm(span=27, adjust=False).mean())
    macd = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    want = {
        "ema_ema_9": c.ewm(span=9, adjust=False).mean(), "macd_signal": macd.ewm(span=9, adjust=False).mean(), "vol_std_5": r1.rolling(5, min_periods=2).std(ddof=0),
        "rvol_rv_15": (r1**2).rolling(15, min_periods=1).sum() ** 0.5, "volprofile_vol_z": (v - v.rolling(20, min_periods=2).mean()) / v.rolling(20, min_periods=2).std(ddof=0),
        "rsi_rsi_14": 100 - 100 / (1 + gain / loss), "boll_bandwidth": 4 * c.rolling(20).std(ddof=0) / c.rolling(20).mean(),
    }
    for name, series in want.items():
        for i in range(30, 70):
            assert getattr(got[i], name) == pytest.approx(series[i], rel=1e-9), (name, i)
    assert got[18].boll_pct_b is None and got[19].boll_pct_b is not None


def test_exponential_mean_of_a_long_sequence(spark):
    x = np.random.default_rng(1).normal(100, 5, 5000)
    x[[0, 7, 2500]] = np.nan
    df = spark.createDataFrame([("a", i, None if math.isnan(v) else float(v)) for i, v in enumerate(x)], "k string, i long, x double")
    df = kernels.with_chunks(df, "x", ["k"], ["i"], "chunk")
    df = kernels.with_ewma(df, {"e9": ("x", 9), "e50": ("x", 50)}, ["k"], ["i"], "chunk")
    got = df.orderBy("i").toPandas()
    for span in (9, 50):
        want = pd.Series(x).dropna().ewm(span=span, adjust=False).mean().reindex(range(5000)).ffill()
        assert np.nanmax(np.abs(got[f"e{span}"] / want - 1)) < 1e-11
    assert math.isnan(got.e9[0])
    with pytest.raises(ValueError):
        kernels.with_ewma(df, {"e": ("x", 0)}, ["k"], ["i"], "chunk")
    with pytest.raises(ValueError):
        kernels.last_n(Window.orderBy("i"), 0)


def test_values_are_counted_not_rows(spark):
    df = spark.createDataFrame([("a", i, float(i) if i % 3 else None) for i in range(20)], "k string, i long, x double")
    df = kernels.pushes(df, "x", ["k"], ["i"], "n")
    got = [r.s for r in df.withColumn("s", F.sum("x").over(kernels.by_pushes(["k"], "n", 3))).orderBy("i").collect()]
    x = [float(i) if i % 3 else None for i in range(20)]
    assert got == [sum([v for v in x[: i + 1] if v is not None][-3:]) or None for i in range(20)]


def test_ticks_roll_to_the_next_bar(spark):
    s = OPEN_NS
    bars = bars_df(spark, [bar("AAA", 0, 10.0), bar("AAA", 3, 11.0), bar("AAA", 4, 12.0)])
    trades = spark.createDataFrame(
        [("AAA", s + 5, 10.0, 2.0), ("AAA", s + MIN + 5, 10.5, 4.0), ("AAA", s + 3 * MIN + 5, 9.0, 6.0), ("AAA", s + 5 * MIN, 9.0, 50.0)], TRADES
    )
    quotes = spark.createDataFrame([("AAA", s + 3 * MIN + 5, 9.9, 10.1, 3.0, 1.0), ("AAA", s + 3 * MIN + 9, 12.0, 10.0, 0.0, 0.0)], QUOTES)
    got = by_minute(features.compute(bars, trades, quotes, ["tradeflow", "trademicro", "flowfreq", "quotespread", "quotemicro"]))
    assert got[0].trademicro_n_trades == 1 and got[0].tradeflow_ofi_1m == 1.0  # no quote yet: a buy
    assert got[3].trademicro_n_trades == 2 and got[3].tradeflow_ofi_1m == pytest.approx((4 - 6) / 10)  # the quote of that instant comes first
    assert got[3].trademicro_top_size_frac == pytest.approx(0.6)
    assert got[4].trademicro_n_trades == 0 and got[4].trademicro_avg_size is None and got[4].tradeflow_ofi_session == pytest.approx((2 + 4 - 6) / 12)
    assert got[3].quotespread_spread_bps < 0 and got[3].quotespread_imbalance is None  # crossed and empty, still the latest
    assert got[0].quotemicro_n_quotes == 0 and got[3].quotemicro_n_quotes == 2 and got[3].quotemicro_spread_range_bps > 0
    assert got[4].flowfreq_trade_quote_ratio is None


def test_bars_alone_have_no_tick_features(spark):
    got = by_minute(features.compute(bars_df(spark, [bar("AAA", i, c) for i, c in enumerate(walk(5))])))
    assert got[4].trademicro_n_trades == 0 and got[4].quotemicro_n_quotes == 0 and got[4].tradeflow_ofi_session is None


@pytest.fixture(scope="module")
def market(spark):
    data = tuple(df.cache() for df in simulate(spark, Simulation(tickers=("AAA", "BBB", "CCC"), minutes=45, seed=11)))
    full = {(r.ticker, r.ts_ns): r for r in features.compute(*data, order="arrival").collect()}
    return data, full


def test_one_vector_a_bar_and_warm_in_the_end(market):
    _, full = market
    assert len(full) == 3 * 45
    last = max(t for _, t in full)
    assert sum(v is None for v in full["AAA", last]) <= 4


@pytest.mark.parametrize("cut", [10, 25])
def test_no_look_ahead(spark, market, cut):
    (bars, trades, quotes), full = market
    end = Simulation().start_ns + cut * MIN
    part = features.compute(*(df.where(F.col("ts_ns") < end) for df in (bars, trades, quotes)), order="arrival").collect()
    assert len(part) == 3 * cut
    for r in part:
        assert all(a == pytest.approx(b) if a is not None else b is None for a, b in zip(r[2:], full[r.ticker, r.ts_ns][2:]))


def test_partitions_do_not_matter(spark, market):
    (bars, trades, quotes), full = market
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        for r in features.compute(bars.repartition(5), trades.repartition(3), quotes.coalesce(1), order="arrival").collect():
            assert all(a == pytest.approx(b) if a is not None else b is None for a, b in zip(r[2:], full[r.ticker, r.ts_ns][2:]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_day_starts_afresh(spark):
    one, two = walk(30, 1), walk(30, 2)
    second = [bar("AAA", i, c, start=OPEN_NS + DAY) for i, c in enumerate(two)]
    both = features.compute(bars_df(spark, [bar("AAA", i, c) for i, c in enumerate(one)] + second), groups=BAR_GROUPS)
    alone = {r.ts_ns: r for r in features.compute(bars_df(spark, second), groups=BAR_GROUPS).collect()}
    got = [r for r in both.collect() if r.ts_ns >= OPEN_NS + DAY]
    assert len(got) == 30 and all(tuple(r) == pytest.approx(tuple(alone[r.ts_ns]), nan_ok=True) if None not in r else [x is None for x in r] == [x is None for x in alone[r.ts_ns]] for r in got)


def test_one_exchange_serves_all_windows(spark):
    df = features.compute(bars_df(spark, [bar("AAA", i, c) for i, c in enumerate(walk(5))]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_flat_prices_and_bad_values(spark):
    rows = [bar("AAA", i, 50.0, volume=0.0) for i in range(25)] + [("AAA", OPEN_NS + 25 * MIN, float("nan"), 1.0, -1.0, 0.0, 5.0, 1, 0.0), bar("AAA", 26, 51.0)]
    got = by_minute(features.compute(bars_df(spark, rows), groups=BAR_GROUPS))
    assert (got[24].candle_body, got[24].sessionrange_pos, got[24].rollrange_pos_15) == (0.0, 0.5, 0.5)
    assert (got[24].boll_pct_b, got[24].boll_bandwidth, got[24].rsi_rsi_14, got[24].vwap_level) == (0.5, 0.0, 50.0, None)
    assert got[24].volprofile_vol_z is None and got[26].returns_r_1 is None
    assert got[26].vol_std_5 == pytest.approx(0.4)  # the move to zero is the last one pushed


def test_clock_knows_daylight_saving(spark):
    days = spark.createDataFrame([("2026-03-08",), ("2026-11-01",), ("2026-06-24",)], "d string").select(F.col("d").cast("date").alias("d"))
    a, z = clock.day_bounds(F.col("d"))
    hours = {str(r.d): (r.z - r.a) / 3.6e12 for r in days.select("d", a.alias("a"), z.alias("z")).collect()}
    assert hours == {"2026-03-08": 23, "2026-11-01": 25, "2026-06-24": 24}
    r = spark.range(1).select(clock.minute_of_day(F.lit(OPEN_NS)).alias("m"), clock.session_date(F.lit(OPEN_NS)).cast("string").alias("d")).first()
    assert (r.m, r.d) == (570, "2026-06-24")


def test_tape_order_and_modes(spark):
    bars = bars_df(spark, [bar("AAA", 0, 1.0), bar("AAA", 1, 1.0)])
    trades = spark.createDataFrame([("AAA", OPEN_NS + 1000, 1.0, 1.0), ("AAA", OPEN_NS + MIN + 1000, 1.0, 1.0)], TRADES)
    quotes = spark.createDataFrame([("AAA", OPEN_NS + 500, 1.0, 1.0, 1.0, 1.0), ("AAA", OPEN_NS + 1000, 1.0, 1.0, 1.0, 1.0)], QUOTES)
    rows = tape.build(bars, trades, quotes).orderBy(*tape.order_columns()).collect()
    assert [r.kind for r in rows] == ["quote", "quote", "trade", "bar", "trade", "bar"]
    with pytest.raises(ValueError):
        tape.order_columns("other")
