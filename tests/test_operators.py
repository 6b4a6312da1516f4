import glob
import os
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.helpers import MIN, OPEN_NS, bar, bars_df
from tickloom import catalog
from tickloom.functions import scalars
from tickloom.operators import jobs, parity, stats, universe
from tickloom.plans import features
from tickloom.sources import adapters, stores
from tickloom.streaming import live

SF = "/root/testdata/sf0.001"


def test_universe_thresholds_and_ties(spark):
    s = spark.createDataFrame([("AAA", 10.0, 5e7), ("BBB", 4.0, 9.9e7), ("CCC", 20.0, 5e6), ("DDD", 30.0, 8e7)], "symbol string, price double, adv_dollar double")
    assert [(r.rank, r.symbol) for r in universe.select(s).orderBy("rank").collect()] == [(1, "DDD"), (2, "AAA")]
    t = spark.createDataFrame([(x, 10.0, 2e7) for x in ("ZZZ", "AAA", "MMM")], "symbol string, price double, adv_dollar double")
    assert [r.symbol for r in universe.select(t, max_symbols=2).orderBy("rank").collect()] == ["AAA", "MMM"]


def test_fund_names(spark):
    names = ["SPDR S&P 500 ETF", "ProShares UltraPro QQQ", "Direxion Daily Bull 3X", "Apple Inc.", "Bullfrog Corp", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.f for r in df.select(scalars.is_fund(F.col("n")).alias("f")).collect()] == [True, True, True, False, False, False]


def test_universe_round_trip(spark, tmp_path):
    s = spark.createDataFrame([("AAA", 10.0, 5e7)], "symbol string, price double, adv_dollar double")
    with pytest.raises(FileNotFoundError):
        universe.latest(spark, str(tmp_path / "none"))
    root = str(tmp_path / "u")
    universe.write(universe.select(s), root, "2026-06-01")
    universe.write(universe.select(s), root, "2026-06-02")
    assert [(r.symbol, r.trade_date) for r in universe.latest(spark, root).collect()] == [("AAA", "2026-06-02")]


def test_parity_finds_the_perturbed_feature(spark):
    a = features.compute(bars_df(spark, [bar("AAA", i, 100 + 0.1 * (i % 7)) for i in range(20)]), groups=["rsi", "returns"])
    b = a.withColumn("rsi_rsi_14", F.col("rsi_rsi_14") + 5)
    assert parity.summary(a, a).first().mismatches == 0
    assert parity.worst(a, b).first().feature == "rsi_rsi_14"
    assert parity.summary(a, b.limit(0)).first().match_pct is None
    with pytest.raises(ValueError):
        parity.cells(a, b.drop("rsi_rsi_14"))


def test_retention_counts_and_dry_run(spark, tmp_path):
    for kind in jobs.KEEP_DAYS:
        for d in ("2025-06-01", "2026-05-20", "2026-06-20"):
            os.makedirs(tmp_path / kind / f"date={d}")
    want = {"quotes": 2, "trades": 1, "bars": 1}
    assert jobs.prune(spark, str(tmp_path), date(2026, 6, 26), dry_run=True) == want
    assert len(glob.glob(str(tmp_path / "*" / "*"))) == 9
    assert jobs.prune(spark, str(tmp_path), "2026-06-26") == want
    assert len(glob.glob(str(tmp_path / "*" / "*"))) == 5


def test_job_lists(spark):
    days = jobs.trading_days(spark, "2026-06-19", "2026-06-23")
    assert [str(r.day) for r in days.orderBy("day").collect()] == ["2026-06-19", "2026-06-22", "2026-06-23"]
    tickers = spark.createDataFrame([("A",), ("B",)], "ticker string")
    have = spark.createDataFrame([(date(2026, 6, 22), "A")], "day date, ticker string")
    assert jobs.missing_jobs(days, tickers, have).count() == 5
    assert jobs.ready_jobs(tickers.crossJoin(days), have).count() == 1


def test_distributions_and_histograms(spark):
    df = spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "x double")
    r = stats.distribution(df, "x").first()
    assert (r.n, r.mean, r.max, r.p50) == (4, 25.0, 40.0, 25.0) and r.p90 == pytest.approx(37.0)
    assert [(x.le, x.n) for x in stats.histogram(df, "x", (15.0, 35.0)).collect()] == [(15.0, 1), (35.0, 3), (None, 4)]
    lat = spark.createDataFrame([("base", 1.0), ("base", 3.0), ("f", 7.0)], "feature string, ns double")
    r = stats.marginal_cost(lat, "base", 10.0).first()
    assert (r.own, r.within) == (5.0, True)


def test_coverage_of_days_with_gaps(spark):
    rows = [("2026-06-22", "A"), ("2026-06-22", "B"), ("2026-06-22", "C"), ("2026-06-23", "B"), ("2026-06-23", "B"), ("2026-06-24", "A"), ("2026-06-24", "C")]
    got = stats.coverage(spark.createDataFrame(rows, "date string, ticker string")).collect()
    assert [(r.date, r.tickers, r.level) for r in got] == [("2026-06-24", 2, 170), ("2026-06-23", 1, 85), ("2026-06-22", 3, 255)]
    assert stats.coverage(spark.createDataFrame([], "date string, ticker string")).count() == 0


def test_shards_are_stable_and_cover(spark):
    import zlib

    df = spark.createDataFrame([(f"T{i}",) for i in range(50)], "ticker string")
    assert all(r.shard == zlib.crc32(r.ticker.encode()) % 4 for r in stats.shards(df, 4).collect())
    with pytest.raises(ValueError):
        scalars.shard_of(F.lit("A"), 0)


def test_raw_store_round_trip(spark, tmp_path):
    raw = stores.RawStore(spark, str(tmp_path))
    raw.write("bars", bars_df(spark, [bar("A/B", i, 1.0 + i) for i in range(3)] + [bar("C", 0, 5.0)]))
    assert raw.read("bars", ["2026-06-24"], ["A/B"]).count() == 3 and raw.has("bars", "2026-06-24", "C")
    assert [r.date for r in raw.days().collect()] == ["2026-06-24"] and [r.ticker for r in raw.tickers("2026-06-24").collect()] == ["A/B", "C"]
    assert raw.read("quotes").count() == 0
    bars, trades, quotes = raw.replay(with_ticks=False)
    assert trades is None and features.compute(bars, groups=["returns"]).count() == 4


def test_feature_store_merges_and_dedupes(spark, tmp_path):
    f = features.compute(bars_df(spark, [bar("AAA", i, 100.0 + i) for i in range(4)]), groups=["returns"])
    store = stores.FeatureStore(spark, str(tmp_path))
    assert store.read().count() == 0
    store.write(f, "stream", 1)
    store.write(f.withColumn("returns_r_1", F.lit(7.0)), "stream", 2)
    store.write(f.limit(0).unionByName(f.where(F.col("ts_ns") == OPEN_NS + MIN)).withColumn("returns_r_1", F.lit(42.0)), "backfill", 1)
    got = {(r.ts_ns - OPEN_NS) // MIN: r.returns_r_1 for r in store.read(names=["returns_r_1", "nope"]).collect()}
    assert got == {0: 7.0, 1: 42.0, 2: 7.0, 3: 7.0}
    assert [r.ts_ns for r in store.read(OPEN_NS + MIN, OPEN_NS + 3 * MIN).collect()] == [OPEN_NS + MIN, OPEN_NS + 2 * MIN]
    assert [r.date for r in store.settled_dates().collect()] == ["2026-06-24"]
    with pytest.raises(ValueError):
        store.write(f, "other")
    with pytest.raises(ValueError):
        store.read(source="other")


def test_vendor_rows(spark):
    raw = spark.sql("select 'A' symbol, timestamp'2026-06-24 13:30:00' timestamp, 1 open, 2 high, 0.5 low, 1.5 close, 10 volume, cast(null as int) trade_count, cast(null as double) vwap")
    r = adapters.vendor_bars(raw).first()
    assert (r.ts_ns, r.trade_count, r.vwap) == (OPEN_NS, 0, 1.5)
    assert spark.range(1).select(scalars.parse_tickers(F.lit(" aapl, ,msft ")).alias("t")).first().t == ["AAPL", "MSFT"]


def test_stream_agrees_with_the_batch(spark, tmp_path):
    from tickloom.schema import BARS

    rows = [bar(t, i, 100 + (i * 7) % 5 + i / 10) for t in ("AAA", "BBB") for i in range(12)]
    source = str(tmp_path / "in")
    for k in range(3):
        bars_df(spark, [r for r in rows if (r[1] - OPEN_NS) // MIN // 4 == k]).coalesce(1).write.mode("append").parquet(source)
    raw, store = stores.RawStore(spark, str(tmp_path / "raw")), stores.FeatureStore(spark, str(tmp_path / "features"))
    stream = spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(source)
    live.run_live(stream, raw, store, str(tmp_path / "ck")).awaitTermination()
    got = {(r.ticker, r.ts_ns): r for r in store.read().collect()}
    want = features.compute(bars_df(spark, rows)).collect()
    assert len(got) == len(want) == 24
    for r in want:
        mine = got[r.ticker, r.ts_ns]
        assert all((mine[c] is None) if r[c] is None else mine[c] == pytest.approx(r[c]) for c in r.asDict())


def test_stream_with_ticks_agrees_with_the_batch(spark, tmp_path):
    from tickloom.schema import BARS, QUOTES, TRADES
    from tickloom.sources.simulation import Simulation, simulate

    frames = dict(zip(("bars", "trades", "quotes"), simulate(spark, Simulation(minutes=9))))
    schemas, streams = {"bars": BARS, "trades": TRADES, "quotes": QUOTES}, {}
    for kind, schema in schemas.items():
        frames[kind] = spark.createDataFrame(frames[kind].drop("seq").collect(), schema)
        late = 1 if kind == "trades" else 0  # trades come a batch after their bars; one trade comes twice
        for k in range(3):
            rows = frames[kind].where(F.floor((F.col("ts_ns") - OPEN_NS) / MIN / 3) == k - late)
            rows.coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
        if late:
            rows = frames[kind].where(F.col("ts_ns") >= OPEN_NS + 6 * MIN)
            twice = rows.unionByName(rows.limit(1))
            twice.coalesce(1).write.mode("append").parquet(str(tmp_path / kind))
            frames[kind] = spark.createDataFrame([*frames[kind].collect(), *rows.limit(1).collect()], schema)
        streams[kind] = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / kind))
    raw, store = stores.RawStore(spark, str(tmp_path / "raw")), stores.FeatureStore(spark, str(tmp_path / "features"))
    live.run_live(streams["bars"], raw, store, str(tmp_path / "ck"), trades=streams["trades"], quotes=streams["quotes"]).awaitTermination()
    for kind in schemas:
        assert sorted(raw.read(kind).drop("date").collect()) == sorted(frames[kind].collect())
    again = frames["trades"].limit(2).withColumn("kind", F.lit("trades"))
    for _ in range(2):  # a batch that runs again
        live.apply_batch(again, 9, raw, store, "r")
    assert raw.read("trades").count() == frames["trades"].count() + 2
    more = spark.createDataFrame([*frames["trades"].collect(), *frames["trades"].limit(2).collect()], TRADES)
    got = {(r.ticker, r.ts_ns): r for r in store.read().collect()}
    want = features.compute(frames["bars"], more, frames["quotes"]).collect()
    assert len(got) == len(want) == 18 and all(r.trademicro_n_trades and r.quotemicro_n_quotes for r in want)
    for r in want:
        mine = got[r.ticker, r.ts_ns]
        assert all((mine[c] is None) if r[c] is None else mine[c] == pytest.approx(r[c]) for c in r.asDict())


def test_streamed_bars(spark, tmp_path):
    from tickloom.schema import TRADES

    t = spark.createDataFrame([("A", OPEN_NS + 10, 1.0, 2.0), ("A", OPEN_NS + 20, 3.0, 2.0), ("A", OPEN_NS + 10 * MIN, 9.0, 1.0)], TRADES)
    t.coalesce(1).write.parquet(str(tmp_path / "t"))
    q = live.build_bars(spark.readStream.schema(TRADES).parquet(str(tmp_path / "t"))).writeStream.format("memory").queryName("bars_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("bars_out").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.vwap) for r in rows] == [(1.0, 3.0, 1.0, 3.0, 4.0, 2.0)]


def test_entry_and_registry():
    core = catalog.queries()
    assert set(core) == set(catalog.oracle_sql())
    assert set(core) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def norm(v):
    return None if v is None or v != v else round(float(v), 5) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["feature_vector_full", "tape_order", "tick_to_bar", "parity_summary", "universe_adv", "merge_backfill_over_stream", "histogram_buckets", "coverage_matrix"])
def test_queries_match_duckdb(spark, name):
    df = catalog.queries()[name](spark, SF)
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    cur = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(norm(v) for v in r) for r in cur.fetchall()), key=str)
    assert sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=str) == want
