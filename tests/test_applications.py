import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.helpers import DAY, MIN, OPEN_NS, bar, bars_df
from tickloom import applications
from tickloom.operators import harness, jobs, parity, stats
from tickloom.plans import features
from tickloom.sources import stores, vendor
from tickloom.streaming import sinks


def test_every_application_has_sql():
    assert set(applications.queries()) == set(applications.oracle_sql()) and set(applications.queries()) <= set(entry.queries())


def test_quantiles_of_histograms(spark):
    h = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 4), ("a", 4.0, 8), ("a", None, 8), ("b", 1.0, 0), ("b", 2.0, 0), ("b", 4.0, 0), ("b", None, 3), ("c", 1.0, 0), ("c", None, 0)], "k string, le double, n long")
    got = {r.k: r.value for r in stats.histogram_quantile(h, 0.75, ["k"]).collect()}
    assert got == {"a": 3.0, "b": 4.0}  # the unbounded bucket gives the highest bound; no values, no row


def test_costs_slowest_first(spark):
    s = spark.createDataFrame([("base", 1.0), ("x", 3.0), ("y", 9.0), ("z", 9.0)], "feature string, ns double")
    costs = stats.marginal_cost(s, "base", 5.0)
    assert [r.feature for r in stats.slowest_first(costs).collect()] == ["y", "z", "x"]
    r = stats.totals(costs).first()
    assert (r.features, r.own, r.all_within) == (3, 18.0, False) and stats.totals(costs.limit(0)).first().all_within


def test_chunks_and_hands(spark):
    df = spark.range(7).select(F.col("id").alias("i"))
    assert [r.chunk for r in stats.chunks(df, 3, ["i"]).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert [r.hand for r in stats.deal(df, 3, ["i"]).orderBy("i").collect()] == [0, 1, 2, 0, 1, 2, 0]
    for wrong in (stats.chunks, stats.deal):
        with pytest.raises(ValueError):
            wrong(df, 0, ["i"])


def test_unknown_tickers_yield_nothing_and_parity_of_some(spark):
    b = bars_df(spark, [bar(t, i, 100.0 + i) for t in ("AAA", "BBB") for i in range(4)])
    known = spark.createDataFrame([("AAA",), ("AAA",)], "ticker string")
    a = features.compute(b, groups=["returns"], universe=known)
    assert {r.ticker for r in a.collect()} == {"AAA"}
    full = features.compute(b, groups=["returns"])
    assert parity.summary(full, a, tickers=["AAA"]).first().only_a == 0 and parity.summary(full, a).first().only_a == 4


def test_custom_features_see_one_session_in_order(spark):
    rows = [bar("AAA", i, 100.0 + i) for i in (2, 0, 1)] + [bar("AAA", 0, 5.0, start=OPEN_NS + DAY)]
    out = features.compute_custom(bars_df(spark, rows), ["total"], lambda s: pd.DataFrame({"total": s["close"].cumsum()}))
    assert [r.total for r in out.orderBy("ts_ns").collect()] == [100.0, 201.0, 303.0, 5.0]
    with pytest.raises(ValueError):
        features.compute_custom(bars_df(spark, rows), [], lambda s: s)


def test_retries_back_off_and_give_up():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise vendor.VendorError("busy")
        return "rows"

    assert vendor.with_retry(flaky, wait=waits.append, seed=1) == "rows" and len(waits) == 3
    assert all(0.5 * 2**k <= w <= 1.5 * 2**k for k, w in enumerate(waits))
    with pytest.raises(vendor.VendorError):
        vendor.with_retry(lambda: (_ for _ in ()).throw(vendor.VendorError("down")), tries=2, wait=waits.append)
    with pytest.raises(KeyError):  # other errors aren't repeated
        vendor.with_retry(lambda: {}["x"], wait=waits.append)
    assert vendor.chunked("abcde", 2) == [["a", "b"], ["c", "d"], ["e"]]


def vendor_files(tmp_path):
    (tmp_path / "bars").mkdir()
    for day, start in (("2026-06-24", OPEN_NS), ("2026-06-25", OPEN_NS + DAY)):
        lines = ["ticker,ts_ns,open,high,low,close,volume,trade_count,vwap"] + [f"{t},{start + i * MIN},1,2,0.5,{1 + i},10,,1" for t in ("AAA", "BBB", "CCC") for i in range(3)]
        (tmp_path / "bars" / f"{day}.csv").write_text("\n".join(lines) + "\n")
    return vendor.from_files(str(tmp_path))


def test_vendor_rows_become_a_backfill_once(spark, tmp_path):
    from tickloom.session import ship_code

    ship_code(spark)
    days = ["2026-06-24", "2026-06-25", "2026-06-26"]
    rows = vendor.read(spark, vendor_files(tmp_path), "bars", days, ["AAA", "CCC"])
    assert rows.count() == 12 and rows.where("trade_count is null").count() == 12
    raw, store = stores.RawStore(spark, str(tmp_path / "raw")), stores.FeatureStore(spark, str(tmp_path / "features"))
    assert jobs.backfill_raw(raw, {"bars": rows}, days[:1]) == {"bars": 1}
    assert jobs.backfill_raw(raw, {"bars": rows}, days[:2]) == {"bars": 1} and jobs.backfill_raw(raw, {"bars": rows}, days[:2]) == {"bars": 0}
    jobs.backfill_features(raw, store)
    n = store.scan("backfill").count()
    jobs.backfill_features(raw, store)  # settled days are left alone
    assert n == 12 and spark.read.parquet(str(tmp_path / "features")).count() == 12
    jobs.backfill_features(raw, store, redo=True)
    assert store.scan("backfill").count() == 12 and spark.read.parquet(str(tmp_path / "features")).count() == 24


def test_universe_job(spark, tmp_path):
    assets = spark.createDataFrame([("AAA", "Alpha", "NYSE", True), ("BBB", "Beta ETF", "NYSE", True), ("C/C", "Gamma", "NYSE", True), ("DDD", "Delta", "OTC", True)], "symbol string, name string, exchange string, tradable boolean")
    daily = spark.createDataFrame([(s, "2026-06-01", 10.0, 2e6) for s in ("AAA", "BBB", "C/C", "DDD")], "symbol string, day string, close double, volume double").withColumn("day", F.col("day").cast("date"))
    assert [(r.rank, r.symbol) for r in jobs.build_universe(assets, daily, "2026-06-02", str(tmp_path / "u")).collect()] == [(1, "AAA")]


def test_the_latest_plain_write_wins(spark, tmp_path):
    store = stores.FeatureStore(spark, str(tmp_path))
    f = spark.createDataFrame([("AAA", OPEN_NS, 1.0)], "ticker string, ts_ns long, returns_r_1 double")
    for x in (1.0, 9.0, 2.0):
        store.write(f.withColumn("returns_r_1", F.lit(x)), "stream")
    assert [r.returns_r_1 for r in store.read(ordered=False).collect()] == [2.0]


def test_counted_writer_and_metrics(spark, tmp_path):
    f = features.compute(bars_df(spark, [bar("AAA", i, 100.0 + i) for i in range(5)]), groups=["returns"])
    w = sinks.CountedWriter(stores.FeatureStore(spark, str(tmp_path / "f")))
    w(f)
    assert (w.submitted, w.written, w.dropped) == (5, 5, 0)
    broken = sinks.CountedWriter(stores.FeatureStore(spark, str(tmp_path / "f")), source="nowhere", drop=True)
    broken(f)
    assert (broken.submitted, broken.written, broken.dropped) == (5, 0, 5)
    with pytest.raises(ValueError):
        sinks.CountedWriter(stores.FeatureStore(spark, str(tmp_path / "f")), source="nowhere")(f)
    metrics, source = sinks.Metrics(), str(tmp_path / "in")
    spark.createDataFrame([(0.01,), (0.2,), (40.0,), (None,)], "latency_s double").write.parquet(source)
    spark.streams.addListener(metrics)
    try:
        q = sinks.observed(spark.readStream.schema("latency_s double").parquet(source)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        for _ in range(100):
            if metrics.sums["rows"]:
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(metrics)
    assert metrics.sums["rows"] == 4
    assert [(r.le, r.n) for r in metrics.histogram(spark).collect()][::3] == [(0.05, 1), (0.5, 2), (5.0, 2), (None, 3)]


def test_harness_times_groups(spark, tmp_path):
    s = harness.measure(spark, ["candle"], minutes=20, rounds=1)
    assert sorted(r.feature for r in s.collect()) == ["candle", harness.BASELINE] and s.where("ns <= 0").count() == 0
    costs = harness.report(s, 1e12)
    assert "candle" in harness.table(costs)
    harness.dump_json(costs, str(tmp_path / "j"))
    line = next(p for p in (tmp_path / "j").iterdir() if p.suffix == ".json").read_text()
    assert json.loads(line)["feature"] == "candle"


def test_console_sink_prints_every_nth(spark, tmp_path, capfd):
    f = features.compute(bars_df(spark, [bar("AAA", i, 100.0 + i) for i in range(6)]), groups=["returns"])
    f.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sinks.console(spark.readStream.schema(f.schema).parquet(str(tmp_path / "in")), sample_every=3).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert capfd.readouterr().out.count("AAA") == 2


@pytest.fixture
def zero_prices(tmp_path):
    """A directory of events: two sessions of T1 with 40 bars, one of them closing at 0."""
    import duckdb

    duckdb.sql(
        "COPY (SELECT i AS event_id, 1::BIGINT AS user_id, TIMESTAMP '2024-01-10 15:00:00' + to_minutes(i % 40) + to_days(CAST(i // 40 AS INTEGER)) AS ts, 'click' AS event_type, "
        "CASE WHEN i = 20 THEN 0.0 ELSE 50 + (i * 37 % 23) / 10.0 END AS value, '{\"k\": 1}' AS props FROM range(80) t(i)) "
        f"TO '{tmp_path / 'events.parquet'}' (FORMAT parquet)"
    )
    return str(tmp_path)


def against_sql(spark, sf_dir, name):
    """Rows of the query and of its SQL, in one order."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf_dir}/events.parquet')")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    key = names.index("ts_ns")
    got = [tuple(r) for r in entry.queries()[name](spark, sf_dir).select(*names).collect()]
    return sorted(got, key=lambda r: r[key]), sorted(want.fetchall(), key=lambda r: r[key])


@pytest.mark.parametrize("name", ["f_rvol", "f_vol", "feature_vector_full", "session_starts", "shard_invariance"])
def test_a_bar_that_closes_at_zero_agrees_with_sql(spark, zero_prices, name):
    got, want = against_sql(spark, zero_prices, name)
    assert got == want and len(got) == (2 if name == "session_starts" else 80)


def test_near_ties_round_as_in_sql(spark):
    import duckdb

    from tickloom import catalog

    values = [59.93 / 6.4 - 1, 59.23 / 6.4 - 1, -(59.93 / 6.4 - 1), 52.2260155, 0.0000005, -0.0000004, 1e300, 123456.789, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double")
    want = [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert [r.x for r in catalog.rounded(df, ["x"]).orderBy("i").collect()] == want
