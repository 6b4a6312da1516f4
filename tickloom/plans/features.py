"""The 23 feature groups as window expressions over the bars of a session.

``bar_table`` folds the tape into one row a bar with the tick aggregates; ``compute`` adds the groups.  All windows share
the keys (ticker, session_date) and the order bar_idx: one exchange and one sort serve them all, and a group that isn't
asked for is pruned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions import clock, kernels
from tickloom.functions.kernels import last_n, rolling_max, rolling_mean, rolling_min, rolling_std, rolling_sum, so_far
from tickloom.functions.scalars import clean, ratio
from tickloom.plans import tape as tapes
from tickloom.schema import FEATURES, GROUPS, VERSION, columns_of

KEYS = tapes.KEYS
PRICES = ("open", "high", "low", "close", "volume", "vwap")
#: Spans of exponential means at bar and quote grain.
EMA_SPANS, SIGNAL_SPAN, RSI_SPAN, QUOTE_SPAN = (9, 12, 26, 50), 9, 27, 50


def _sane(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({c: clean(F.col(c)) for c in names if c in df.columns})


def bar_table(bars: DataFrame, trades: DataFrame | None, quotes: DataFrame | None, order: str = "replay") -> DataFrame:
    """One row a bar: its fields, bar_idx, and the aggregates of the ticks that it consumes.

    Two rounds of windows share the order of the tape; the exponential mean takes one more sort, the bars none.
    """
    cols = tapes.order_columns(order)
    whole = Window.partitionBy(*KEYS).orderBy(*cols)
    past, upto = whole.rowsBetween(Window.unboundedPreceding, -1), so_far(whole)
    trade, quote, at_bar = (F.col("kind") == k for k in ("trade", "quote", "bar"))
    mid = (F.col("bid") + F.col("ask")) / 2
    valid = quote & (mid > 0)
    depth = F.col("bid_size") + F.col("ask_size")
    t = tapes.build(_sane(bars, PRICES), _sane(trades, ("price", "size")) if trades is not None else None, quotes)
    t = t.withColumns({
        "_spread": F.when(valid, (F.col("ask") - F.col("bid")) / mid * 1e4),
        "_imb": F.when(valid, F.coalesce(F.when(depth > 0, (F.col("bid_size") - F.col("ask_size")) / depth), F.lit(0.0))),
    })
    t = t.withColumns({
        "bar_idx": F.coalesce(F.sum("is_bar").over(past), F.lit(0)),
        "_q": F.last(F.when(quote, F.struct(mid.alias("mid"), "bid", "ask", "bid_size", "ask_size")), ignorenulls=True).over(upto),
        "_spreads": F.count("_spread").over(upto), "_closes": F.count(F.when(at_bar, F.col("close"))).over(upto),
    })
    now = F.when(valid, F.struct("ts_ns", "_spread", "_imb", "bar_idx"))
    t = t.withColumns({
        "_last": F.last(now, ignorenulls=True).over(upto), "_earlier": F.last(now, ignorenulls=True).over(past),
        "_quote_chunk": kernels.chunk_of(F.col("_spreads")), "chunk": kernels.chunk_of(F.col("_closes")),
    })
    t = kernels.with_ewma(t, {"_spread_ewma": ("_spread", QUOTE_SPAN)}, KEYS, cols, "_quote_chunk")
    same = valid & (F.col("_earlier.bar_idx") == F.col("bar_idx"))
    gap = F.when(same, F.greatest(F.col("ts_ns") - F.col("_earlier.ts_ns"), F.lit(0)).cast("double"))
    sign = F.when(F.col("_q.mid").isNull() | (F.col("price") >= F.col("_q.mid")), 1.0).otherwise(-1.0)

    def of_bar(c):
        return F.max(F.when(at_bar, F.col(c)))

    out = t.groupBy(*KEYS, "bar_idx").agg(
        of_bar("ts_ns").alias("ts_ns"), *(of_bar(c).alias(c) for c in (*PRICES, "trade_count", "chunk")),
        F.count(F.when(trade, 1)).alias("n_trades"), F.sum(F.when(trade, F.col("size"))).alias("size"),
        F.sum(F.when(trade, F.col("price") * F.col("size"))).alias("notional"),
        F.sum(F.when(trade, sign * F.col("size"))).alias("signed"), F.max(F.when(trade, F.col("size"))).alias("top"),
        F.count(F.when(quote, 1)).alias("n_all_quotes"), F.count("_spread").alias("n_quotes"),
        F.min("_spread").alias("min_spread"), F.max("_spread").alias("max_spread"),
        F.sum(F.col("_earlier._spread") * gap).alias("spread_time"), F.sum(F.col("_earlier._imb") * gap).alias("imb_time"), F.sum(gap).alias("time"),
        # the last valid quote of a session up to its bar is the bar's own one, if it has any
        of_bar("_last._spread").alias("_last_spread"), of_bar("_last._imb").alias("end_imb"), of_bar("_spread_ewma").alias("_spread_ewma"),
        *(of_bar(f"_q.{c}").alias(f"q_{c}") for c in ("mid", "bid", "ask", "bid_size", "ask_size")),
    )
    return out.where(F.col("ts_ns").isNotNull()).withColumn("end_spread", F.col("_last_spread"))


def _w() -> WindowSpec:
    return Window.partitionBy(*KEYS).orderBy("chunk", "bar_idx")


def _change(now: Column, past: Column) -> Column:
    return F.when(past > 0, now / past - 1)


def _z(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (x - mean) / std)


def _close():
    return F.col("close")


def _past(n: int) -> Column:
    return F.lag("close", n).over(_w())


def _returns_rolls():
    return {f"_p{n}": _past(n) for n in (1, 2, 5, 15, 30)}


def _returns():
    return {f"returns_r_{n}": _change(_close(), F.col(f"_p{n}")) for n in (1, 2, 5, 15, 30)}


def _ema():
    return {f"ema_dist_{n}": _change(_close(), F.col(f"ema_ema_{n}")) for n in (9, 50)}


def _macd_pre():
    return {"macd_macd": F.col("_fast") - F.col("_slow")}


def _macd():
    return {"macd_hist": F.col("macd_macd") - F.col("macd_signal")}


def _momentum_rolls():
    return {"_p10": _past(10), "_pr1": F.lag("_r1").over(_w())}


def _momentum():
    return {"momentum_roc_10": _change(_close(), F.col("_p10")), "momentum_accel": F.col("_r1") - F.col("_pr1")}


def _gap_rolls():
    return {"_o0": F.first("open", ignorenulls=True).over(so_far(_w())), "_top": F.max("high").over(so_far(_w()))}


def _gap():
    return {"gap_from_open": _change(_close(), F.col("_o0")), "gap_high_from_open": _change(F.col("_top"), F.col("_o0"))}


def _candle():
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    span = h - low

    def part(x):
        return F.when(span > 0, x / span).otherwise(F.when(span.isNotNull(), 0.0))

    return {"candle_body": part(F.abs(c - o)), "candle_upper_wick": part(h - F.greatest(o, c)), "candle_lower_wick": part(F.least(o, c) - low)}


def _sessionrange_rolls():
    return {"_top": F.max("high").over(so_far(_w())), "_bottom": F.min("low").over(so_far(_w()))}


def _sessionrange():
    top, bottom = F.col("_top"), F.col("_bottom")
    span = top - bottom
    pct = F.when(span > 0, F.when(bottom > 0, span / bottom)).otherwise(0.0)
    return {"sessionrange_pos": F.when(span > 0, (_close() - bottom) / span).otherwise(0.5), "sessionrange_range_pct": pct}


def _rollrange_rolls():
    tops = {f"_top{n}": rolling_max(F.col("high"), _w(), n) for n in (15, 60)}
    return tops | {f"_bottom{n}": rolling_min(F.col("low"), _w(), n) for n in (15, 60)}


def _rollrange():
    out = {}
    for n in (15, 60):
        top, bottom = F.col(f"_top{n}"), F.col(f"_bottom{n}")
        out[f"rollrange_pos_{n}"] = F.when(top - bottom > 0, (_close() - bottom) / (top - bottom)).otherwise(0.5)
    return out


def _last_pre():
    return {"_last": _past(1)}


def _rsi_moves():
    move = _close() - F.col("_last")
    return {"_gain": F.when(move.isNotNull(), F.greatest(move, F.lit(0.0))), "_loss": F.when(move.isNotNull(), F.greatest(-move, F.lit(0.0)))}


def _rsi():
    g, loss = F.col("_g"), F.col("_l")
    return {"rsi_rsi_14": F.when(loss > 0, 100 - 100 / (1 + g / loss)).when(g > 0, 100.0).when(g.isNotNull(), 50.0)}


def _sessionclock():
    minute = clock.minute_of_day(F.col("ts_ns"))
    since = (minute - clock.OPEN_MINUTE).cast("double")
    return {
        "sessionclock_since_open": since, "sessionclock_to_close": (F.lit(clock.CLOSE_MINUTE) - minute).cast("double"),
        "sessionclock_progress": since / float(clock.CLOSE_MINUTE - clock.OPEN_MINUTE),
    }


def _r1_pre():
    return {"_r1": _change(_close(), F.col("_last"))}


def _seq_pre():
    return {"_seq": F.count("_r1").over(so_far(_w()))}


def _vol():
    out = {}
    for n in (5, 15, 30):
        w = kernels.by_pushes(KEYS, "_seq", n)
        out[f"vol_std_{n}"] = F.when(F.count("_r1").over(w) >= 2, F.stddev_pop("_r1").over(w))
    return out


def _rvol():
    return {f"rvol_rv_{n}": F.sqrt(F.sum(F.col("_r1") * F.col("_r1")).over(kernels.by_pushes(KEYS, "_seq", n))) for n in (5, 15, 30)}


def _atr_pre():
    h, low, past = F.col("high"), F.col("low"), F.col("_last")
    return {"_tr": F.greatest(h - low, F.abs(h - past), F.abs(low - past))}


def _atr():
    return {f"atr_atr_{n}": rolling_mean(F.col("_tr"), _w(), n) for n in (5, 14)}


def _boll_rolls():
    f = last_n(_w(), 20)
    return {"_c20": F.avg("close").over(f), "_s20": F.stddev_pop("close").over(f), "_n20": F.count("close").over(f)}


def _boll():
    c, mean, std, warm = _close(), F.col("_c20"), F.col("_s20"), F.col("_n20") == 20
    good = (std > 0) & (mean > 0)
    return {
        "boll_pct_b": F.when(warm, F.when(good, (c - (mean - 2 * std)) / (4 * std)).otherwise(0.5)),
        "boll_bandwidth": F.when(warm, F.when(good, 4 * std / mean).otherwise(0.0)),
    }


def _vwap_rolls():
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return {"_pv": F.sum(typical * F.col("volume")).over(so_far(_w())), "_cv": F.sum("volume").over(so_far(_w()))}


def _vwap():
    level = ratio(F.col("_pv"), F.col("_cv"))
    return {"vwap_level": level, "vwap_dist": _change(_close(), level)}


def _volprofile_rolls():
    v = F.col("volume")
    return {"_v20": rolling_mean(v, _w(), 20), "_vs20": rolling_std(v, _w(), 20), "_cv": F.sum("volume").over(so_far(_w()))}


def _volprofile():
    v, mean = F.col("volume"), F.col("_v20")
    return {"volprofile_rel_vol": ratio(v, mean), "volprofile_vol_z": _z(v, mean, F.col("_vs20")), "volprofile_cum_vol": F.col("_cv")}


def _tradeintensity_rolls():
    n = F.col("trade_count").cast("double")
    return {"_t15": rolling_mean(n, _w(), 15), "_ts15": rolling_std(n, _w(), 15)}


def _tradeintensity():
    return {"tradeintensity_tc_mean": F.col("_t15"), "tradeintensity_tc_z": _z(F.col("trade_count").cast("double"), F.col("_t15"), F.col("_ts15"))}


def _tradeflow_rolls():
    return {"_signed": F.sum("signed").over(so_far(_w())), "_size": F.sum("size").over(so_far(_w()))}


def _tradeflow():
    return {"tradeflow_ofi_session": ratio(F.col("_signed"), F.col("_size")), "tradeflow_ofi_1m": ratio(F.col("signed"), F.col("size"))}


def _quotespread():
    bid, ask, bs, as_, mid = (F.col(f"q_{x}") for x in ("bid", "ask", "bid_size", "ask_size", "mid"))
    micro = (ask * bs + bid * as_) / (bs + as_)
    deep = (mid > 0) & (bs + as_ > 0)
    return {
        "quotespread_spread_bps": F.when(mid > 0, (ask - bid) / mid * 1e4), "quotespread_imbalance": F.when(deep, (bs - as_) / (bs + as_)),
        "quotespread_microprice_dist": F.when(deep, micro / mid - 1),
    }


def _quotedyn():
    e = F.col("_spread_ewma")
    return {"quotedyn_spread_ewma_bps": F.when(e > 0, e), "quotedyn_spread_ratio": ratio(F.col("_last_spread"), e)}


def _trademicro():
    n, size, notional = F.col("n_trades").cast("double"), F.col("size"), F.col("notional")
    some = size > 0
    return {
        "trademicro_n_trades": F.when(some, n).otherwise(0.0), "trademicro_avg_size": F.when(some, size / n),
        "trademicro_vwap_dist": F.when(some & (notional > 0), _close() / (notional / size) - 1),
        "trademicro_signed_frac": F.when(some, F.col("signed") / size), "trademicro_top_size_frac": F.when(some, F.col("top") / size),
    }


def _quotemicro():
    n, time = F.col("n_quotes"), F.col("time")
    timed, some = time > 0, n > 0
    return {
        "quotemicro_n_quotes": n.cast("double"),
        "quotemicro_twa_spread_bps": F.when(some, F.when(timed, F.col("spread_time") / time).otherwise(F.col("end_spread"))),
        "quotemicro_twa_imbalance": F.when(some, F.when(timed, F.col("imb_time") / time).otherwise(F.col("end_imb"))),
        "quotemicro_spread_range_bps": F.when(some, F.when(timed, F.col("max_spread") - F.col("min_spread")).otherwise(0.0)),
    }


def _flowfreq_rolls():
    prior = _w().rowsBetween(-20, -1)
    out = {"_prior": F.count(F.lit(1)).over(prior)}
    for name, x in (("trade", "n_trades"), ("quote", "n_all_quotes")):
        out |= {f"_m_{name}": F.avg(x).over(prior), f"_s_{name}": F.stddev_pop(x).over(prior)}
    return out


def _flowfreq():
    out = {}
    for name, x in (("trade", F.col("n_trades").cast("double")), ("quote", F.col("n_all_quotes").cast("double"))):
        out[f"flowfreq_{name}_rate_z"] = F.when(F.col("_prior") >= 2, _z(x, F.col(f"_m_{name}"), F.col(f"_s_{name}")))
    out["flowfreq_trade_quote_ratio"] = ratio(F.col("n_trades").cast("double"), F.col("n_all_quotes").cast("double"))
    return out


Columns = Callable[[], dict[str, Column]]


@dataclass(frozen=True)
class FeatureGroup:
    """A named group of columns (``{name}_{column}``), declared by level so that all groups share the windows of a level.

    base: columns that helpers share.  Level 1: helper columns over the bar table, then exponential means of them; level 2: the same over those; then rolls,
    window columns that several expressions use (Spark evaluates each occurrence of a window expression); last the
    columns themselves.  Means and helpers of one name are shared between groups.
    """

    name: str
    columns: tuple[str, ...]
    final: Columns
    base: Columns | None = None
    pre: Columns | None = None
    means: dict[str, tuple[str, int]] = field(default_factory=dict)
    pre2: Columns | None = None
    means2: dict[str, tuple[str, int]] = field(default_factory=dict)
    rolls: Columns | None = None
    version: str = VERSION

    def names(self) -> list[str]:
        return [f"{self.name}_{x}" for x in self.columns]


REGISTRY: dict[str, FeatureGroup] = {}


def register(group: FeatureGroup) -> FeatureGroup:
    """Add a group; user-defined ones are computed like the built-in ones."""
    if not group.name:
        raise ValueError("a feature group needs a name")
    REGISTRY[group.name] = group
    return group


_LEVELS: dict[str, dict] = {
    "ema": {"means": {f"ema_ema_{n}": ("close", n) for n in EMA_SPANS}},
    "macd": {"means": {"_fast": ("close", 12), "_slow": ("close", 26)}, "pre2": _macd_pre, "means2": {"macd_signal": ("macd_macd", SIGNAL_SPAN)}},
    "momentum": {"base": _last_pre, "pre": _r1_pre},
    "rsi": {"base": _last_pre, "pre": _rsi_moves, "means": {"_g": ("_gain", RSI_SPAN), "_l": ("_loss", RSI_SPAN)}},
    "vol": {"base": _last_pre, "pre": _r1_pre, "pre2": _seq_pre},
    "rvol": {"base": _last_pre, "pre": _r1_pre, "pre2": _seq_pre},
    "atr": {"base": _last_pre, "pre": _atr_pre},
}
for _name in GROUPS:
    register(FeatureGroup(_name, GROUPS[_name], globals()[f"_{_name}"], rolls=globals().get(f"_{_name}_rolls"), **_LEVELS.get(_name, {})))


#: Tickers of a universe that may be broadcast.
MAX_UNIVERSE = 1_000_000


def of_universe(rows: DataFrame | None, universe: DataFrame | None) -> DataFrame | None:
    """Rows whose ticker is in the universe (a column ticker); those of other tickers yield nothing."""
    if rows is None or universe is None:
        return rows
    names = universe.select("ticker").distinct()
    return rows.join(F.broadcast(names) if names.count() <= MAX_UNIVERSE else names, "ticker", "left_semi")


def compute_custom(bars: DataFrame, columns: Iterable[str], make: Callable, universe: DataFrame | None = None) -> DataFrame:
    """ticker, ts_ns and columns of a stateful feature that window expressions can't state.

    make: from the bars of one session in order (a pandas frame) to a frame of the columns, a row a bar.  A session has at
    most some thousand bars, so a group is small.
    """
    columns = list(columns)
    if not columns:
        raise ValueError("a feature needs columns")
    schema = "ticker string, ts_ns long, " + ", ".join(f"{c} double" for c in columns)

    def run(session):
        session = session.sort_values("ts_ns", kind="stable").reset_index(drop=True)
        out = make(session)
        out = out[columns].astype("float64")
        out.insert(0, "ticker", session["ticker"])
        out.insert(1, "ts_ns", session["ts_ns"])
        return out

    rows = of_universe(_sane(bars, PRICES), universe).withColumn("session_date", clock.session_date(F.col("ts_ns")))
    return rows.groupBy(*KEYS).applyInPandas(run, schema)


def compute(
    bars: DataFrame, trades: DataFrame | None = None, quotes: DataFrame | None = None, groups: Iterable[str] | None = None, order: str = "replay", universe: DataFrame | None = None,
    returns_over: str = "values",
) -> DataFrame:
    """ticker, ts_ns and the features of the groups (all by default), one row a bar; missing is NULL.  universe: the
    tickers that count, all of them by default.  returns_over: whether ``vol`` and ``rvol`` take the last n returns
    (values) or the returns of the last n bars (bars); a bar after one that closed at 0 has no return."""
    if returns_over not in ("values", "bars"):
        raise ValueError("returns are taken over values or bars")
    bars, trades, quotes = (of_universe(df, universe) for df in (bars, trades, quotes))
    chosen = [REGISTRY[g] for g in (groups if groups is not None else REGISTRY)]
    df = bar_table(bars, trades, quotes, order)
    for pre, means in (("base", None), ("pre", "means"), ("pre2", "means2")):
        helpers, specs = {}, {}
        for g in chosen:
            helpers |= getattr(g, pre)() if getattr(g, pre) else {}
            specs |= getattr(g, means) if means else {}
        if returns_over == "bars" and "_seq" in helpers:
            helpers["_seq"] = F.col("bar_idx")
        if helpers:
            df = df.withColumns(helpers)
        if specs:
            df = kernels.with_ewma(df, specs, KEYS, ["bar_idx"], "chunk")
    rolls, last = {}, {}
    for g in chosen:
        rolls |= g.rolls() if g.rolls else {}
        last |= g.final()
    if rolls:
        df = df.withColumns(rolls)
    return df.withColumns(last).select("ticker", "ts_ns", *(n for g in chosen for n in g.names()))


def project(features: DataFrame, names: Iterable[str]) -> DataFrame:
    """Keys and those of the names that exist."""
    return features.select("ticker", "ts_ns", *(x for x in names if x in features.columns))


def valid_count(features: DataFrame) -> Column:
    """The number of values that aren't missing."""
    return sum((F.col(x).isNotNull().cast("int") for x in features.columns if x in FEATURES or x not in ("ticker", "ts_ns")), F.lit(0))


__all__ = ["FeatureGroup", "REGISTRY", "bar_table", "columns_of", "compute", "project", "register", "valid_count"]
