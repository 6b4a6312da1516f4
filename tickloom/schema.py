"""Schemas and the feature catalog."""

from __future__ import annotations

VERSION = "0.1.0"

BARS = "ticker string, ts_ns long, open double, high double, low double, close double, volume double, trade_count long, vwap double"
TRADES = "ticker string, ts_ns long, price double, size double"
QUOTES = "ticker string, ts_ns long, bid double, ask double, bid_size double, ask_size double"

#: The feature groups and their columns, in vector order.
GROUPS: dict[str, tuple[str, ...]] = {
    "tradeflow": ("ofi_session", "ofi_1m"),
    "quotespread": ("spread_bps", "imbalance", "microprice_dist"),
    "quotedyn": ("spread_ewma_bps", "spread_ratio"),
    "trademicro": ("n_trades", "avg_size", "vwap_dist", "signed_frac", "top_size_frac"),
    "quotemicro": ("n_quotes", "twa_spread_bps", "twa_imbalance", "spread_range_bps"),
    "flowfreq": ("trade_rate_z", "quote_rate_z", "trade_quote_ratio"),
    "returns": ("r_1", "r_2", "r_5", "r_15", "r_30"),
    "ema": ("ema_9", "ema_12", "ema_26", "ema_50", "dist_9", "dist_50"),
    "macd": ("macd", "signal", "hist"),
    "momentum": ("roc_10", "accel"),
    "gap": ("from_open", "high_from_open"),
    "candle": ("body", "upper_wick", "lower_wick"),
    "sessionrange": ("pos", "range_pct"),
    "rollrange": ("pos_15", "pos_60"),
    "rsi": ("rsi_14",),
    "sessionclock": ("since_open", "to_close", "progress"),
    "vol": ("std_5", "std_15", "std_30"),
    "rvol": ("rv_5", "rv_15", "rv_30"),
    "atr": ("atr_5", "atr_14"),
    "boll": ("pct_b", "bandwidth"),
    "vwap": ("level", "dist"),
    "volprofile": ("rel_vol", "vol_z", "cum_vol"),
    "tradeintensity": ("tc_mean", "tc_z"),
}
#: What kind of statistic a group is.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "price / trend": ("returns", "ema", "macd", "momentum", "gap", "candle"),
    "volatility": ("vol", "rvol", "atr", "boll"),
    "volume": ("vwap", "volprofile", "tradeintensity"),
    "range": ("sessionrange", "rollrange"),
    "oscillator": ("rsi",),
    "calendar": ("sessionclock",),
    "microstructure": ("tradeflow", "quotespread", "quotedyn"),
}
OTHER_CATEGORY = "feature group"
TICK_GROUPS = ("tradeflow", "quotespread", "quotedyn", "trademicro", "quotemicro", "flowfreq")


def category_of(group: str) -> str:
    return next((c for c, groups in CATEGORIES.items() if group in groups), OTHER_CATEGORY)


def columns_of(group: str) -> list[str]:
    return [f"{group}_{c}" for c in GROUPS[group]]


FEATURES: list[str] = [c for g in GROUPS for c in columns_of(g)]
