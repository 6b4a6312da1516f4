"""DuckDB SQL that states the registered queries independently: as-of joins, lists and recurrences instead of tapes."""

from __future__ import annotations

import zlib

from tickloom.schema import FEATURES, columns_of

_EVENTS = """
ev AS (SELECT event_id AS seq, 'T' || (user_id % 4) AS ticker, epoch_us(ts) * 1000 AS ts_ns, event_type, value,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
tr AS (SELECT ticker, ts_ns, seq, value AS price, CAST(k + 1 AS DOUBLE) AS size FROM ev WHERE event_type IN ('purchase', 'click', 'signup')),
qt AS (SELECT ticker, ts_ns, seq, value - value * (k + 1) / 1e5 AS bid, value + value * (k + 1) / 1e5 AS ask,
              CAST(k + 1 AS DOUBLE) AS bid_size, CAST(seq % 17 + 1 AS DOUBLE) AS ask_size FROM ev WHERE event_type IN ('view', 'error')),
br0 AS (SELECT ticker, ts_ns // 60000000000 AS mb, arg_min(price, ts_ns) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts_ns) AS close,
               sum(size) AS volume, count(*) AS trade_count, sum(price * size) / sum(size) AS vwap FROM tr GROUP BY 1, 2),
br1 AS (SELECT *, mb * 60000000000 AS ts_ns, timezone('America/New_York', timezone('UTC', make_timestamp(mb * 60000000))) AS et FROM br0),
br AS (SELECT *, CAST(et AS DATE) AS d, row_number() OVER (PARTITION BY ticker, CAST(et AS DATE) ORDER BY mb) - 1 AS idx FROM br1),
q1 AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', make_timestamp(ts_ns // 1000))) AS DATE) AS d, ts_ns // 60000000000 AS mb, (bid + ask) / 2 AS mid FROM qt),
t1 AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', make_timestamp(ts_ns // 1000))) AS DATE) AS d, ts_ns // 60000000000 AS mb FROM tr),
t2 AS (SELECT t1.*, q1.mid AS q_mid, CASE WHEN q1.mid IS NULL OR t1.price >= q1.mid THEN 1.0 ELSE -1.0 END AS sign
       FROM t1 ASOF LEFT JOIN q1 ON t1.ticker = q1.ticker AND t1.d = q1.d AND t1.ts_ns >= q1.ts_ns),
t3 AS (SELECT t2.*, br.idx FROM t2 ASOF LEFT JOIN br ON t2.ticker = br.ticker AND t2.d = br.d AND t2.mb <= br.mb),
q2 AS (SELECT q1.*, br.idx FROM q1 ASOF LEFT JOIN br ON q1.ticker = br.ticker AND q1.d = br.d AND q1.mb <= br.mb)"""


def _ew(x: str, span: int, w: str = "w") -> str:
    return f"list_reduce(list({x}) OVER {w}, lambda a, x: a + {2 / (span + 1)!r} * (x - a))"


def _chg(now: str, past: str) -> str:
    return f"CASE WHEN {past} > 0 THEN {now} / {past} - 1 END"


_TICKS = f""",
vq AS (SELECT *, (ask - bid) / mid * 1e4 AS spread, CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) ELSE 0.0 END AS imb
       FROM q2 WHERE mid > 0),
vq1 AS (SELECT *, {_ew("spread", 50, "(PARTITION BY ticker, d ORDER BY ts_ns, seq)")} AS e,
               lag(ts_ns) OVER p AS pt, lag(spread) OVER p AS ps, lag(imb) OVER p AS pi FROM vq WINDOW p AS (PARTITION BY ticker, d, idx ORDER BY ts_ns, seq)),
ta AS (SELECT ticker, d, idx, count(*) AS n_trades, sum(size) AS size, sum(price * size) AS notional, sum(sign * size) AS signed, max(size) AS top
       FROM t3 WHERE idx IS NOT NULL GROUP BY 1, 2, 3),
qa AS (SELECT ticker, d, idx, count(*) AS n_all FROM q2 WHERE idx IS NOT NULL GROUP BY 1, 2, 3),
va AS (SELECT ticker, d, idx, count(*) AS n, min(spread) AS lo, max(spread) AS hi, sum(ps * greatest(ts_ns - pt, 0)) AS st, sum(pi * greatest(ts_ns - pt, 0)) AS it,
              sum(greatest(ts_ns - pt, 0)) AS tt, arg_max(spread, ts_ns) AS es, arg_max(imb, ts_ns) AS ei FROM vq1 WHERE idx IS NOT NULL GROUP BY 1, 2, 3),
lq AS (SELECT br.ticker, br.d, br.idx, q1.mid, q1.bid, q1.ask, q1.bid_size, q1.ask_size
       FROM br ASOF LEFT JOIN q1 ON br.ticker = q1.ticker AND br.d = q1.d AND (br.mb + 1) * 60000000000 > q1.ts_ns),
lv AS (SELECT br.ticker, br.d, br.idx, vq1.spread, vq1.e
       FROM br ASOF LEFT JOIN vq1 ON br.ticker = vq1.ticker AND br.d = vq1.d AND (br.mb + 1) * 60000000000 > vq1.ts_ns)"""

_BARS = f""",
a1 AS (SELECT *, lag(close) OVER w AS pc, lag(close, 2) OVER w AS pc2, lag(close, 5) OVER w AS pc5, lag(close, 10) OVER w AS pc10, lag(close, 15) OVER w AS pc15, lag(close, 30) OVER w AS pc30,
              first_value(open) OVER w AS o0, max(high) OVER w AS hh, min(low) OVER w AS ll,
              {", ".join(f"{_ew('close', n)} AS e{n}" for n in (9, 12, 26, 50))}
       FROM br WINDOW w AS (PARTITION BY ticker, d ORDER BY idx ROWS UNBOUNDED PRECEDING)),
a2 AS (SELECT *, {_chg("close", "pc")} AS r1, e12 - e26 AS mac, greatest(close - pc, 0) AS gain, greatest(pc - close, 0) AS loss,
              CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM a1),
a3 AS (SELECT *, {_ew("mac", 9)} AS sig, list_reduce(list(gain) OVER v, lambda a, x: a + {2 / 28!r} * (x - a)) AS ag, list_reduce(list(loss) OVER v, lambda a, x: a + {2 / 28!r} * (x - a)) AS al,
              lag(r1) OVER w AS pr1
       FROM a2 WINDOW w AS (PARTITION BY ticker, d ORDER BY idx ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY ticker, d, idx > 0 ORDER BY idx ROWS UNBOUNDED PRECEDING)),
a4 AS (SELECT *,
  {", ".join(f"max(high) OVER w{n} AS h{n}, min(low) OVER w{n} AS l{n}" for n in (15, 60))},
  {", ".join(f"CASE WHEN count(r1) OVER w{n} >= 2 THEN stddev_pop(r1) OVER w{n} END AS sd{n}, sqrt(sum(r1 * r1) OVER w{n}) AS rv{n}" for n in (5, 15, 30))},
  avg(tr) OVER w5 AS atr5, avg(tr) OVER w14 AS atr14, avg(close) OVER w20 AS m20, stddev_pop(close) OVER w20 AS s20, count(*) OVER w20 AS n20,
  sum((high + low + close) / 3 * volume) OVER wa AS pv, sum(volume) OVER wa AS cv, avg(volume) OVER w20 AS vm, CASE WHEN count(*) OVER w20 >= 2 THEN stddev_pop(volume) OVER w20 END AS vs,
  avg(trade_count) OVER w15 AS tm, CASE WHEN count(*) OVER w15 >= 2 THEN stddev_pop(trade_count) OVER w15 END AS tsd
  FROM a3 WINDOW wa AS (PARTITION BY ticker, d ORDER BY idx ROWS UNBOUNDED PRECEDING),
  {", ".join(f"w{n} AS (PARTITION BY ticker, d ORDER BY idx ROWS {n - 1} PRECEDING)" for n in (5, 14, 15, 20, 30, 60))}),
a5 AS (SELECT a4.*, coalesce(ta.n_trades, 0) AS n_trades, ta.size, ta.notional, ta.signed, ta.top, coalesce(qa.n_all, 0) AS n_all, coalesce(va.n, 0) AS nv,
              va.lo, va.hi, va.st, va.it, va.tt, va.es, va.ei, lq.mid, lq.bid, lq.ask, lq.bid_size AS bs, lq.ask_size AS az, lv.spread AS lspread, lv.e AS lewma
       FROM a4 LEFT JOIN ta USING (ticker, d, idx) LEFT JOIN qa USING (ticker, d, idx) LEFT JOIN va USING (ticker, d, idx)
               LEFT JOIN lq USING (ticker, d, idx) LEFT JOIN lv USING (ticker, d, idx)),
a6 AS (SELECT *, sum(signed) OVER w AS ssum, sum(size) OVER w AS vsum,
              {", ".join(f"avg({x}) OVER p AS {x}_m, CASE WHEN count({x}) OVER p >= 2 THEN stddev_pop({x}) OVER p END AS {x}_s" for x in ("n_trades", "n_all"))}
       FROM a5 WINDOW w AS (PARTITION BY ticker, d ORDER BY idx ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY ticker, d ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""

_MIN = "(extract(hour FROM et) * 60 + extract(minute FROM et))"
_EXPR = {
    "tradeflow_ofi_session": "CASE WHEN vsum > 0 THEN ssum / vsum END",
    "tradeflow_ofi_1m": "CASE WHEN size > 0 THEN signed / size END",
    "quotespread_spread_bps": "CASE WHEN mid > 0 THEN (ask - bid) / mid * 1e4 END",
    "quotespread_imbalance": "CASE WHEN mid > 0 AND bs + az > 0 THEN (bs - az) / (bs + az) END",
    "quotespread_microprice_dist": "CASE WHEN mid > 0 AND bs + az > 0 THEN (ask * bs + bid * az) / (bs + az) / mid - 1 END",
    "quotedyn_spread_ewma_bps": "CASE WHEN lewma > 0 THEN lewma END",
    "quotedyn_spread_ratio": "CASE WHEN lewma > 0 THEN lspread / lewma END",
    "trademicro_n_trades": "CASE WHEN size > 0 THEN n_trades ELSE 0 END",
    "trademicro_avg_size": "CASE WHEN size > 0 THEN size / n_trades END",
    "trademicro_vwap_dist": "CASE WHEN size > 0 AND notional > 0 THEN close / (notional / size) - 1 END",
    "trademicro_signed_frac": "CASE WHEN size > 0 THEN signed / size END",
    "trademicro_top_size_frac": "CASE WHEN size > 0 THEN top / size END",
    "quotemicro_n_quotes": "nv",
    "quotemicro_twa_spread_bps": "CASE WHEN nv > 0 THEN CASE WHEN tt > 0 THEN st / tt ELSE es END END",
    "quotemicro_twa_imbalance": "CASE WHEN nv > 0 THEN CASE WHEN tt > 0 THEN it / tt ELSE ei END END",
    "quotemicro_spread_range_bps": "CASE WHEN nv > 0 THEN CASE WHEN tt > 0 THEN hi - lo ELSE 0 END END",
    "flowfreq_trade_rate_z": "CASE WHEN n_trades_s > 0 THEN (n_trades - n_trades_m) / n_trades_s END",
    "flowfreq_quote_rate_z": "CASE WHEN n_all_s > 0 THEN (n_all - n_all_m) / n_all_s END",
    "flowfreq_trade_quote_ratio": "CASE WHEN n_all > 0 THEN n_trades / n_all END",
    "returns_r_1": "r1",
    "returns_r_2": _chg("close", "pc2"),
    "returns_r_5": _chg("close", "pc5"),
    "returns_r_15": _chg("close", "pc15"),
    "returns_r_30": _chg("close", "pc30"),
    "ema_ema_9": "e9",
    "ema_ema_12": "e12",
    "ema_ema_26": "e26",
    "ema_ema_50": "e50",
    "ema_dist_9": _chg("close", "e9"),
    "ema_dist_50": _chg("close", "e50"),
    "macd_macd": "mac",
    "macd_signal": "sig",
    "macd_hist": "mac - sig",
    "momentum_roc_10": _chg("close", "pc10"),
    "momentum_accel": "r1 - pr1",
    "gap_from_open": _chg("close", "o0"),
    "gap_high_from_open": _chg("hh", "o0"),
    "candle_body": "CASE WHEN high > low THEN abs(close - open) / (high - low) ELSE 0 END",
    "candle_upper_wick": "CASE WHEN high > low THEN (high - greatest(open, close)) / (high - low) ELSE 0 END",
    "candle_lower_wick": "CASE WHEN high > low THEN (least(open, close) - low) / (high - low) ELSE 0 END",
    "sessionrange_pos": "CASE WHEN hh > ll THEN (close - ll) / (hh - ll) ELSE 0.5 END",
    "sessionrange_range_pct": "CASE WHEN hh > ll THEN CASE WHEN ll > 0 THEN (hh - ll) / ll END ELSE 0 END",
    "rollrange_pos_15": "CASE WHEN h15 > l15 THEN (close - l15) / (h15 - l15) ELSE 0.5 END",
    "rollrange_pos_60": "CASE WHEN h60 > l60 THEN (close - l60) / (h60 - l60) ELSE 0.5 END",
    "rsi_rsi_14": "CASE WHEN idx = 0 THEN NULL WHEN al > 0 THEN 100 - 100 / (1 + ag / al) WHEN ag > 0 THEN 100 ELSE 50 END",
    "sessionclock_since_open": f"{_MIN} - 570",
    "sessionclock_to_close": f"960 - {_MIN}",
    "sessionclock_progress": f"({_MIN} - 570) / 390.0",
    **{f"vol_std_{n}": f"sd{n}" for n in (5, 15, 30)},
    **{f"rvol_rv_{n}": f"rv{n}" for n in (5, 15, 30)},
    "atr_atr_5": "atr5",
    "atr_atr_14": "atr14",
    "boll_pct_b": "CASE WHEN n20 = 20 THEN CASE WHEN s20 > 0 AND m20 > 0 THEN (close - (m20 - 2 * s20)) / (4 * s20) ELSE 0.5 END END",
    "boll_bandwidth": "CASE WHEN n20 = 20 THEN CASE WHEN s20 > 0 AND m20 > 0 THEN 4 * s20 / m20 ELSE 0 END END",
    "vwap_level": "CASE WHEN cv > 0 THEN pv / cv END",
    "vwap_dist": "CASE WHEN cv > 0 AND pv / cv > 0 THEN close / (pv / cv) - 1 END",
    "volprofile_rel_vol": "CASE WHEN vm > 0 THEN volume / vm END",
    "volprofile_vol_z": "CASE WHEN vs > 0 THEN (volume - vm) / vs END",
    "volprofile_cum_vol": "cv",
    "tradeintensity_tc_mean": "tm",
    "tradeintensity_tc_z": "CASE WHEN tsd > 0 THEN (trade_count - tm) / tsd END",
}


#: Decimals of columns whose values meet exact ties at the sixth.
DIGITS = {"ema_dist_9": 8, "ema_dist_50": 8}


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


def features(names: list[str] | None = None, where: str = "") -> str:
    cols = ", ".join(r6(_EXPR[n], n, DIGITS.get(n, 6)) for n in (names or FEATURES))
    return f"WITH {_EVENTS}{_TICKS}{_BARS} SELECT ticker, ts_ns, {cols} FROM a6 {where}"


def group(name: str) -> str:
    return features(columns_of(name))


def with_events(sql: str) -> str:
    return f"WITH {_EVENTS} {sql}"


def with_features(names: list[str], sql: str) -> str:
    cols = ", ".join(f"CAST({_EXPR[n]} AS DOUBLE) AS {n}" for n in names)
    return f"WITH {_EVENTS}{_TICKS}{_BARS}, f AS (SELECT ticker, ts_ns, mb, {cols} FROM a6) {sql}"


def shard_values(tickers: list[str], n: int) -> str:
    return ", ".join(f"('{t}', {zlib.crc32(t.encode()) % n})" for t in tickers)
