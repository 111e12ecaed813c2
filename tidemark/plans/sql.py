"""DuckDB SQL that states each query's result on its own terms."""

from __future__ import annotations

import hashlib
import json

from ..operators import features as ft
from ..operators import outcomes as oc
from ..operators import research

_PLACE = "SELECT s_suppkey, upper(replace(r_name, ' ', '_')) AS exchange FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _bars(by: str = "supplier", gap: int = 0, first: int = 0) -> str:
    key = "l_suppkey::VARCHAR" if by == "supplier" else "'ALL'"
    return f"""
place AS ({_PLACE}),
ln AS (SELECT exchange, {key} AS ticker, make_date((year(l_shipdate) + 16)::INT, month(l_shipdate)::INT, day(l_shipdate)::INT) AS date, l_extendedprice / l_quantity AS price, l_quantity,
         row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS ord FROM lineitem JOIN place ON l_suppkey = s_suppkey),
dy AS (SELECT exchange, ticker, date, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low, arg_max(price, ord) AS close, sum(l_quantity) AS volume FROM ln GROUP BY ALL),
rn AS (SELECT *, 'US:' || exchange || ':STOCKS:' || ticker AS instrument_id, row_number() OVER (PARTITION BY exchange, ticker ORDER BY date) AS k FROM dy),
bars AS (SELECT instrument_id, ticker, exchange, date, (year(date) * 10000 + month(date) * 100 + day(date))::INT AS signal_date,
         (k + 1{f" + CASE WHEN k > {gap} THEN 1 ELSE 0 END" if gap else ""})::BIGINT AS source_row_number, open, high, low, close, volume FROM rn{f" WHERE k <= {first}" if first else ""})"""


_SEG = """,
g1 AS (SELECT *, coalesce(greatest(source_row_number - lag(source_row_number) OVER w - 1, 0), 0) AS source_gap_rows, coalesce(date_diff('day', lag(date) OVER w, date), 0) AS calendar_gap_days,
         lag(date) OVER w IS NULL AS is_first FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY date)),
g2 AS (SELECT *, (is_first OR source_gap_rows > 0 OR calendar_gap_days > 30)::INT AS segment_reset FROM g1),
g3 AS (SELECT *, (sum(segment_reset) OVER (PARTITION BY instrument_id ORDER BY date) - 1)::INT AS segment_id FROM g2),
seg AS (SELECT *, (row_number() OVER (PARTITION BY instrument_id, segment_id ORDER BY date))::INT AS history_bars FROM g3)"""


def _features() -> str:
    t = lambda k: f"(PARTITION BY instrument_id, segment_id ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
    p = lambda k: f"(PARTITION BY instrument_id, segment_id ORDER BY date ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    since = lambda k, e: f"CASE WHEN history_bars >= {k} THEN {e} END"
    cols = {
        "intraday_return": "close / open - 1", "gap_return": "open / prev - 1", "high_low_range_pct": "rng", "true_range_pct": "tr / coalesce(prev, close)",
        "close_location": "(close - low) / nullif(high - low, 0)", "body_to_range": "(close - open) / nullif(high - low, 0)",
    }
    cols |= {f"return_{k}": f"close / lag(close, {k}) OVER w - 1" for k in ft.RETURNS}
    cols |= {f"sma_distance_{k}": since(k, f"close / avg(close) OVER {t(k)} - 1") for k in ft.AVERAGES}
    cols |= {f"realized_vol_{k}": since(k + 1, f"stddev_samp(lr) OVER {t(k)}") for k in ft.VOLATILITIES}
    cols["atr_14_pct"] = since(14, f"avg(tr) OVER {t(14)} / close")
    cols["volume_ratio_20_prior"] = since(21, f"volume / nullif(avg(volume) OVER {p(20)}, 0)")
    cols["log_dollar_volume_20_prior"] = since(21, f"ln(1 + avg(close * volume) OVER {p(20)})")
    cols |= {f"distance_to_prior_high_{k}": since(k + 1, f"close / max(high) OVER {p(k)} - 1") for k in ft.EXTREMES}
    cols |= {f"distance_to_prior_low_{k}": since(k + 1, f"close / min(low) OVER {p(k)} - 1") for k in ft.EXTREMES}
    cols |= {f"efficiency_ratio_{k}": since(k + 1, f"abs(close - lag(close, {k}) OVER w) / nullif(sum(abs(close - prev)) OVER {t(k)}, 0)") for k in ft.PATHS}
    cols |= {f"up_fraction_{k}": since(k + 1, f"avg((close > prev)::INT) OVER {t(k)}") for k in ft.PATHS}
    cols["range_ratio_5_20"] = since(20, f"avg(rng) OVER {t(5)} / nullif(avg(rng) OVER {t(20)}, 0)")
    return """,
f1 AS (SELECT *, lag(close) OVER (PARTITION BY instrument_id, segment_id ORDER BY date) AS prev, (high - low) / close AS rng FROM seg),
f2 AS (SELECT *, greatest(high - low, abs(high - prev), abs(low - prev)) AS tr, ln(close) - ln(prev) AS lr FROM f1),
f3 AS (SELECT *, """ + ", ".join(f"{e} AS {n}" for n, e in cols.items()) + """ FROM f2 WINDOW w AS (PARTITION BY instrument_id, segment_id ORDER BY date)),
ft AS (SELECT *, realized_vol_10 / nullif(realized_vol_60, 0) AS realized_vol_ratio_10_60,
         row_number() OVER (PARTITION BY instrument_id ORDER BY date) AS place, max(segment_id) OVER (PARTITION BY instrument_id) AS last_segment FROM f3)"""


_R = lambda cols: ", ".join(f"CASE WHEN round({c}, 6) = 0 THEN 0 ELSE round({c}, 6) END AS {c}" for c in cols)
_FT = _bars(gap=200) + _SEG + _features()

_ENTRY = """,
en AS (SELECT *, lead(segment_id) OVER w AS ns, lead(signal_date) OVER w AS nd, lead(source_row_number) OVER w AS nr FROM {src} WINDOW w AS (PARTITION BY instrument_id ORDER BY date)),
ent AS (SELECT *, CASE WHEN ns IS NULL THEN 'no_later_bar' WHEN ns <> segment_id THEN 'next_bar_new_segment' ELSE 'available' END AS historical_entry_status FROM en)"""


def _signals(family: str, direction: str, mask: str, strength: str, name: str = "sg") -> str:
    return f""",
{name} AS (SELECT 'cand_' || sha256('candidate_schema_v1.0.0|{family}|v1.0.0|' || instrument_id || '|' || signal_date || '|{direction}') AS candidate_id, '{direction}' AS direction, *,
         CASE WHEN historical_entry_status = 'available' THEN nd END AS entry_date, {strength} AS raw_setup_strength FROM ent WHERE {mask})"""


_ENT = _ENTRY.format(src="ft")
_PROBE = _signals("every_nth", "LONG", "history_bars % 50 = 0", "coalesce(return_1, 0)")
_EVERY = _signals("every_bar", "LONG", "true", "coalesce(return_1, 0)")
_EVERY_SHORT = _signals("every_bar", "SHORT", "true", "coalesce(return_1, 0)")
_F = lambda c: f"{c}::FLOAT::DOUBLE"
_DEMO_MASK = f"""coalesce(history_bars >= 60 AND {_F('return_20')} >= -1.0 AND {_F('distance_to_prior_high_60')} >= -0.9::DOUBLE AND {_F('distance_to_prior_high_60')} <= 0.5::DOUBLE
  AND {_F('atr_14_pct')} <= 2.0::DOUBLE AND {_F('log_dollar_volume_20_prior')} >= 5.0::DOUBLE, false)"""
_DEMO_STRENGTH = f"0.6 * greatest(0, least(1, {_F('return_20')} / 0.2)) + 0.4 * greatest(0, least(1, 1 - abs({_F('distance_to_prior_high_60')} - (-0.2)) / 0.7))"
_DEMO = _signals("trend_pullback", "LONG", _DEMO_MASK, _DEMO_STRENGTH)


def _outcomes() -> str:
    """Frames of following bars for returns and excursions; first touches in slices of the segment's lists."""
    frame = lambda h: f"OVER (PARTITION BY instrument_id, segment_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    ahead = []
    for h in oc.HORIZONS:
        ahead += [f"lead(close, {h}) OVER w AS c{h}", f"lead(signal_date, {h}) OVER w AS d{h}", f"max(high) {frame(h)} AS hi{h}", f"min(low) {frame(h)} AS lo{h}"]
    out = []
    for h in oc.HORIZONS:
        up, down = f"hi{h} / entry_open - 1", f"lo{h} / entry_open - 1"
        have = f"historical_entry_status = 'available' AND have >= {h}"
        out += [f"CASE WHEN {have} THEN d{h} END AS h{h}_end_date", f"CASE WHEN {have} THEN (c{h} / entry_open - 1) * CASE WHEN direction = 'LONG' THEN 1 ELSE -1 END END AS h{h}_directional_close_return",
                f"CASE WHEN {have} THEN CASE WHEN direction = 'LONG' THEN {up} ELSE -({down}) END END AS h{h}_directional_mfe", f"CASE WHEN {have} THEN CASE WHEN direction = 'LONG' THEN {down} ELSE -({up}) END END AS h{h}_directional_mae"]
    above = lambda level: f"nullif(coalesce(list_position(list_transform(highs[history_bars + 1:history_bars + 60], lambda x: x >= {level}), true), 0), 0)"
    below = lambda level: f"nullif(coalesce(list_position(list_transform(lows[history_bars + 1:history_bars + 60], lambda x: x <= {level}), true), 0), 0)"
    touches = []
    for name, adverse, distance in (("stop", True, "1.5 * signal_atr_14_abs"), *((f"target_{r}r", False, f"{r} * (1.5 * signal_atr_14_abs)") for r in oc.TARGETS)):
        up, down = f"(entry_open + {distance})", f"(entry_open - {distance})"
        first, second = (below(down), above(up)) if adverse else (above(up), below(down))
        touches.append(f"CASE WHEN signal_atr_14_abs IS NULL THEN NULL WHEN direction = 'LONG' THEN {first} ELSE {second} END AS {name}_first_bar")
    dates = [f"days[history_bars + {n}_first_bar] AS {n}_first_date" for n in ("stop", *(f"target_{r}r" for r in oc.TARGETS))]
    for r, hold in oc.BARRIERS:
        s, t = f"CASE WHEN stop_first_bar <= {hold} THEN stop_first_bar END", f"CASE WHEN target_{r}r_first_bar <= {hold} THEN target_{r}r_first_bar END"
        event = f"least(coalesce({s}, 999), coalesce({t}, 999))"
        dates += [f"""CASE WHEN historical_entry_status <> 'available' THEN 'no_entry' WHEN signal_atr_14_abs IS NULL THEN 'unavailable_atr'
  WHEN coalesce({s}, 999) < 999 AND {s} <= coalesce({t}, 999) THEN 'stop' WHEN {t} IS NOT NULL THEN 'target' WHEN have >= {hold} THEN 'timeout' ELSE 'incomplete' END AS barrier_{r}r_{hold}_result""",
                  f"CASE WHEN signal_atr_14_abs IS NULL THEN NULL WHEN {event} < 999 THEN {event} WHEN have >= {hold} THEN {hold} END::BIGINT AS barrier_{r}r_{hold}_bars_to_event"]
    return f""",
fw AS (SELECT instrument_id, signal_date, lead(open) OVER w AS next_open, count(*) OVER (PARTITION BY instrument_id, segment_id) - history_bars AS after, {", ".join(ahead)} FROM ft WINDOW w AS (PARTITION BY instrument_id, segment_id ORDER BY date)),
sl AS (SELECT instrument_id, segment_id, list(high ORDER BY date) AS highs, list(low ORDER BY date) AS lows, list(signal_date ORDER BY date) AS days FROM ft GROUP BY 1, 2),
se AS (SELECT *, CASE WHEN historical_entry_status = 'available' THEN next_open END AS entry_open, CASE WHEN historical_entry_status = 'available' AND close * atr_14_pct > 0 THEN close * atr_14_pct END AS signal_atr_14_abs,
  CASE WHEN historical_entry_status = 'available' THEN after ELSE 0 END::BIGINT AS have FROM sg JOIN fw USING (instrument_id, signal_date)),
to1 AS (SELECT * EXCLUDE (highs, lows, days), {", ".join(touches)}, days FROM se JOIN sl USING (instrument_id, segment_id)),
oc AS (SELECT * EXCLUDE (days), have AS same_segment_bars_available, CASE WHEN historical_entry_status = 'available' THEN entry_open / close - 1 END AS entry_gap_return_raw,
  CASE WHEN historical_entry_status <> 'available' THEN 'no_entry' WHEN have >= 60 THEN 'complete_60' WHEN segment_id < last_segment THEN 'segment_boundary' ELSE 'end_of_history' END AS termination,
  {", ".join(out)}, {", ".join(dates)} FROM to1)"""


_OC = _outcomes()
_HORIZON = "candidate_id, " + ", ".join(f"h{h}_end_date, {_R([f'h{h}_directional_close_return', f'h{h}_directional_mfe', f'h{h}_directional_mae'])}" for h in oc.HORIZONS)
_TOUCH = "candidate_id, " + ", ".join(f"{n}_first_bar, {n}_first_date" for n in ("stop", *(f"target_{r}r" for r in oc.TARGETS)))
_BARRIER = "candidate_id, " + ", ".join(f"barrier_{r}r_{h}_result, barrier_{r}r_{h}_bars_to_event" for r, h in oc.BARRIERS)
_SPLIT = "(CASE WHEN cast(('0x' || substr(sha256('split_policy_v1.0.0|' || instrument_id), 1, 16)) AS UBIGINT) % 10000 < 7000 THEN 'development' WHEN cast(('0x' || substr(sha256('split_policy_v1.0.0|' || instrument_id), 1, 16)) AS UBIGINT) % 10000 < 8500 THEN 'integration_holdout' ELSE 'final_ticker_holdout' END)"
_PERIOD = "(CASE " + " ".join(f"WHEN signal_date <= {top} THEN '{name}'" for top, name in oc.PERIODS) + " ELSE 'future_out_of_policy' END)"
_RS = f""",
rs AS (SELECT *, {_SPLIT} AS ticker_split, {_PERIOD} AS temporal_partition, h20_directional_close_return AS y_return, (barrier_2r_20_result = 'target')::INT AS y_target
  FROM oc WHERE {_PERIOD} NOT IN ('pseudo_lockbox_2024_2026', 'future_out_of_policy') AND {_SPLIT} = 'development'),
ev AS (SELECT * FROM rs WHERE y_return IS NOT NULL AND h20_end_date IS NOT NULL AND barrier_2r_20_result IN ('target', 'stop', 'timeout'))"""
_FOLDS = ", ".join(f"('{n}', {a}, {b})" for n, a, b in research.FOLDS)
_MEM = f""",
fo AS (SELECT * FROM (VALUES {_FOLDS}) t(fold, test_start, test_end)),
me AS (SELECT ev.*, fold, CASE WHEN signal_date < test_start AND h20_end_date < test_start THEN 'train' ELSE 'test' END AS part FROM ev JOIN fo
  ON (signal_date < test_start AND h20_end_date < test_start) OR (signal_date BETWEEN test_start AND test_end AND h20_end_date <= test_end))"""


def _rank(src: str, by: str, name: str) -> str:
    return f""",
{name}1 AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY raw_setup_strength) + (count(*) OVER (PARTITION BY {by}, raw_setup_strength) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY {by} ORDER BY y_return) + (count(*) OVER (PARTITION BY {by}, y_return) - 1) / 2.0 AS rb,
  row_number() OVER (PARTITION BY {by} ORDER BY raw_setup_strength, candidate_id) AS i, count(*) OVER (PARTITION BY {by}) AS n_all FROM {src}),
{name}2 AS (SELECT *, greatest(1, ceil(n_all * 0.1::DOUBLE)) AS k FROM {name}1),
{name}3 AS (SELECT {by}, count(*) AS n, corr(ra::DOUBLE, rb::DOUBLE) AS spearman, avg(y_return) AS mean_return, avg(y_return) FILTER (i > n_all - k) AS top_return, avg(y_return) FILTER (i <= k) AS bottom_return,
  avg(y_target) AS base_target_rate, avg(y_target) FILTER (i > n_all - k) AS top_target_rate, (sum(ra * y_target)::DOUBLE - sum(y_target) * (sum(y_target) + 1) / 2.0) / nullif(sum(y_target) * (count(*) - sum(y_target)), 0) AS auc FROM {name}2 GROUP BY {by}),
{name} AS (SELECT *, top_return - mean_return AS top_minus_mean, top_return - bottom_return AS top_minus_bottom, CASE WHEN base_target_rate > 0 THEN top_target_rate / base_target_rate END AS top_target_rate_lift FROM {name}3)"""


_FAMILIES = (_DEMO.replace("sg AS", "s1 AS") + _EVERY.replace("sg AS", "s2 AS")) + ",\nsg AS (SELECT 'trend_pullback' AS setup_family, * FROM s1 UNION ALL SELECT 'every_bar', * FROM s2)"
_RESEARCH = _FT + _ENT + _FAMILIES + _OC + _RS
_LINES = r"""
k AS (SELECT *, (l_orderkey * 7 + l_linenumber) % 40 AS k, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) + 1 AS row_number FROM lineitem),
r0 AS (SELECT 'data/daily/us/nyse stocks/1/s' || l_suppkey || '.us.txt' AS member, row_number, k, round(l_extendedprice / l_quantity, 2) AS p, l_quantity,
  CASE WHEN k = 6 THEN NULL WHEN k = 13 THEN DATE '1950-01-01' ELSE l_shipdate::DATE END AS d FROM k WHERE k <> 15),
r1 AS (SELECT *, CASE WHEN k = 11 THEN 0.01 ELSE p END AS high, CASE WHEN k = 12 THEN 9999999 ELSE p END AS low FROM r0),
r2 AS (SELECT *, CASE WHEN k = 1 THEN 'wrong_column_count' WHEN k = 2 THEN 'parse_error' WHEN k = 3 THEN 'ticker_mismatch' WHEN k = 4 THEN 'non_daily_period' WHEN k = 5 THEN 'unexpected_time' WHEN k = 6 THEN 'invalid_date'
  WHEN k = 7 THEN 'non_finite_ohlc' WHEN k = 8 THEN 'non_positive_ohlc' WHEN k = 9 THEN 'non_finite_volume' WHEN k = 10 THEN 'negative_volume' WHEN k = 11 THEN 'high_below_ohlc' WHEN k = 12 THEN 'low_above_ohlc' END AS r FROM r1),
r3 AS (SELECT *, max(CASE WHEN r IS NULL THEN d END) OVER (PARTITION BY member ORDER BY row_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r2),
v AS (SELECT *, coalesce(r, CASE WHEN d = seen THEN 'duplicate_date' WHEN d < seen THEN 'non_increasing_date' END) AS reason, CASE WHEN k = 14 THEN 0 ELSE l_quantity END AS volume FROM r3)"""
_SPANS = _bars() + ",\nsp AS (SELECT instrument_id, ticker, exchange, min(date) AS first, max(date) AS last, count(*) AS rows FROM bars GROUP BY ALL)"
_INT = "(year({0}) * 10000 + month({0}) * 100 + day({0}))::INT"
_SIG = "candidate_id, instrument_id, signal_date, entry_date, historical_entry_status, round(raw_setup_strength, 6) AS raw_setup_strength"
_METRICS = ["spearman", "mean_return", "top_return", "bottom_return", "base_target_rate", "top_target_rate", "auc", "top_minus_mean", "top_minus_bottom", "top_target_rate_lift"]
w = lambda ctes, q: f"WITH {ctes.strip()}\n{q}"
_CONFIG = json.dumps({"maximum_atr_14_pct": 2.0, "minimum_history_bars": 60, "minimum_log_dollar_volume": 5.0, "minimum_return_20": -1.0, "pullback_from_high_max": 0.5, "pullback_from_high_min": -0.9}, separators=(",", ":"))
_ROWS = f""",
cr AS (SELECT candidate_id, 'candidate_schema_v1.0.0' AS candidate_schema_version, instrument_id, ticker, exchange, 'stocks' AS instrument_class, signal_date, source_row_number AS signal_source_row_number, segment_id AS signal_segment_id,
  'trend_pullback' AS setup_family, 'v1.0.0' AS setup_version, direction, 'signal_close' AS decision_time, 'next_valid_session_open' AS earliest_entry_rule, entry_date AS earliest_entry_date, historical_entry_status, raw_setup_strength,
  '{{"public_demo":true}}' AS generator_payload_json, '{hashlib.sha256(_CONFIG.encode()).hexdigest()}' AS generator_config_sha256, 'feature_schema_v1.0.0' AS feature_schema_version, '{"0" * 64}' AS feature_dataset_sha256 FROM sg)"""
_VALID = ",\nfs AS (SELECT setup_family, fold, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'test') AS test_rows, count(DISTINCT CASE WHEN part = 'train' THEN y_target END) AS k FROM me GROUP BY 1, 2)," + """
st AS (SELECT *, CASE WHEN train_rows < 100 OR test_rows < 30 THEN 'insufficient_rows' WHEN k < 2 THEN 'single_class_train' ELSE 'valid' END AS status FROM fs),
te AS (SELECT * FROM me WHERE part = 'test' AND (setup_family, fold) IN (SELECT (setup_family, fold) FROM st WHERE status = 'valid'))"""


def _checks(ctes: str, src: str, **rules: str) -> str:
    """How many rows of ``src`` fulfil each condition."""
    return w(ctes, " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) FILTER ({e}) AS violations FROM {src}" for n, e in rules.items()))


def _causal(n: int) -> str:
    """The demo's signals of the first n bars alone beside those of all bars."""
    own = lambda first: f"SELECT instrument_id, date, place, {_DEMO_MASK} AS m, {_DEMO_STRENGTH} AS s FROM ft"
    part, full = (w(_bars("region", 200, k) + _SEG + _features(), own(k)) for k in (n, 0))
    return f"SELECT {n}::INT AS checkpoint, count(*) AS compared, count(*) FILTER (a.m IS DISTINCT FROM b.m OR (a.m AND NOT coalesce(abs(a.s - b.s) <= 1e-12, a.s IS NULL AND b.s IS NULL))) AS violations FROM ({part}) a FULL JOIN (SELECT * FROM ({full}) WHERE place <= {n}) b USING (instrument_id, date)"


_DAY = "signal_date % 100"

SQL = {
    "barrier_results": w(_FT + _ENT + _DEMO + _OC, "SELECT barrier_2r_20_result, count(*) AS n, round(avg(h20_directional_close_return), 6) AS mean_h20_return FROM oc GROUP BY 1"),
    **{f"bars_{by}_daily": w(_bars(by), f"SELECT instrument_id, signal_date, source_row_number, {_R(['open', 'high', 'low', 'close', 'volume']).replace(', 6)', ', 8)')} FROM bars") for by in ("supplier", "region")},
    "classify_paths": "SELECT DISTINCT 'data/daily/us/nyse stocks/1/s' || l_suppkey || '.us.txt' AS member, 'NYSE' AS exchange, 'stocks' AS instrument_class, 'S' || l_suppkey AS ticker, 'US:NYSE:STOCKS:S' || l_suppkey AS instrument_id FROM lineitem",
    "validate_rows": w(_LINES, "SELECT member, row_number, coalesce(reason, 'valid') AS reason FROM v"),
    "zip_validate": w(_LINES, "SELECT member, row_number, coalesce(reason, 'valid') AS reason FROM v UNION ALL SELECT 'data/daily/us/nyse stocks/1/odd.us.txt', 2, 'invalid_header'"),
    "symbol_manifest": w(_LINES + """,
m AS (SELECT *, abs(p / lag(p) OVER (PARTITION BY member ORDER BY row_number) - 1) AS mv FROM v WHERE reason IS NULL),
e AS (SELECT member, count(*) FILTER (mv > 0.5) AS x50, count(*) FILTER (mv > 1.0) AS x100, round(max(mv), 6) AS mx FROM m GROUP BY 1)""", f"""SELECT member AS source_member, 'US:NYSE:STOCKS:' || upper(regexp_extract(member, '/(s[0-9]+)[.]us', 1)) AS instrument_id, true AS header_valid, false AS empty_file, count(*) AS row_count, count(*) FILTER (reason IS NULL) AS valid_row_count,
  count(*) FILTER (reason IS NOT NULL) AS invalid_row_count, strftime(min(d) FILTER (reason IS NULL), '%Y-%m-%d') AS first_date, strftime(max(d) FILTER (reason IS NULL), '%Y-%m-%d') AS last_date, count(*) FILTER (reason IS NULL AND volume = 0) AS zero_volume_count,
  coalesce(max(x50), 0) AS extreme_return_50_count, coalesce(max(x100), 0) AS extreme_return_100_count, max(mx) AS max_abs_return, round(min(p) FILTER (reason IS NULL), 6) AS min_close, round(max(p) FILTER (reason IS NULL), 6) AS max_close FROM v LEFT JOIN e USING (member) GROUP BY member
UNION ALL SELECT 'data/daily/us/nyse stocks/1/empty.us.txt', 'US:NYSE:STOCKS:EMPTY', false, true, 0, 0, 0, NULL, NULL, 0, 0, 0, NULL, NULL, NULL
UNION ALL SELECT 'data/daily/us/nyse stocks/1/odd.us.txt', 'US:NYSE:STOCKS:ODD', false, false, 1, 0, 1, NULL, NULL, 0, 0, 0, NULL, NULL, NULL"""),
    "load_valid": w(_LINES, f"SELECT member, row_number, {_INT.format('d')} AS date, floor(p / 10)::BIGINT AS open_tens, floor(high / 10)::BIGINT AS high_tens, floor(p / 10)::BIGINT AS close_tens, round(volume, 6) AS volume FROM v WHERE reason IS NULL"),
    "quarantine": w(_LINES + """,
t AS (SELECT *, concat_ws(',', CASE WHEN k = 3 THEN 'XYZ.US' ELSE 'S' || regexp_extract(member, '/s([0-9]+)[.]us', 1) || '.US' END, CASE WHEN k = 4 THEN 'W' ELSE 'D' END, CASE WHEN k = 6 THEN '20210229' ELSE strftime(d, '%Y%m%d') END, CASE WHEN k = 5 THEN '093000' ELSE '000000' END,
  CASE WHEN k = 7 THEN 'nan' WHEN k = 8 THEN '-1' ELSE p::VARCHAR END, CASE WHEN k = 11 THEN '0.01' WHEN k = 12 THEN '9999999' ELSE p::VARCHAR END, CASE WHEN k = 12 THEN '9999998' ELSE p::VARCHAR END, CASE WHEN k = 2 THEN 'abc' ELSE p::VARCHAR END,
  CASE WHEN k = 9 THEN 'inf' WHEN k = 10 THEN '-5' WHEN k = 14 THEN '0' ELSE l_quantity::VARCHAR END, CASE WHEN k = 1 THEN '0,0' ELSE '0' END) AS line FROM v)""", "SELECT member, row_number, reason, left(line, 16) AS preview FROM t WHERE reason IS NOT NULL"),
    "select_universe": w(_SPANS, "SELECT instrument_id, exchange, 'stocks' AS instrument_class, rows AS valid_row_count FROM sp WHERE lower(exchange) = 'asia'"),
    "store_verify": w(_bars(), "SELECT instrument_id, count(*) AS rows, round(sum(volume), 4) AS volume, true AS verified, 0::BIGINT AS duplicate_keys, (SELECT count(*) FROM bars WHERE signal_date % 100 = 13) AS protected_rows FROM bars GROUP BY 1"),
    "store_compare": w(_bars(), "SELECT count(*) FILTER (signal_date % 100 IN (13, 14)) AS only_a, count(*) FILTER (signal_date % 100 = 14) AS only_b FROM bars"),
    "pending_work": w(_SPANS, "SELECT generator_key, instrument_id FROM sp, (VALUES ('every_bar|v1.0.0|LONG'), ('every_bar|v1.0.0|SHORT')) g(generator_key)"),
    "csv_values": w(_bars("region"), "SELECT instrument_id, signal_date, printf('%.12g', close) AS close, printf('%.12g', volume / 7e9) AS small, printf('%.12g', close * 1e9) AS large FROM bars"),
    "reason_histogram": w(_LINES, "SELECT reason, count(*) AS rows FROM v WHERE reason IS NOT NULL GROUP BY 1"),
    "member_summary": w(_LINES, f"""SELECT member, count(*) AS row_count, count(*) FILTER (reason IS NULL) AS valid_rows, count(*) FILTER (reason IS NOT NULL) AS invalid_rows, min({_INT.format('d')}) FILTER (reason IS NULL) AS first_date,
  max({_INT.format('d')}) FILTER (reason IS NULL) AS last_date, count(*) FILTER (reason IS NULL AND volume = 0) AS zero_volume, round(min(p) FILTER (reason IS NULL), 6) AS min_close, round(max(p) FILTER (reason IS NULL), 6) AS max_close FROM v GROUP BY member"""),
    "extreme_moves": w(_LINES + ",\nm AS (SELECT member, abs(p / lag(p) OVER (PARTITION BY member ORDER BY row_number) - 1) AS mv FROM v WHERE reason IS NULL)", "SELECT member, count(*) FILTER (mv > 0.5) AS over_50, count(*) FILTER (mv > 1.0) AS over_100, round(max(mv), 6) AS largest FROM m GROUP BY member"),
    "survivor_fraction": w(_SPANS, "SELECT count(*) AS instruments, count(*) FILTER (last >= (SELECT max(last) FROM sp) - 10) AS survivors, round(count(*) FILTER (last >= (SELECT max(last) FROM sp) - 10) / count(*), 6) AS fraction FROM sp"),
    "top_last_dates": w(_SPANS, f"SELECT {_INT.format('last')} AS last_date, count(*) AS n FROM sp GROUP BY 1 ORDER BY n DESC, last_date LIMIT 20"),
    "duplicate_tickers": w(_SPANS, "SELECT ticker::BIGINT % 7 AS short, string_agg(instrument_id, '|' ORDER BY instrument_id) AS ids, count(*) AS n FROM sp GROUP BY 1 HAVING count(*) > 1"),
    "dedupe_last_wins": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "universe_filter": w(_SPANS, "SELECT instrument_id, rows FROM sp WHERE lower(exchange) = 'asia' AND rows > 10"),
    "segments": w(_bars(gap=200) + _SEG, "SELECT instrument_id, signal_date, source_gap_rows, calendar_gap_days, segment_reset, segment_id, history_bars FROM seg"),
    "segment_summary": w(_bars(gap=200) + _SEG, "SELECT instrument_id, count(*) AS bars, count(DISTINCT segment_id) AS segments, count(*) FILTER (NOT is_first AND source_gap_rows > 0) AS source_gap_resets, count(*) FILTER (NOT is_first AND calendar_gap_days > 30) AS calendar_gap_resets FROM seg GROUP BY 1"),
    **{f"feat_{g}": w(_bars("region", 200) + _SEG + _features(), f"SELECT instrument_id, signal_date, {_R(names)} FROM ft") for g, names in ft.GROUPS.items()},
    "feature_quality": w(_FT, " UNION ALL ".join(f"SELECT '{n}' AS feature, count({n}) AS valid, count(*) - count({n}) AS missing, round(count({n}) / count(*), 6) AS valid_fraction FROM ft" for n in ft.NAMES)),
    "demo_candidates": w(_FT + _ENT + _DEMO, f"SELECT {_SIG} FROM sg"),
    "probe_candidates": w(_FT + _ENT + _PROBE, f"SELECT {_SIG} FROM sg"),
    "entry_alignment": w(_bars(gap=200) + _SEG + _ENTRY.format(src="seg"), "SELECT instrument_id, signal_date, CASE WHEN historical_entry_status = 'available' THEN nd END AS entry_date, CASE WHEN historical_entry_status = 'available' THEN nr END AS entry_source_row_number, historical_entry_status FROM ent"),
    "candidate_diagnostics": w(_FT + _ENT + _DEMO + ",\npd AS (SELECT signal_date, count(*) AS n FROM sg GROUP BY 1)", """SELECT (SELECT count(*) FROM sg) AS candidate_count, (SELECT count(DISTINCT instrument_id) FROM sg) AS instruments_with_candidates, (SELECT count(*) FROM pd) AS dates_with_candidates,
  (SELECT max(n) FROM pd) AS max_on_one_date, (SELECT median(n) FROM pd) AS median_on_active_date, (SELECT count(*) FROM ft) AS eligible_bar_count, (SELECT count(DISTINCT instrument_id) FROM ft) AS instrument_count,
  round((SELECT count(*) FROM sg) * 1000.0 / (SELECT count(*) FROM ft), 6)::DOUBLE AS per_1000_bars"""),
    "candidate_counts": w(_FT + _ENT + _DEMO, " UNION ALL ".join(f"SELECT '{k}' AS kind, {e} AS value, count(*) AS n FROM sg GROUP BY 2" for k, e in (("entry_status", "historical_entry_status"), ("year", "(signal_date // 10000)::VARCHAR"), ("exchange", "exchange"), ("instrument_class", "'stocks'")))),
    "candidate_rows": w(_FT + _ENT + _DEMO + _ROWS, "SELECT * REPLACE (CASE WHEN round(raw_setup_strength, 6) = 0 THEN 0 ELSE round(raw_setup_strength, 6) END AS raw_setup_strength) FROM cr"),
    "candidate_checks": _checks(
        _FT + _ENT + _DEMO + _ROWS + ",\nd AS (SELECT *, signal_date % 20 AS k, historical_entry_status = 'available' AS a FROM cr)", "d", schema_version="k = 0", direction="k = 1", decision_time="k = 2", entry_rule="k = 3", entry_status="k = 4",
        entry_date="a AND k IN (4, 5)", entry_after_signal="a AND k = 9", strength="k = 6", payload="k = 7", candidate_id="k IN (1, 8)",
    ),
    "context_checks": _checks(_bars(gap=200), "bars", only_bars="day(date) = 13", only_features="false", row_lineage="day(date) = 14", increasing_dates="false"),
    "bar_checks": _checks(
        _FT + _ENT + _EVERY, "sg", missing_bar=f"{_DAY} = 9", signal_date="false", segment=f"{_DAY} = 3", entry_exists=f"historical_entry_status = 'available' AND {_DAY} = 9", entry_date=f"historical_entry_status = 'available' AND {_DAY} IN (5, 9)",
        entry_row=f"historical_entry_status = 'available' AND {_DAY} IN (7, 9)",
    ),
    "outcome_checks": _checks(
        _FT + _ENT + _EVERY + _OC, "oc", direction=f"{_DAY} = 1", ticker_split=f"{_DAY} = 2", temporal_partition="false", entry_status="false", termination="false", entry_values=f"historical_entry_status = 'available' AND {_DAY} = 3", entry_after_signal="false",
        no_entry=f"historical_entry_status <> 'available' AND {_DAY} = 4", finite="false", barrier_result=f"{_DAY} = 6", barrier_bars=f"({_DAY} = 5 AND barrier_2r_20_bars_to_event IS NOT NULL) OR ({_DAY} = 6 AND barrier_1r_20_bars_to_event IS NOT NULL)",
    ),
    "leakage_checks": _checks(_FT + _ENT + _FAMILIES, "sg", protected_ticker=f"{_SPLIT} <> 'development'", protected_period=f"{_PERIOD} IN ('pseudo_lockbox_2024_2026', 'future_out_of_policy')", duplicate_id="false"),
    "family_counts": w(_RESEARCH + ",\nc AS (SELECT instrument_id, setup_family, count(*) AS n FROM rs GROUP BY 1, 2)", """SELECT instrument_id, sum(n)::BIGINT AS rows, '{' || string_agg('"' || setup_family || '":' || n, ',' ORDER BY setup_family) || '}' AS family_counts_json FROM c GROUP BY 1"""),
    "prefix_causality": " UNION ALL ".join(_causal(n) for n in (50, 120, 300)),
    "prefix_causality_peek": w(_bars("region", 200) + _SEG + _features() + ",\nc AS (SELECT instrument_id, count(*) AS n FROM ft GROUP BY 1)", " UNION ALL ".join(f"SELECT {k}::INT AS checkpoint, (SELECT sum(least(n, {k})) FROM c)::BIGINT AS compared, (SELECT count(*) FROM ft WHERE place = {k} + 1 AND return_1 > 0) AS violations" for k in (50, 120, 300))),
    "combine_union": w(_FT, f"SELECT 'trend_pullback' AS setup_family, 'LONG' AS direction, count(*) AS n FROM ft WHERE {_DEMO_MASK} UNION ALL SELECT 'every_bar', 'LONG', count(*) FROM ft UNION ALL SELECT 'every_bar', 'SHORT', count(*) FROM ft"),
    "outcome_core": w(_FT + _ENT + _EVERY + _OC, f"SELECT candidate_id, same_segment_bars_available, termination, {_R(['entry_open', 'entry_gap_return_raw', 'signal_atr_14_abs'])} FROM oc"),
    **{f"outcome_horizons_{n}": w(_FT + _ENT + s + _OC, f"SELECT {_HORIZON} FROM oc") for n, s in (("long", _EVERY), ("short", _EVERY_SHORT))},
    **{f"first_touch_{n}": w(_FT + _ENT + s + _OC, f"SELECT {_TOUCH} FROM oc") for n, s in (("long", _EVERY), ("short", _EVERY_SHORT))},
    **{f"barriers_{n}": w(_FT + _ENT + s + _OC, f"SELECT {_BARRIER} FROM oc") for n, s in (("long", _EVERY), ("short", _EVERY_SHORT))},
    "outcome_accounting": w(_FT + _ENT + _EVERY + _OC, "SELECT instrument_id, count(*) AS outcomes, count(*) FILTER (historical_entry_status = 'available') AS available, count(*) FILTER (termination = 'no_entry') AS no_entry, count(*) FILTER (termination = 'complete_60') AS complete_60 FROM oc GROUP BY 1"),
    "ticker_split": w(_SPANS, f"SELECT instrument_id, {_SPLIT} AS ticker_split FROM sp"),
    "temporal_partition": w(_bars(), f"SELECT {_PERIOD} AS temporal_partition, count(*) AS bars FROM bars GROUP BY 1"),
    "research_join": w(_RESEARCH, f"SELECT candidate_id, setup_family, ticker_split, temporal_partition, barrier_2r_20_result, {_R(['raw_setup_strength', 'return_20', 'atr_14_pct', 'y_return'])} FROM rs"),
    "anti_missing_outcomes": w(_FT + _ENT + _EVERY + _OC, "SELECT ticker, count(*) AS n FROM oc WHERE termination <> 'complete_60' GROUP BY 1"),
    "universe_diff": "SELECT (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)) AS without_bars, (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)) AS unknown",
    "walkforward_folds": w(_RESEARCH + _MEM, "SELECT setup_family, fold, part, count(*) AS n, min(signal_date) AS first, max(signal_date) AS last, round(avg(y_target), 6) AS target_rate FROM me GROUP BY 1, 2, 3"),
    "fold_status": w(_RESEARCH + _MEM + _VALID, """SELECT st.setup_family, st.fold, train_rows, test_rows, status, min(signal_date) FILTER (part = 'train') AS train_start, max(h20_end_date) FILTER (part = 'train') AS train_last_label_date,
  min(signal_date) FILTER (part = 'test') AS test_start, max(h20_end_date) FILTER (part = 'test') AS test_last_label_date, round(avg(y_target) FILTER (part = 'test'), 6) AS test_target_rate FROM st JOIN me ON me.setup_family = st.setup_family AND me.fold = st.fold GROUP BY 1, 2, 3, 4, 5"""),
    "rank_metrics": w(_RESEARCH + _MEM + _VALID + _rank("te", "setup_family, fold", "rk"), f"SELECT setup_family, fold, n, {_R(_METRICS)} FROM rk"),
    "auc": w(_RESEARCH + _MEM + _VALID + _rank("te", "setup_family, fold", "rk"), "SELECT setup_family, fold, n, round(auc, 6) AS auc FROM rk"),
    "brier": w(_RESEARCH + _MEM + _VALID, "SELECT setup_family, fold, round(avg(pow(1 / (1 + exp(-raw_setup_strength)) - y_target, 2)), 6) AS brier FROM te GROUP BY 1, 2"),
    "gate_decision": w(_RESEARCH + _MEM + _VALID + _rank("te", "setup_family, fold", "rk") + _rank("te", "setup_family", "al") + """,
c AS (SELECT setup_family, count(*) FILTER (spearman >= 0) AS a, count(*) FILTER (top_minus_mean > 0) AS b, count(*) FILTER (auc >= 0.5) AS c, count(*) FILTER (top_target_rate >= base_target_rate) AS d FROM rk GROUP BY 1),
g AS (SELECT setup_family, coalesce(spearman >= 0.015::DOUBLE AND top_return > 0 AND top_minus_mean >= 0.005::DOUBLE AND b >= 4 AND a >= 3, false) AS regression_pass, coalesce(auc >= 0.515::DOUBLE AND top_target_rate_lift >= 1.08::DOUBLE AND d >= 4 AND c >= 3, false) AS classification_pass, a, b, c, d, n FROM al JOIN c USING (setup_family)),
v AS (SELECT setup_family, count(*) FILTER (status = 'valid') AS valid_folds FROM st GROUP BY 1)""",
        "SELECT setup_family, regression_pass, classification_pass, a AS nonnegative_spearman_folds, b AS positive_top_lift_folds, c AS auc_ge_half_folds, d AS top_above_base_folds, n AS oof_rows, valid_folds, regression_pass OR classification_pass AS evidence_pass, n >= 1000 AND valid_folds >= 2 AS sufficient_sample, CASE WHEN n >= 1000 AND valid_folds >= 2 AND (regression_pass OR classification_pass) THEN 'PROCEED_TO_SPECIALIST_RESEARCH' ELSE 'BASELINE_INCONCLUSIVE' END AS decision FROM g JOIN v USING (setup_family)"),
    "impute_standardize": w(_RESEARCH + "".join(f""",
i{k} AS (SELECT candidate_id, coalesce({c}, (SELECT coalesce(median({c}), 0) FROM ev)) AS a, ({c} IS NULL)::INT AS m FROM ev),
j{k} AS (SELECT candidate_id, round((a - avg(a) OVER ()) / coalesce(nullif(stddev_pop(a) OVER (), 0), 1), 6) AS {c}, CASE WHEN max(m) OVER () = 1 THEN round((m - avg(m) OVER ()) / coalesce(nullif(stddev_pop(m) OVER (), 0), 1), 6) END AS missing_{c} FROM i{k})""" for k, c in enumerate(("close_location", "return_252"))),
        "SELECT candidate_id, " + ", ".join(f"CASE WHEN {n} = 0 THEN 0 ELSE {n} END AS {n}" for c in ("close_location", "return_252") for n in (c, f"missing_{c}")) + " FROM j0 JOIN j1 USING (candidate_id)"),
    "fingerprint": w(_bars() + ",\ne AS (SELECT instrument_id, count(*) AS n, sha256(string_agg(instrument_id || '|' || signal_date || '|' || source_row_number, chr(10) ORDER BY instrument_id || '|' || signal_date || '|' || source_row_number)) AS h FROM bars GROUP BY 1)", "SELECT sum(n)::BIGINT AS n, sha256(string_agg(instrument_id || ':' || h, chr(10) ORDER BY instrument_id || ':' || h)) AS content_sha256 FROM e"),
}
