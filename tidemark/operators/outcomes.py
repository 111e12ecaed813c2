"""What followed each signal: returns, excursions, first touches and barriers, inside the entry's segment and 60 bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .signals import count_checks

#: Horizons, targets in units of risk, the stop in average ranges, barriers as (target, bars), split policy.
HORIZONS = (1, 3, 5, 10, 20, 40, 60)
TARGETS = (1, 2, 3, 5)
STOP_ATR = 1.5
BARRIERS = ((1, 20), (2, 20), (3, 20), (5, 40))
LONGEST = 60
SPLIT_POLICY = "split_policy_v1.0.0"
SPLITS = ((7000, "development"), (8500, "integration_holdout"))
PERIODS = (
    (20121231, "development_pre2013"), (20141231, "walkforward_2013_2014"), (20161231, "walkforward_2015_2016"), (20181231, "walkforward_2017_2018"), (20201231, "walkforward_2019_2020"),
    (20221231, "walkforward_2021_2022"), (20231231, "walkforward_2023"), (20261231, "pseudo_lockbox_2024_2026"),
)


def ticker_split(instrument: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{SPLIT_POLICY}|"), instrument), 256)
    bucket = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % 10000
    return F.when(bucket < SPLITS[0][0], SPLITS[0][1]).when(bucket < SPLITS[1][0], SPLITS[1][1]).otherwise("final_ticker_holdout")


def temporal_partition(date: Column) -> Column:
    out = None
    for top, name in PERIODS:
        out = F.when(date <= top, name) if out is None else out.when(date <= top, name)
    return out.otherwise("future_out_of_policy")


def forward(bars: DataFrame) -> DataFrame:
    """Bars with their forward frames, in the order the features already have: no exchange of its own after them.

    The path of 60 bars is needed for first touches only; it stays in this stage when signals come from the same frame.
    """
    w = Window.partitionBy("instrument_id", "segment_id").orderBy("date")
    ahead = lambda a, b: w.rowsBetween(a, b)
    cols = {
        "_avail": F.count("*").over(ahead(1, Window.unboundedFollowing)),
        "_entry": F.lead("open").over(w),
        "_last": F.max("segment_id").over(Window.partitionBy("instrument_id")),
        "_date": F.lead("signal_date").over(w),
        "_row": F.lead("source_row_number").over(w),
        "_close": F.col("close"),
        "_atr": F.col("atr_14_pct"),
    }
    for h in HORIZONS:
        cols |= {f"_c{h}": F.lead("close", h).over(w), f"_d{h}": F.lead("signal_date", h).over(w), f"_h{h}": F.max("high").over(ahead(1, h)), f"_l{h}": F.min("low").over(ahead(1, h))}
    for name, c in (("_highs", "high"), ("_lows", "low"), ("_days", "signal_date")):
        cols[name] = F.collect_list(c).over(ahead(1, LONGEST))
    return bars.withColumns(cols)


#: Checks of a signal against its bar: name and what must hold.
BAR_CHECKS = {
    "missing_bar": "_bar is not null",
    "signal_date": "_bar is null or signal_date = _bar",
    "segment": "_bar is null or segment_id = _segment",
    "entry_exists": "historical_entry_status <> 'available' or _row is not null",
    "entry_date": "historical_entry_status <> 'available' or entry_date <=> _date",
    "entry_row": "historical_entry_status <> 'available' or entry_source_row_number <=> _row",
}


def with_bars(signals: DataFrame, ahead: DataFrame) -> DataFrame:
    """Signals beside the forward frames of their bars; columns of a signal without bar are null."""
    keep = ["instrument_id", F.col("source_row_number").alias("signal_source_row_number"), F.col("signal_date").alias("_bar"), F.col("segment_id").alias("_segment")]
    # only bars of signals go through the join with their paths
    used = signals.select("instrument_id", F.col("signal_source_row_number").alias("source_row_number")).distinct()
    ahead = ahead.join(used, ["instrument_id", "source_row_number"], "left_semi")
    ahead = ahead.select(*keep, *(c for c in ahead.columns if c.startswith("_")))
    return signals.join(ahead, ["instrument_id", "signal_source_row_number"], "left")


def bar_violations(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """``check, violations``: signals whose bar, segment or entry is not the one they name."""
    rows = with_bars(signals, forward(bars))
    return count_checks(rows, BAR_CHECKS)


def outcomes(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """One row for each signal. First touches search arrays of at most 60 following bars, so no row is multiplied.

    The join is on instrument and row, which is unique in bars. A signal that fails one of ``BAR_CHECKS`` is fatal. A signal
    without an entry has null metrics.
    """
    rows = with_bars(signals, forward(bars))
    for name, rule in BAR_CHECKS.items():
        rows = rows.withColumn("_ok", F.assert_true(F.coalesce(F.expr(rule), F.lit(False)), F.lit(f"a signal fails the check {name}"))).filter(F.col("_ok").isNull())
    return label(rows.drop("_ok"))


def label(rows: DataFrame) -> DataFrame:
    """Labels of signal rows that carry the columns of ``forward``."""
    ok = F.col("historical_entry_status") == "available"
    long = F.col("direction") == "LONG"
    entry = F.when(ok, F.col("_entry"))
    atr = F.col("_close") * F.col("_atr")
    rows = rows.withColumns({
        "entry_open": entry,
        "same_segment_bars_available": F.when(ok, F.col("_avail")).otherwise(0).cast("long"),
        "entry_gap_return_raw": F.when(ok, F.try_divide(F.col("_entry"), F.col("_close")) - 1),
        "signal_atr_14_abs": F.when(ok & ~F.isnan(atr) & (atr > 0) & (atr < float("inf")), atr),
    })
    n, e = F.col("same_segment_bars_available"), F.col("entry_open")
    rows = rows.withColumn("termination", F.when(~ok, "no_entry").when(n >= LONGEST, "complete_60").when(F.col("segment_id") < F.col("_last"), "segment_boundary").otherwise("end_of_history"))
    sign = F.when(long, F.lit(1.0)).otherwise(F.lit(-1.0))
    out = {}
    for h in HORIZONS:
        have = ok & (n >= h)
        up, down = F.col(f"_h{h}") / e - 1, F.col(f"_l{h}") / e - 1
        out[f"h{h}_end_date"] = F.when(have, F.col(f"_d{h}"))
        out[f"h{h}_directional_close_return"] = F.when(have, sign * (F.col(f"_c{h}") / e - 1))
        out[f"h{h}_directional_mfe"] = F.when(have, F.when(long, up).otherwise(-down))
        out[f"h{h}_directional_mae"] = F.when(have, F.when(long, down).otherwise(-up))
    risk = STOP_ATR * F.col("signal_atr_14_abs")

    def first(adverse: bool, distance: Column) -> Column:
        """1-based position of the first bar that reaches the level; null if none does."""
        level = F.when(long, e - distance if adverse else e + distance).otherwise(e + distance if adverse else e - distance)
        above = F.array_position(F.transform("_highs", lambda x: x >= level), True)
        below = F.array_position(F.transform("_lows", lambda x: x <= level), True)
        return F.nullif(F.when(long, below if adverse else above).otherwise(above if adverse else below), F.lit(0).cast("long"))

    with_risk = ok & F.col("signal_atr_14_abs").isNotNull()
    out["stop_first_bar"] = F.when(with_risk, first(True, risk))
    for r in TARGETS:
        out[f"target_{r}r_first_bar"] = F.when(with_risk, first(False, r * risk))
    rows = rows.withColumns(out)
    more = {}
    for name in ("stop", *(f"target_{r}r" for r in TARGETS)):
        at = F.col(f"{name}_first_bar")
        more[f"{name}_first_date"] = F.when(at.isNotNull(), F.element_at("_days", at.cast("int")))
    for r, hold in BARRIERS:
        stop, target = (F.when(F.col(c) <= hold, F.col(c)) for c in ("stop_first_bar", f"target_{r}r_first_bar"))
        stopped = stop.isNotNull() & (target.isNull() | (stop <= target))
        result = F.when(~ok, "no_entry").when(F.col("signal_atr_14_abs").isNull(), "unavailable_atr").when(stopped, "stop").when(target.isNotNull(), "target").when(n >= hold, "timeout").otherwise("incomplete")
        more[f"barrier_{r}r_{hold}_result"] = result
        more[f"barrier_{r}r_{hold}_bars_to_event"] = F.when(with_risk, F.when(stopped, stop).when(target.isNotNull(), target).when(n >= hold, F.lit(hold)))
    rows = rows.withColumns(more).withColumns({"ticker_split": ticker_split(F.col("instrument_id")), "temporal_partition": temporal_partition(F.col("signal_date"))})
    return rows.drop(*(c for c in rows.columns if c.startswith("_")))


#: Checks of an outcome row: name and what must hold. A null result counts as a violation.
OUTCOME_CHECKS = {
    "direction": "direction in ('LONG', 'SHORT')",
    "ticker_split": "ticker_split in ('development', 'integration_holdout', 'final_ticker_holdout')",
    "temporal_partition": f"temporal_partition in {tuple(n for _, n in PERIODS) + ('future_out_of_policy',)}",
    "entry_status": "historical_entry_status in ('available', 'no_later_bar', 'next_bar_new_segment')",
    "termination": "termination in ('complete_60', 'segment_boundary', 'end_of_history', 'no_entry')",
    "entry_values": "historical_entry_status <> 'available' or (entry_date is not null and entry_source_row_number is not null and entry_open is not null and entry_gap_return_raw is not null)",
    "entry_after_signal": "historical_entry_status <> 'available' or entry_date > signal_date",
    "no_entry": "historical_entry_status = 'available' or (termination = 'no_entry' and same_segment_bars_available = 0)",
    "finite": " and ".join(f"({c} is null or (not isnan({c}) and abs({c}) < double('inf')))" for c in ("raw_setup_strength", "entry_open", "entry_gap_return_raw", "signal_atr_14_abs", *(f"h{h}_directional_{x}" for h in HORIZONS for x in ("close_return", "mfe", "mae")))),
    "barrier_result": " and ".join(f"barrier_{r}r_{h}_result in ('target', 'stop', 'timeout', 'incomplete', 'unavailable_atr', 'no_entry')" for r, h in BARRIERS),
    "barrier_bars": " and ".join(f"((barrier_{r}r_{h}_result in ('target', 'stop', 'timeout')) = (barrier_{r}r_{h}_bars_to_event is not null))" for r, h in BARRIERS),
}


def outcome_violations(rows: DataFrame) -> DataFrame:
    """``check, violations`` of outcome rows."""
    return count_checks(rows, OUTCOME_CHECKS)


def accounting(rows: DataFrame) -> DataFrame:
    return rows.groupBy("instrument_id").agg(
        F.count("*").alias("outcomes"), F.count_if(F.col("historical_entry_status") == "available").alias("available"), F.count_if(F.col("termination") == "no_entry").alias("no_entry"), F.count_if(F.col("termination") == "complete_60").alias("complete_60")
    )
