"""Segments and the 36 trailing features. Frames stay inside (instrument, segment); undefined values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_GAP_DAYS = 30
#: Names and windows of the features.
RETURNS = (1, 5, 10, 20, 60, 120, 252)
AVERAGES = (10, 20, 50, 100, 200)
VOLATILITIES = (10, 20, 60)
EXTREMES = (20, 60, 252)
PATHS = (20, 60)
GROUPS = {
    "bar": ("intraday_return", "gap_return", "high_low_range_pct", "true_range_pct", "close_location", "body_to_range"),
    "returns": tuple(f"return_{w}" for w in RETURNS),
    "sma": tuple(f"sma_distance_{w}" for w in AVERAGES),
    "vol": (*(f"realized_vol_{w}" for w in VOLATILITIES), "atr_14_pct"),
    "volume": ("volume_ratio_20_prior", "log_dollar_volume_20_prior"),
    "location": (*(f"distance_to_prior_high_{w}" for w in EXTREMES), *(f"distance_to_prior_low_{w}" for w in EXTREMES)),
    "path": (*(f"efficiency_ratio_{w}" for w in PATHS), *(f"up_fraction_{w}" for w in PATHS)),
    "contraction": ("range_ratio_5_20", "realized_vol_ratio_10_60"),
}
NAMES = tuple(n for g in GROUPS.values() for n in g)


def segments(bars: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    """Adds gaps, ``segment_reset``, ``segment_id`` (from 0) and ``history_bars`` (from 1).

    A segment ends where a source row is missing or more than ``max_gap_days`` calendar days lie between bars.
    """
    w = Window.partitionBy("instrument_id").orderBy("date")
    gaps = bars.withColumn("source_gap_rows", F.coalesce(F.greatest(F.col("source_row_number") - F.lag("source_row_number").over(w) - 1, F.lit(0)), F.lit(0)))
    gaps = gaps.withColumn("calendar_gap_days", F.coalesce(F.datediff("date", F.lag("date").over(w)), F.lit(0)))
    first = F.lag("date").over(w).isNull()
    gaps = gaps.withColumn("segment_reset", (first | (F.col("source_gap_rows") > 0) | (F.col("calendar_gap_days") > max_gap_days)).cast("int"))
    gaps = gaps.withColumn("segment_id", (F.sum("segment_reset").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    own = Window.partitionBy("instrument_id", "segment_id").orderBy("date")
    return gaps.withColumn("history_bars", F.row_number().over(own))


def increasing(bars: DataFrame) -> DataFrame:
    """``bars``; fatal if an instrument's dates repeat or do not rise with its row numbers."""
    w = Window.partitionBy("instrument_id").orderBy("source_row_number")
    checked = bars.withColumn("_before", F.lag("date").over(w))
    ok = F.assert_true(F.col("_before").isNull() | (F.col("date") > F.col("_before")), F.concat(F.lit("dates do not rise: "), "instrument_id"))
    return checked.withColumn("_ok", ok).filter(F.col("_ok").isNull()).drop("_before", "_ok")


def segment_summary(segmented: DataFrame, max_gap_days: int = MAX_GAP_DAYS) -> DataFrame:
    later = F.col("source_row_number") > F.col("first_row")
    first = segmented.groupBy("instrument_id").agg(F.min("source_row_number").alias("first_row"))
    return segmented.join(first, "instrument_id").groupBy("instrument_id").agg(
        F.count("*").alias("bars"),
        F.countDistinct("segment_id").alias("segments"),
        F.count_if(later & (F.col("source_gap_rows") > 0)).alias("source_gap_resets"),
        F.count_if(later & (F.col("calendar_gap_days") > max_gap_days)).alias("calendar_gap_resets"),
    )


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def safe(n: Column, d: Column) -> Column:
    return finite(F.try_divide(n, d))


def features(segmented: DataFrame) -> DataFrame:
    """``segmented`` with the 36 features. One window specification serves every frame: one exchange and one sort."""
    w = Window.partitionBy("instrument_id", "segment_id").orderBy("date")
    trail = lambda k: w.rowsBetween(-(k - 1), 0)
    prior = lambda k: w.rowsBetween(-k, -1)
    o, h, l, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))  # noqa: E741
    at = F.col("history_bars")
    since = lambda k, e: F.when(at >= k, e)
    before = F.lag("close").over(w)
    # the terms that wider frames sum are columns of their own
    base = segmented.withColumns({
        "_range": (h - l) / c,
        "_true": F.greatest(h - l, F.abs(h - before), F.abs(l - before)),
        "_log": F.ln(c) - F.ln(before),
        "_step": c - before,
        "_dollars": c * v,
        "_before": before,
    })
    step = F.col("_step")
    out = {
        "intraday_return": safe(c, o) - 1,
        "gap_return": safe(o, F.col("_before")) - 1,
        "high_low_range_pct": F.col("_range"),
        "true_range_pct": safe(F.col("_true"), F.coalesce("_before", c)),
        "close_location": safe(c - l, h - l),
        "body_to_range": safe(c - o, h - l),
    }
    for k in RETURNS:
        out[f"return_{k}"] = safe(c, F.lag("close", k).over(w)) - 1
    for k in AVERAGES:
        out[f"sma_distance_{k}"] = since(k, safe(c, F.avg("close").over(trail(k))) - 1)
    for k in VOLATILITIES:
        out[f"realized_vol_{k}"] = since(k + 1, F.stddev_samp("_log").over(trail(k)))
    out["atr_14_pct"] = since(14, F.avg("_true").over(trail(14)) / c)
    out["volume_ratio_20_prior"] = since(21, safe(v, F.avg("volume").over(prior(20))))
    out["log_dollar_volume_20_prior"] = since(21, F.log1p(F.avg("_dollars").over(prior(20))))
    for k in EXTREMES:
        out[f"distance_to_prior_high_{k}"] = since(k + 1, safe(c, F.max("high").over(prior(k))) - 1)
        out[f"distance_to_prior_low_{k}"] = since(k + 1, safe(c, F.min("low").over(prior(k))) - 1)
    for k in PATHS:
        out[f"efficiency_ratio_{k}"] = since(k + 1, safe(F.abs(c - F.lag("close", k).over(w)), F.sum(F.abs(step)).over(trail(k))))
        out[f"up_fraction_{k}"] = since(k + 1, F.avg((step > 0).cast("double")).over(trail(k)))
    out["range_ratio_5_20"] = since(20, safe(F.avg("_range").over(trail(5)), F.avg("_range").over(trail(20))))
    base = base.withColumns(out)
    base = base.withColumn("realized_vol_ratio_10_60", safe(F.col("realized_vol_10"), F.col("realized_vol_60")))
    return base.select(*segmented.columns, *NAMES)


def feature_quality(featured: DataFrame) -> DataFrame:
    """``feature, valid, missing, valid_fraction``."""
    total = featured.agg(F.count("*").alias("n"), *(F.count(x).alias(x) for x in NAMES))
    long = total.select("n", F.explode(F.create_map(*(y for x in NAMES for y in (F.lit(x), F.col(x))))).alias("feature", "valid"))
    return long.select("feature", "valid", (F.col("n") - F.col("valid")).alias("missing"), F.round(F.col("valid") / F.col("n"), 6).alias("valid_fraction"))
