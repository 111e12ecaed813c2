"""The research table, purged walk-forward folds, rank metrics and the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .features import NAMES
from .signals import require

#: Results of the barrier that count, and the one that is the target.
COMPLETED = ("target", "stop", "timeout")
LABEL, RETURN = "barrier_2r_20_result", "h20_directional_close_return"

#: The test folds.
FOLDS = (("2013_2014", 20130101, 20141231), ("2015_2016", 20150101, 20161231), ("2017_2018", 20170101, 20181231), ("2019_2020", 20190101, 20201231), ("2021_2022", 20210101, 20221231), ("2023", 20230101, 20231231))
PROTECTED = ("pseudo_lockbox_2024_2026", "future_out_of_policy")


def folds(spark: SparkSession, rows=FOLDS) -> DataFrame:
    return spark.createDataFrame(list(rows), "fold string, test_start int, test_end int")


def research_table(signals: DataFrame, outcomes: DataFrame, features: DataFrame, splits: tuple[str, ...] = ("development",)) -> DataFrame:
    """Signals with labels and features; protected tickers and periods never reach it.

    Fatal are: a signal without outcome or with several, and a signal whose features are missing or in another segment.
    """
    labels = outcomes.select("candidate_id", "ticker_split", "temporal_partition", "termination", *(c for c in outcomes.columns if c.startswith(("h", "barrier")) and c not in signals.columns))
    rows = signals.join(labels, "candidate_id", "left")
    once = F.count("*").over(Window.partitionBy("candidate_id")) == 1
    rows = _must(rows.withColumn("_once", once), F.col("ticker_split").isNotNull() & F.col("_once"), "a signal has no outcome or several").drop("_once")
    rows = rows.filter(F.col("ticker_split").isin(*splits) & ~F.col("temporal_partition").isin(*PROTECTED))
    f = features.select("instrument_id", "signal_date", F.col("source_row_number").alias("signal_source_row_number"), F.col("segment_id").alias("_segment"), *NAMES)
    rows = rows.join(f, ["instrument_id", "signal_date", "signal_source_row_number"], "left")
    return _must(rows, F.col("_segment") == F.col("segment_id"), "a signal's features are missing or in another segment").drop("_segment")


def _must(rows: DataFrame, rule: Column, message: str) -> DataFrame:
    return rows.withColumn("_ok", F.assert_true(F.coalesce(rule, F.lit(False)), F.lit(message))).filter(F.col("_ok").isNull()).drop("_ok")


def selection_safe(rows: DataFrame, splits: tuple[str, ...] = ("development",)) -> DataFrame:
    """Rows of ``label`` that carry their features, without protected tickers and periods."""
    return rows.filter(F.col("ticker_split").isin(*splits) & ~F.col("temporal_partition").isin(*PROTECTED))


def family_counts(rows: DataFrame) -> DataFrame:
    """``instrument_id, rows, family_counts_json``: rows of each instrument, and of each of its families as canonical JSON."""
    each = rows.groupBy("instrument_id", "setup_family").agg(F.count("*").alias("n"))
    sums = each.groupBy("instrument_id").agg(F.sum("n").alias("rows"), F.array_sort(F.collect_list(F.struct("setup_family", "n"))).alias("c"))  # one entry a family
    return sums.select("instrument_id", "rows", F.to_json(F.map_from_entries("c")).alias("family_counts_json"))


def leakage(rows: DataFrame) -> DataFrame:
    """``check, violations``: what must not enter a baseline."""
    per_id = rows.groupBy("candidate_id").agg(F.count("*").alias("n"), F.count_if(F.col("ticker_split") != "development").alias("split"), F.count_if(F.col("temporal_partition").isin(*PROTECTED)).alias("period"))
    sums = per_id.agg(F.coalesce(F.sum("split"), F.lit(0)).alias("protected_ticker"), F.coalesce(F.sum("period"), F.lit(0)).alias("protected_period"), F.count_if(F.col("n") > 1).alias("duplicate_id"))
    return sums.select(F.explode(F.create_map(*(x for n in sums.columns for x in (F.lit(n), F.col(n))))).alias("check", "violations"))


def evaluable(rows: DataFrame) -> DataFrame:
    """Rows with a completed label, as ``y_return`` and ``y_target``."""
    done = rows.filter(F.col(RETURN).isNotNull() & F.col("h20_end_date").isNotNull() & F.col(LABEL).isin(*COMPLETED))
    return done.withColumns({"y_return": F.col(RETURN), "y_target": (F.col(LABEL) == "target").cast("int")})


def load_safe(rows: DataFrame) -> DataFrame:
    """``evaluable`` rows; raises if a protected row or a repeated id is among them."""
    require(leakage(rows), "protected or repeated rows in the baseline input")
    return evaluable(rows)


def fold_members(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``fold, part`` for each row and fold: training rows end before the test begins; test rows end inside it."""
    end = F.col("h20_end_date")
    train = (F.col("signal_date") < F.col("test_start")) & (end < F.col("test_start"))
    test = F.col("signal_date").between(F.col("test_start"), F.col("test_end")) & (end <= F.col("test_end"))
    both = rows.join(F.broadcast(table), train | test)  # six folds
    return both.withColumn("part", F.when(train, "train").otherwise("test"))


def fold_sets(rows: DataFrame, table=FOLDS) -> DataFrame:
    """The folds of ``fold_members`` on one row: ``train_folds``, and as ``fold`` the one it tests, or null; folds do not overlap."""
    day, end = F.col("signal_date"), F.col("h20_end_date")
    train = F.array_compact(F.array(*(F.when((day < start) & (end < start), F.lit(name)) for name, start, _ in table)))
    test = F.coalesce(*(F.when(day.between(start, stop) & (end <= stop), F.lit(name)) for name, start, stop in table))
    return rows.withColumns({"train_folds": train, "fold": test})


def fold_status(members: DataFrame, min_train: int, min_test: int, target: str = "y_target", by: tuple[str, ...] = ("setup_family",)) -> DataFrame:
    """For each family and fold its rows, label dates, target rate of the test and status."""
    train, test = F.col("part") == "train", F.col("part") == "test"
    sums = members.groupBy(*by, "fold").agg(
        F.count_if(train).alias("train_rows"), F.count_if(test).alias("test_rows"), F.countDistinct(F.when(train, F.col(target))).alias("classes"),
        F.min(F.when(train, F.col("signal_date"))).alias("train_start"), F.max(F.when(train, F.col("h20_end_date"))).alias("train_last_label_date"),
        F.min(F.when(test, F.col("signal_date"))).alias("test_start"), F.max(F.when(test, F.col("h20_end_date"))).alias("test_last_label_date"),
        F.avg(F.when(test, F.col(target).cast("double"))).alias("test_target_rate"),
    )
    status = F.when((F.col("train_rows") < min_train) | (F.col("test_rows") < min_test), "insufficient_rows").when(F.col("classes") < 2, "single_class_train").otherwise("valid")
    return sums.withColumn("status", status).drop("classes")


#: Ranges of a score that are ranked apart.
RANGES = 64


def _ranked(rows: DataFrame, by: list[str], score: str, key: str, name: str, source: DataFrame) -> DataFrame:
    """Adds the average rank ``name``, the position ``name_i`` (ties follow the key) and the group's size ``name_n``.

    Each group's scores are cut into ranges, which are ranked apart and moved by the rows of the ranges below: a group is
    no single task. Equal scores share a range. Bounds and sizes are RANGES rows a group; they are taken from ``source``,
    which has the same rows and need not be ranked for it.
    """
    bounds = source.groupBy(*by).agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_bounds"))
    ranges = lambda df: df.join(F.broadcast(bounds), by).withColumn("_range", F.size(F.filter("_bounds", lambda x: x < F.col(score)))).drop("_bounds")
    cut = ranges(rows)
    sizes = ranges(source.select(*by, score)).groupBy(*by, "_range").agg(F.count("*").alias("_size"))
    below = F.sum("_size").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_size")
    sizes = sizes.select(*by, "_range", below.alias("_below"), F.sum("_size").over(Window.partitionBy(*by)).alias(f"{name}_n"))
    own = Window.partitionBy(*by, "_range")
    ties = F.count("*").over(own.orderBy(score).rangeBetween(Window.currentRow, Window.currentRow))
    out = cut.join(F.broadcast(sizes), [*by, "_range"])
    return out.withColumns({name: F.col("_below") + F.rank().over(own.orderBy(score)) + (ties - 1) / 2.0, f"{name}_i": F.col("_below") + F.row_number().over(own.orderBy(score, key))}).drop("_range", "_below")


def rank_metrics(rows: DataFrame, score: str, by: list[str], fraction: float = 0.1, key: str = "candidate_id") -> DataFrame:
    """Per group: Spearman, returns and target rates of the top and bottom share, AUC.

    Rows with null score or return are left out; ties of the score follow the key. ``rows`` is read several times, so give a
    staged table. ``top_target_rate_lift`` is a ratio, null where the base rate is 0.
    """
    rows = rows.select(*by, key, "y_return", "y_target", F.col(score).alias("_score")).filter(F.col("_score").isNotNull() & F.col("y_return").isNotNull())
    ranked = _ranked(_ranked(rows, by, "y_return", key, "_rr", rows), by, "_score", key, "_rs", rows)
    return ranked.groupBy(*by).agg(_measures("_rs", fraction).alias("_m")).select(*by, "_m.*")


def _measures(rank: str, fraction: float) -> Column:
    """The metrics of a group as a struct; ``rank`` is the score's, ``_rr`` that of the return."""
    k = F.greatest(F.lit(1), F.ceil(F.col(f"{rank}_n") * fraction))
    top, bottom = F.col(f"{rank}_i") > F.col(f"{rank}_n") - k, F.col(f"{rank}_i") <= k
    pos, target, spearman = F.sum("y_target"), F.col("y_target").cast("double"), F.corr(rank, "_rr")
    mean, top_return, bottom_return = F.avg("y_return"), F.avg(F.when(top, F.col("y_return"))), F.avg(F.when(bottom, F.col("y_return")))
    base, top_rate = F.avg(target), F.avg(F.when(top, target))
    return F.struct(
        F.count("*").alias("n"), F.when(~F.isnan(spearman), spearman).alias("spearman"), mean.alias("mean_return"), top_return.alias("top_return"), bottom_return.alias("bottom_return"),
        base.alias("base_target_rate"), top_rate.alias("top_target_rate"), F.try_divide(F.sum(F.col(rank) * F.col("y_target")) - pos * (pos + 1) / 2.0, pos * (F.count("*") - pos)).alias("auc"),
        (top_return - mean).alias("top_minus_mean"), (top_return - bottom_return).alias("top_minus_bottom"), F.when(base > 0, top_rate / base).alias("top_target_rate_lift"),
    )


def all_rank_metrics(rows: DataFrame, scores: list[str], by: list[str], fraction: float = 0.1, key: str = "candidate_id") -> DataFrame:
    """``rank_metrics`` of several scores that no row lacks, a row for each in the column ``score``: returns are ranked once for all."""
    rows = rows.select(*by, key, "y_return", "y_target", *scores).filter(F.col("y_return").isNotNull())
    ranked = _ranked(rows, by, "y_return", key, "_rr", rows)
    for i, name in enumerate(scores):
        ranked = _ranked(ranked, by, name, key, f"_r{i}", rows)
    sums = ranked.groupBy(*by).agg(*(_measures(f"_r{i}", fraction).alias(f"_m{i}") for i in range(len(scores))))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("score"), f"_m{i}.*") for i, name in enumerate(scores))))
    return sums.select(*by, each.alias("_m")).select(*by, "_m.*")


def brier(rows: DataFrame, probability: str, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(F.pow(F.col(probability) - F.col("y_target"), 2)).alias("brier"))


#: Thresholds of the gate; callers may pass their own.
GATE = {
    "regression": {"min_spearman": 0.015, "min_top_minus_mean": 0.005, "min_positive_top_lift_folds": 4, "min_nonnegative_spearman_folds": 3},
    "classification": {"min_auc": 0.515, "min_top_rate_lift": 1.08, "min_top_above_base_folds": 4, "min_auc_ge_half_folds": 3},
}


def gate(aggregate: DataFrame, by_fold: DataFrame, rules: dict = GATE, by: tuple[str, ...] = ("setup_family",)) -> DataFrame:
    """One row a family: whether the score passes as a regression or a classification.

    ``aggregate`` has the metrics of all out-of-fold rows, ``by_fold`` those of each valid fold.
    """
    r, c = rules["regression"], rules["classification"]
    counts = by_fold.groupBy(*by).agg(
        F.count_if(F.col("spearman") >= 0).alias("nonnegative_spearman_folds"), F.count_if(F.col("top_minus_mean") > 0).alias("positive_top_lift_folds"),
        F.count_if(F.col("auc") >= 0.5).alias("auc_ge_half_folds"), F.count_if(F.col("top_target_rate") >= F.col("base_target_rate")).alias("top_above_base_folds"),
    )
    both = aggregate.join(counts, list(by))
    regression = (F.col("spearman") >= r["min_spearman"]) & (F.col("top_return") > 0) & (F.col("top_minus_mean") >= r["min_top_minus_mean"]) & (F.col("positive_top_lift_folds") >= r["min_positive_top_lift_folds"]) & (F.col("nonnegative_spearman_folds") >= r["min_nonnegative_spearman_folds"])
    classification = (F.col("auc") >= c["min_auc"]) & (F.col("top_target_rate_lift") >= c["min_top_rate_lift"]) & (F.col("top_above_base_folds") >= c["min_top_above_base_folds"]) & (F.col("auc_ge_half_folds") >= c["min_auc_ge_half_folds"])
    return both.select(
        *by, F.coalesce(regression, F.lit(False)).alias("regression_pass"), F.coalesce(classification, F.lit(False)).alias("classification_pass"), "nonnegative_spearman_folds", "positive_top_lift_folds", "auc_ge_half_folds", "top_above_base_folds", "n"
    )


def score_gates(oof: DataFrame, scores: tuple[str, ...], rules: dict = GATE, fraction: float = 0.1) -> DataFrame:
    """``gate`` for each score of out-of-fold rows that carry ``setup_family, fold``; a column ``score`` names it.

    Scores that no row lacks are ranked in one job for each grouping, the others each by itself.
    """
    lacks = oof.agg(*(F.count_if(F.col(n).isNull()).alias(n) for n in scores)).first() if len(scores) > 1 else dict.fromkeys(scores, 1)
    whole, out = [n for n in scores if not lacks[n]], []
    if len(whole) > 1:
        made = gate(*(all_rank_metrics(oof, whole, by, fraction) for by in (["setup_family"], ["setup_family", "fold"])), rules, ("setup_family", "score"))
        out.append(made.select(*(c for c in made.columns if c != "score"), "score"))
    for name in (n for n in scores if lacks[n] or len(whole) == 1):
        out.append(gate(rank_metrics(oof, name, ["setup_family"], fraction), rank_metrics(oof, name, ["setup_family", "fold"], fraction), rules).withColumn("score", F.lit(name)))
    return reduce(DataFrame.unionByName, out)


def decide(gates: DataFrame, status: DataFrame, min_rows: int, min_folds: int) -> DataFrame:
    """One row a family: its valid folds, out-of-fold rows and decision; one passing score is evidence enough."""
    folds = status.groupBy("setup_family").agg(F.count_if(F.col("status") == "valid").alias("valid_folds"))
    each = gates.groupBy("setup_family").agg(F.bool_or(F.col("regression_pass") | F.col("classification_pass")).alias("evidence_pass"), F.max("n").alias("oof_rows"))
    both = folds.join(each, "setup_family", "left").withColumns({"evidence_pass": F.coalesce("evidence_pass", F.lit(False)), "oof_rows": F.coalesce("oof_rows", F.lit(0).cast("long"))})
    enough = (F.col("oof_rows") >= min_rows) & (F.col("valid_folds") >= min_folds)
    return both.withColumn("sufficient_sample", enough).withColumn("decision", F.when(enough & F.col("evidence_pass"), "PROCEED_TO_SPECIALIST_RESEARCH").otherwise("BASELINE_INCONCLUSIVE"))
