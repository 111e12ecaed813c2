"""Signals: generators give Columns over the featured bars, and signals become rows with an entry on the next bar."""

from __future__ import annotations

import hashlib
import importlib
import json
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Part of every id, the moment of a decision and the rule of its entry, feature schema, statuses, stored columns.
SCHEMA_VERSION = "candidate_schema_v1.0.0"
DECISION_TIME, ENTRY_RULE = "signal_close", "next_valid_session_open"
FEATURE_SCHEMA_VERSION = "feature_schema_v1.0.0"
STATUSES = ("available", "no_later_bar", "next_bar_new_segment")
OVERLAP_POLICIES = ("allow", "suppress_consecutive", "cooldown")
CANDIDATE_COLUMNS = (
    "candidate_id", "candidate_schema_version", "instrument_id", "ticker", "exchange", "instrument_class", "signal_date", "signal_source_row_number", "signal_segment_id", "setup_family", "setup_version",
    "direction", "decision_time", "earliest_entry_rule", "earliest_entry_date", "historical_entry_status", "raw_setup_strength", "generator_payload_json", "generator_config_sha256",
    "feature_schema_version", "feature_dataset_sha256",
)


def canonical_json(value) -> str:
    """JSON with sorted keys and no spaces; NaN and infinities are refused."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


@dataclass(frozen=True)
class Generator:
    """``mask``, ``strength`` and ``payload`` are Columns over features; subclasses define them."""

    setup_family: str
    setup_version: str = "v1.0.0"
    direction: str = "LONG"
    config: dict = field(default_factory=dict)
    required_features: tuple[str, ...] = ()
    description: str = "a signal generator"
    overlap_policy: str = "allow"
    decision_time: str = DECISION_TIME
    earliest_entry_rule: str = ENTRY_RULE

    def __post_init__(self):
        if not self.description.strip():
            raise ValueError("description must not be empty")
        if self.overlap_policy not in OVERLAP_POLICIES:
            raise ValueError(f"overlap_policy is one of {', '.join(OVERLAP_POLICIES)}")
        if self.decision_time != DECISION_TIME or self.earliest_entry_rule != ENTRY_RULE:
            raise ValueError(f"decisions are made at {DECISION_TIME}, entries at {ENTRY_RULE}")
        if len(set(self.required_features)) != len(self.required_features):
            raise ValueError("a required feature stands twice")
        if not re.fullmatch(r"[a-z][a-z0-9_]{1,63}", self.setup_family):
            raise ValueError("setup_family is snake case of 2 to 64 characters")
        if not re.fullmatch(r"v\d+\.\d+\.\d+([-+][A-Za-z0-9_.-]+)?", self.setup_version):
            raise ValueError("setup_version has three numbers")
        if self.direction not in ("LONG", "SHORT"):
            raise ValueError("direction is LONG or SHORT")

    @property
    def key(self) -> str:
        return f"{self.setup_family}|{self.setup_version}|{self.direction}"

    @property
    def config_hash(self) -> str:
        """SHA-256 of the canonical JSON of the config: sorted keys, no spaces, no NaN."""
        return hashlib.sha256(canonical_json(dict(self.config)).encode()).hexdigest()

    def prepare(self, bars: DataFrame) -> DataFrame:
        return bars

    def mask(self) -> Column:
        raise NotImplementedError

    def strength(self) -> Column:
        return F.lit(None).cast("double")

    def payload(self) -> Column:
        return F.lit("{}")


class Registry:
    """Generators by key, in order of their keys; a key stands once."""

    def __init__(self, generators: Iterable[Generator] = ()):
        self._held: dict[str, Generator] = {}
        for g in generators:
            self.add(g)

    def add(self, g: Generator) -> None:
        if g.key in self._held:
            raise ValueError(f"{g.key} is registered already")
        self._held[g.key] = g

    def __iter__(self):
        return iter(self._held[k] for k in sorted(self._held))

    def __len__(self) -> int:
        return len(self._held)


def load_generator(spec: dict) -> Generator:
    """The generator that a config names: ``class`` as module:Class, the other keys are its fields."""
    module, _, name = str(spec["class"]).partition(":")
    if not name:
        raise ValueError("class has the form module:Class")
    kind = getattr(importlib.import_module(module), name)
    if not (isinstance(kind, type) and issubclass(kind, Generator)):
        raise TypeError(f"{spec['class']} is not a generator")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in spec.items() if k != "class"})


def load_registry(config: dict) -> Registry:
    found = Registry(load_generator(x) for x in config.get("generators", []))
    if not len(found):
        raise ValueError("a config needs at least one generator")
    return found


def work_list(spark, registry: Registry, universe: DataFrame) -> DataFrame:
    """``generator_key, instrument_id``: what a build has to do; subtract what a manifest has with a left anti join."""
    keys = F.explode(F.array(*(F.lit(g.key) for g in registry))).alias("generator_key")
    return universe.select(keys, "instrument_id")


def select_universe(catalog: DataFrame, exchange: str | None = None, instrument_class: str | None = None, require_rows: bool = True, explicit: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Instruments by exchange and class (any case) and rows; explicit ids keep their order, others go by id; the limit comes last."""
    if exchange is not None:
        catalog = catalog.filter(F.upper("exchange") == exchange.upper())
    if instrument_class is not None:
        catalog = catalog.filter(F.lower("instrument_class") == instrument_class.lower())
    if require_rows:
        catalog = catalog.filter("valid_row_count > 0")
    if explicit:
        catalog = catalog.filter(F.col("instrument_id").isin(*explicit))
        catalog = catalog.orderBy(F.array_position(F.lit(list(explicit)), F.col("instrument_id")))
    else:
        catalog = catalog.orderBy("instrument_id")
    return catalog if limit is None else catalog.limit(int(limit))


class TrendPullback(Generator):
    """A pullback in a trend of liquid stocks: six thresholds, compared as 32-bit features are."""

    #: The thresholds.
    DEFAULTS = {"minimum_history_bars": 120, "minimum_return_20": 0.02, "pullback_from_high_min": -0.12, "pullback_from_high_max": -0.02, "maximum_atr_14_pct": 0.08, "minimum_log_dollar_volume": 12.0}

    def _p(self, name: str) -> float:
        return {**self.DEFAULTS, **self.config}[name]

    @staticmethod
    def _f(name: str) -> Column:
        return F.col(name).cast("float").cast("double")

    def mask(self) -> Column:
        away = self._f("distance_to_prior_high_60")
        rule = (
            (F.lower("instrument_class") == "stocks")
            & (F.col("history_bars") >= self._p("minimum_history_bars"))
            & (self._f("return_20") >= self._p("minimum_return_20"))
            & (away >= self._p("pullback_from_high_min"))
            & (away <= self._p("pullback_from_high_max"))
            & (self._f("atr_14_pct") <= self._p("maximum_atr_14_pct"))
            & (self._f("log_dollar_volume_20_prior") >= self._p("minimum_log_dollar_volume"))
        )
        return F.coalesce(rule, F.lit(False))

    def strength(self) -> Column:
        lo, hi = self._p("pullback_from_high_min"), self._p("pullback_from_high_max")
        clip = lambda e: F.greatest(F.lit(0.0), F.least(F.lit(1.0), e))
        near = 1 - F.abs(self._f("distance_to_prior_high_60") - (lo + hi) / 2) / max(1e-9, (hi - lo) / 2)
        return 0.6 * clip(self._f("return_20") / 0.2) + 0.4 * clip(near)

    def payload(self) -> Column:
        return F.to_json(F.struct(F.lit(True).alias("public_demo")))


class EveryNth(Generator):
    """A causal probe: every n-th bar of the history."""

    def mask(self) -> Column:
        return F.col("history_bars") % self.config.get("modulus", 50) == 0

    def strength(self) -> Column:
        return F.coalesce("return_1", F.lit(0.0))


class Peek(Generator):
    """A probe that looks one bar ahead; the causality audit must reject it."""

    def prepare(self, bars: DataFrame) -> DataFrame:
        w = Window.partitionBy("instrument_id").orderBy("date")
        return bars.withColumn("_next", F.lead("return_1").over(w))

    def mask(self) -> Column:
        return F.coalesce(F.col("_next") > 0, F.lit(False))


def candidate_id(family: Column, version: Column, instrument: Column, date: Column, direction: Column) -> Column:
    return F.concat(F.lit("cand_"), F.sha2(F.concat_ws("|", F.lit(SCHEMA_VERSION), family, version, instrument, date.cast("string"), direction), 256))


def with_entry(bars: DataFrame) -> DataFrame:
    """Adds the next bar's date and row, if it is in the same segment, and the entry status."""
    w = Window.partitionBy("instrument_id").orderBy("date")
    nxt = F.lead("segment_id").over(w)
    status = F.when(nxt.isNull(), "no_later_bar").when(nxt != F.col("segment_id"), "next_bar_new_segment").otherwise("available")
    out = bars.withColumns({"historical_entry_status": status, "_d": F.lead("signal_date").over(w), "_r": F.lead("source_row_number").over(w)})
    ok = F.col("historical_entry_status") == "available"
    return out.withColumns({"entry_date": F.when(ok, F.col("_d")), "entry_source_row_number": F.when(ok, F.col("_r"))}).drop("_d", "_r")


def materialize(generator: Generator, bars: DataFrame) -> DataFrame:
    """One row for each signal of the generator."""
    return signal_rows([generator], with_entry(bars))


def signal_rows(generators: list[Generator], bars: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Signals of several generators from one pass over bars that have their entries; ``carry`` names columns to keep."""
    for g in generators:
        bars = g.prepare(bars)
    if len(generators) == 1:
        rows, pick = bars.filter(generators[0].mask()), lambda get: get(generators[0])
    else:
        fires = F.array_compact(F.array(*(F.when(g.mask(), F.lit(i)) for i, g in enumerate(generators))))
        rows = bars.withColumn("_fires", F.explode(fires))
        pick = lambda get: F.coalesce(*(F.when(F.col("_fires") == i, get(g)) for i, g in enumerate(generators)))
    f, v, d = (pick(lambda g, n=n: F.lit(getattr(g, n))) for n in ("setup_family", "setup_version", "direction"))
    return rows.select(
        candidate_id(f, v, F.col("instrument_id"), F.col("signal_date"), d).alias("candidate_id"),
        F.lit(SCHEMA_VERSION).alias("candidate_schema_version"), "instrument_id", "ticker", "exchange", "instrument_class",
        f.alias("setup_family"), v.alias("setup_version"), d.alias("direction"), pick(lambda g: F.lit(g.config_hash)).alias("generator_config_sha256"),
        "signal_date", F.col("source_row_number").alias("signal_source_row_number"), F.lit(DECISION_TIME).alias("decision_time"), F.lit(ENTRY_RULE).alias("earliest_entry_rule"),
        "segment_id", "history_bars", "entry_date", "entry_source_row_number", "historical_entry_status",
        pick(lambda g: g.strength()).alias("raw_setup_strength"), pick(lambda g: g.payload()).alias("generator_payload_json"), *carry,
    )


def canonical(signals: DataFrame, feature_dataset_sha256: str) -> DataFrame:
    """The stored columns in their order."""
    named = signals.withColumnsRenamed({"segment_id": "signal_segment_id", "entry_date": "earliest_entry_date"})
    named = named.withColumns({"feature_schema_version": F.lit(FEATURE_SCHEMA_VERSION), "feature_dataset_sha256": F.lit(feature_dataset_sha256)})
    return named.select(*CANDIDATE_COLUMNS)


def sorted_signals(signals: DataFrame) -> DataFrame:
    """In the stored order; the id makes it total."""
    return signals.orderBy("signal_date", "instrument_id", "setup_family", "setup_version", "direction", "candidate_id")


#: Checks of a canonical row: name and what must hold. A null result counts as a violation.
ROW_CHECKS = {
    "schema_version": f"candidate_schema_version = '{SCHEMA_VERSION}'",
    "direction": "direction in ('LONG', 'SHORT')",
    "decision_time": f"decision_time = '{DECISION_TIME}'",
    "entry_rule": f"earliest_entry_rule = '{ENTRY_RULE}'",
    "entry_status": f"historical_entry_status in {STATUSES}",
    "entry_date": "(historical_entry_status = 'available') = (earliest_entry_date is not null)",
    "entry_after_signal": "earliest_entry_date is null or earliest_entry_date > signal_date",
    "strength": "raw_setup_strength is null or (not isnan(raw_setup_strength) and abs(raw_setup_strength) < double('inf'))",
    "payload": "generator_payload_json is not null and coalesce(to_json(try_parse_json(generator_payload_json)) = generator_payload_json, false)",
    "candidate_id": f"candidate_id = concat('cand_', sha2(concat_ws('|', '{SCHEMA_VERSION}', setup_family, setup_version, instrument_id, cast(signal_date as string), direction), 256))",
}


def count_checks(rows: DataFrame, checks: dict[str, str]) -> DataFrame:
    sums = rows.agg(*(F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(n) for n, e in checks.items()))
    return sums.select(F.explode(F.create_map(*(x for n in checks for x in (F.lit(n), F.col(n))))).alias("check", "violations"))


def row_violations(rows: DataFrame) -> DataFrame:
    """``check, violations`` of canonical rows."""
    return count_checks(rows, ROW_CHECKS)


def require(violations: DataFrame, what: str) -> None:
    """Raises if a report of ``check, violations`` has any; the report has one row for each check."""
    if bad := {r["check"]: r["violations"] for r in violations.filter("violations > 0").collect()}:
        raise ValueError(f"{what}: {bad}")


def signal_violations(generator: Generator, bars: DataFrame) -> DataFrame:
    """``check, violations``: a mask is never null, a signal's strength is finite, and its payload is JSON."""
    rows = generator.prepare(bars).select(generator.mask().alias("m"), generator.strength().alias("s"), generator.payload().alias("p"))
    return count_checks(rows, {
        "mask": "m is not null",
        "finite_strength": "not coalesce(m, false) or s is null or (not isnan(s) and abs(s) < double('inf'))",
        "payload": "not coalesce(m, false) or try_parse_json(p) is not null",
    })


def context_violations(bars: DataFrame, features: DataFrame) -> DataFrame:
    """``check, violations``: bars and features have the same rows, and dates rise with the row numbers.

    A row that only one side has, or that differs in its row number, is a violation; so is a date that does not rise.
    """
    b = bars.select("instrument_id", "date", F.col("source_row_number").alias("b_row"), F.lit(1).alias("in_bars"))
    f = features.select("instrument_id", "date", F.col("source_row_number").alias("f_row"), F.lit(1).alias("in_features"))
    both = b.join(f, ["instrument_id", "date"], "full")
    w = Window.partitionBy("instrument_id").orderBy("source_row_number")
    dates = bars.select("instrument_id", "date", "source_row_number", F.lag("date").over(w).alias("before"))
    one = both.agg(F.count_if(F.col("in_features").isNull()).alias("only_bars"), F.count_if(F.col("in_bars").isNull()).alias("only_features"), F.count_if(F.col("b_row") != F.col("f_row")).alias("row_lineage"))
    two = dates.agg(F.count_if(F.col("date") <= F.col("before")).alias("increasing_dates"))
    names = ("only_bars", "only_features", "row_lineage", "increasing_dates")
    sums = one.join(F.broadcast(two))  # one row each
    return sums.select(F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n))))).alias("check", "violations"))


def combine(frames: list[DataFrame]) -> DataFrame:
    """The union of signals; fails where an id stands twice."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    n = F.count("*").over(Window.partitionBy("candidate_id"))
    checked = out.withColumn("_n", n).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("an id stands twice")))
    return checked.filter(F.col("_ok").isNull()).drop("_n", "_ok")


def diagnostics(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """One row of counts; all zero without signals."""
    per_day = signals.groupBy("signal_date").agg(F.count("*").alias("n"))
    days = per_day.agg(F.count("*").alias("dates_with_candidates"), F.coalesce(F.max("n"), F.lit(0)).alias("max_on_one_date"), F.coalesce(F.median("n"), F.lit(0.0)).alias("median_on_active_date"))
    own = signals.agg(F.count("*").alias("candidate_count"), F.countDistinct("instrument_id").alias("instruments_with_candidates"))
    every = bars.agg(F.count("*").alias("eligible_bar_count"), F.countDistinct("instrument_id").alias("instrument_count"))
    out = own.join(F.broadcast(days)).join(F.broadcast(every))  # one row each
    return out.withColumn("per_1000_bars", F.coalesce(F.round(F.try_divide(F.col("candidate_count") * 1000.0, F.col("eligible_bar_count")), 6), F.lit(0.0)))


def diagnostic_counts(signals: DataFrame) -> DataFrame:
    """``kind, value, n``: signals by entry status, year, exchange and class."""
    kinds = {"entry_status": F.col("historical_entry_status"), "year": F.floor(F.col("signal_date") / 10000).cast("string"), "exchange": F.col("exchange"), "instrument_class": F.col("instrument_class")}
    long = signals.select(F.explode(F.create_map(*(x for k, c in kinds.items() for x in (F.lit(k), c)))).alias("kind", "value"))
    return long.groupBy("kind", "value").agg(F.count("*").alias("n"))


def causality(generator: Generator, bars: DataFrame, checkpoints: tuple[int, ...], featured) -> DataFrame:
    """``checkpoint, compared, violations``: the first n bars alone against the first n of all bars.

    ``featured`` turns bars into featured bars, so the prefix is featured anew. A bar violates if its mask differs, or if it
    is a signal and the strength (by more than 1e-12) or the payload differs. A bar that one side lacks is a violation.
    """
    w = Window.partitionBy("instrument_id").orderBy("date")
    numbered = bars.withColumn("_rn", F.row_number().over(w))

    def flags(df: DataFrame) -> DataFrame:
        return generator.prepare(featured(df)).select("instrument_id", "date", generator.mask().alias("m"), generator.strength().alias("s"), generator.payload().alias("p"))

    full = flags(bars).join(numbered.select("instrument_id", "date", "_rn"), ["instrument_id", "date"])
    out = None
    for n in sorted({n for n in checkpoints if n > 0}):
        part = flags(numbered.filter(F.col("_rn") <= n).drop("_rn")).withColumnsRenamed({"m": "pm", "s": "ps", "p": "pp"})
        both = full.filter(F.col("_rn") <= n).join(part, ["instrument_id", "date"], "full")
        same = (~F.col("m") & ~F.col("pm")) | (F.col("m") & F.col("pm") & (F.coalesce(F.abs(F.col("s") - F.col("ps")) <= 1e-12, F.col("s").isNull() & F.col("ps").isNull())) & F.col("p").eqNullSafe(F.col("pp")))
        row = both.agg(F.lit(n).alias("checkpoint"), F.count("*").alias("compared"), F.count_if(~F.coalesce(same, F.lit(False))).alias("violations"))
        out = row if out is None else out.unionByName(row)
    return out
