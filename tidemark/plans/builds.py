"""Builds: each module reads what the module before it published, writes a run folder, and can be verified and published.

A run holds a store (Parquet and manifest), a summary and a fingerprint. Errors of single members are counted, not fatal, in
the audit; in the other modules they are fatal. A dry run takes the first instruments only and is never published.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as ft
from ..operators import models, outcomes, research, signals, validation
from ..operators.bars import int_date
from ..sources import archive, stores
from ..sources.catalog import Catalog
from ..sources.files import Folder, publish
from ..sources.staging import stage, unstage
from .runs import Run

KEYS = {"features": ["instrument_id", "signal_date"], "candidates": ["candidate_id"], "outcomes": ["candidate_id"], "research": ["candidate_id"]}
SCHEMAS = {"features": signals.FEATURE_SCHEMA_VERSION, "candidates": signals.SCHEMA_VERSION, "outcomes": "outcome_schema_v1.0.0", "research": "research_schema_v1.0.0"}
#: Protected rows of each store that may not be published.
PROTECTED = {"research": "ticker_split <> 'development' or temporal_partition in ('pseudo_lockbox_2024_2026', 'future_out_of_policy')"}


def file_sha256(spark: SparkSession, path: str) -> str:
    digest, where = hashlib.sha256(), archive._open(path)
    with where as f:
        while piece := f.read(8 << 20):
            digest.update(piece)
    return digest.hexdigest()


# ------------------------------------------------------------------ audit


def member_table(spark: SparkSession, inventory: DataFrame, lines: DataFrame, validated: DataFrame) -> DataFrame:
    """The symbol manifest: one row for each classified member that could be read, empty ones included."""
    summary = validation.member_summary(validated).join(validation.extreme_moves(validated), "member", "left")
    own = inventory.filter("classified and is_txt").join(archive.states(lines), "member", "left").filter("not coalesce(broken, false)").join(summary, "member", "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    iso = lambda c: F.date_format(F.expr(f"try_to_date(cast({c} as string), 'yyyyMMdd')"), "yyyy-MM-dd")
    return own.select(
        F.col("member").alias("source_member"), "instrument_id", "ticker", "exchange", "instrument_class", "compressed_size", F.col("size").alias("uncompressed_size"), "crc32", F.coalesce("header_valid", F.lit(False)).alias("header_valid"),
        (n("row_count") == 0).alias("empty_file"), n("row_count").alias("row_count"), n("valid_rows").alias("valid_row_count"), n("invalid_rows").alias("invalid_row_count"), iso("first_date").alias("first_date"), iso("last_date").alias("last_date"),
        n("zero_volume").alias("zero_volume_count"), n("over_50").alias("extreme_return_50_count"), n("over_100").alias("extreme_return_100_count"), F.col("largest").alias("max_abs_return"), "min_close", "max_close",
    )


def dataset_fingerprint(manifest: DataFrame) -> str:
    """SHA-256 of the members' lines in order of their names, joined by line feeds; rows pass through the driver one by one."""
    text = F.concat_ws("|", "source_member", "crc32", F.col("valid_row_count").cast("string"), F.coalesce("first_date", F.lit("None")), F.coalesce("last_date", F.lit("None")))
    digest = hashlib.sha256()
    for i, row in enumerate(manifest.select("source_member", text.alias("line")).orderBy("source_member").toLocalIterator()):
        digest.update((b"\n" if i else b"") + row["line"].encode())
    return digest.hexdigest()


def _counts(df: DataFrame, c: str) -> dict:
    return {str(r[c]): r["count"] for r in df.groupBy(c).count().orderBy(c).collect()}


def audit_summary(spark: SparkSession, inventory: DataFrame, manifest: DataFrame, histogram: DataFrame, errors: DataFrame, survivor_days: int) -> dict:
    """Sums, dates, counts by class, exchange, reason and last date, repeated ids and tickers, survivors."""
    sums = manifest.agg(
        F.count("*").alias("audited_member_count"), F.count_if("empty_file").alias("empty_file_count"), F.count_if(~F.col("header_valid") & ~F.col("empty_file")).alias("invalid_header_file_count"),
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("row_count", "valid_row_count", "invalid_row_count", "extreme_return_50_count", "extreme_return_100_count")), F.coalesce(F.sum("zero_volume_count"), F.lit(0)).alias("zero_volume_row_count"),
        F.min("first_date").alias("global_first_date"), F.max("last_date").alias("global_last_date"),
    ).first().asDict()
    dated = manifest.filter("last_date is not null").select(F.to_date("last_date").alias("last"))
    alive = validation.survivors(dated, survivor_days).first()
    members = inventory.agg(F.count("*").alias("n"), F.count_if("classified").alias("c")).first()
    ids = manifest.groupBy("instrument_id").count().filter("count > 1")
    tickers = manifest.groupBy("ticker").agg(F.countDistinct("instrument_id").alias("n")).filter("n > 1")
    top = dated.groupBy("last").count().orderBy(F.desc("count"), "last").limit(20).collect()
    return sums | {
        "archive_member_count": members["n"], "classified_member_count_in_inventory": members["c"], "unclassified_member_count_in_inventory": members["n"] - members["c"], "file_error_count": errors.count(),
        "invalid_reason_counts": {r["reason"]: r["rows"] for r in histogram.orderBy("reason").collect()}, "instrument_class_counts": _counts(manifest, "instrument_class"), "exchange_counts": _counts(manifest, "exchange"),
        "top_last_dates": [[str(r["last"]), r["count"]] for r in top], "survivor_window_days": survivor_days, "dated_instrument_count": alive["instruments"], "survivor_like_instrument_count": alive["survivors"],
        "survivor_like_fraction": alive["survivors"] / alive["instruments"] if alive["instruments"] else None, "duplicate_instrument_id_count": ids.count(), "duplicate_ticker_count": tickers.count(),
    }


def audit(spark: SparkSession, config: dict, resume: str | None = None, dry_run: bool = False) -> str:
    """Audits an archive and publishes what it found; a dry run stays in its own folder."""
    data, execution = config["data"], config.get("execution") or {}
    run = Run(spark, execution.get("runs_root", "runs"), config.get("module", {}).get("name", "data"), config, resume)
    with run:
        path = data["archive_path"]
        inventory = archive.inventory(spark, path)
        only = None
        if dry_run:
            only = [r[0] for r in inventory.filter("classified and is_txt").orderBy("member").limit(int(execution.get("dry_run_max_files", 25))).select("member").collect()]
        if dry_run and not only:
            raise ValueError("the archive has no classified members")
        lines = archive.read_zip(spark, path, only=only)
        known = validation.classify_paths(archive.data_lines(lines)).filter("instrument_id is not null")
        validated = stage(validation.validate(known, "header_valid"), "validated")
        heads = stage(archive.headers(lines).join(inventory.filter("classified").select("member"), "member", "left_semi"), "headers")
        errors = stage(archive.member_errors(lines), "errors")
        picked = inventory.filter(F.col("member").isin(only)) if only else inventory
        manifest = stage(member_table(spark, picked, lines, validated), "manifest")
        stores.write_csv(inventory.select(F.col("member").alias("source_member"), "compressed_size", F.col("size").alias("uncompressed_size"), "crc32", "is_txt", F.col("classified").alias("path_classified"), "instrument_id", "ticker", "exchange", "instrument_class"), f"{run.path}/archive_inventory.csv", ["source_member"])
        stores.write_csv(manifest, f"{run.path}/symbol_manifest.csv", ["source_member"])
        stores.write_csv(validation.quarantine(validated), f"{run.path}/invalid_rows.csv", ["member", "row_number"])
        stores.write_csv(errors, f"{run.path}/file_errors.csv", ["member"])
        summary = audit_summary(spark, inventory, manifest, validation.reason_histogram(validated, heads), errors, int(data.get("survivor_window_days", 10)))
        summary |= {"module_version": config.get("module", {}).get("version", "v1"), "dry_run": dry_run, "archive_path": path, "archive_sha256": file_sha256(spark, path) if data.get("compute_archive_sha256", True) else None, "dataset_fingerprint_sha256": dataset_fingerprint(manifest)}
        run.folder.write_json("summary.json", summary)
        run.folder.write_json("dataset_fingerprint.json", {k: summary[k] for k in ("archive_sha256", "dataset_fingerprint_sha256", "module_version")} | {"config_sha256": run.manifest["config_sha256"]})
        unstage(validated, heads, errors, manifest)
        run.complete(audited_member_count=summary["audited_member_count"], publication_mode="dry_run" if dry_run else "full_run")
        target = (config.get("publication") or {}).get("artifact_root")
        if target and not dry_run:
            publish(spark, run.path, target, replace=True)
        return run.path


# ------------------------------------------------------------------ the other modules


def _source(spark: SparkSession, config: dict) -> Catalog:
    up = config["upstream"]
    return Catalog(spark, up["archive_path"], up["symbol_manifest_path"])


def _universe(catalog: Catalog, config: dict, dry_run: bool, most: int | None) -> DataFrame:
    s = config.get("selection") or {}
    limit = s.get("max_instruments")
    if dry_run:
        limit = min(limit or 1 << 30, int((config.get("execution") or {}).get("dry_run_max_files", 25)))
    if most is not None:
        limit = min(limit or 1 << 30, most)
    return catalog.list(exchange=s.get("exchange"), instrument_class=s.get("instrument_class"), require_rows=s.get("require_rows", True), explicit=s.get("instrument_ids"), limit=limit)


def same_universe(a: DataFrame, b: DataFrame) -> None:
    """Raises unless both have the same instruments."""
    one, two = (x.select("instrument_id").distinct() for x in (a, b))
    if (left := one.join(two, "instrument_id", "left_anti").limit(3).collect()) or (left := two.join(one, "instrument_id", "left_anti").limit(3).collect()):
        raise ValueError(f"the universes differ: {[r[0] for r in left]}")


def _finish(run: Run, module: str, rows: DataFrame, dry_run: bool, **more) -> str:
    manifest = stores.write_store(rows, f"{run.path}/store", KEYS[module], SCHEMAS[module], replace=True)
    summary = {"module": module, "dry_run": dry_run, "rows": manifest["rows"], "content_sha256": manifest["content_sha256"], "operational_errors": 0, **more}
    run.folder.write_json("summary.json", summary)
    run.folder.write_json("dataset_fingerprint.json", {f"{module}_dataset_sha256": manifest["content_sha256"], "schema_version": SCHEMAS[module]})
    run.complete(rows=manifest["rows"])
    return run.path


def build_features(spark: SparkSession, config: dict, resume: str | None = None, dry_run: bool = False, most: int | None = None) -> str:
    with Run(spark, config["execution"]["runs_root"], "features", config, resume) as run:
        source = _source(spark, config)
        universe = _universe(source, config, dry_run, most)
        rows = compute(source.bars(universe), int((config.get("features") or {}).get("max_calendar_gap_days", ft.MAX_GAP_DAYS)))
        expected = universe.agg(F.sum("valid_row_count")).first()[0] or 0
        stores.write_csv(ft.feature_quality(rows), f"{run.path}/feature_quality.csv", ["feature"])
        path = _finish(run, "features", rows, dry_run, expected_rows=expected)
        found = stores.read_manifest(spark, f"{path}/store")["rows"]
        if found != expected:
            raise ValueError(f"{found} feature rows for {expected} valid bars")
        return path


def compute(bars: DataFrame, max_gap_days: int) -> DataFrame:
    """Features of bars, stored as 32-bit numbers beside the bars themselves."""
    rows = ft.features(ft.segments(ft.increasing(bars).withColumn("signal_date", int_date("date")), max_gap_days))
    return rows.withColumns({c: F.col(c).cast("float") for c in ft.NAMES})


def _features(spark: SparkSession, root: str) -> DataFrame:
    """A feature store's rows, with the numbers as doubles again."""
    rows = stores.read_store(spark, f"{root}/store", SCHEMAS["features"])
    return rows.withColumns({c: F.col(c).cast("double") for c in ft.NAMES})


def build_candidates(spark: SparkSession, config: dict, resume: str | None = None, dry_run: bool = False, most: int | None = None) -> str:
    with Run(spark, config["execution"]["runs_root"], "candidates", config, resume) as run:
        found = signals.load_registry(config)
        root = config["upstream"]["feature_root"]
        rows = _features(spark, root)
        if "symbol_manifest_path" in config["upstream"]:
            source = _source(spark, config)
            same_universe(source.manifest.filter("valid_row_count > 0"), rows)
            universe = _universe(source, config, dry_run, most)
            rows = rows.join(universe.select("instrument_id"), "instrument_id", "left_semi")
        digest = stores.read_manifest(spark, f"{root}/store")["content_sha256"]
        out = None
        for g in found:
            signals.require(signals.signal_violations(g, rows), g.key)
            own = signals.materialize(g, rows)
            out = own if out is None else signals.combine([out, own])
        made = stage(signals.canonical(out, digest).join(out.select("candidate_id", "entry_source_row_number", "history_bars"), "candidate_id"), "candidates")
        signals.require(signals.row_violations(made), "candidate rows")
        counts = {f"{r['kind']}:{r['value']}": r["n"] for r in signals.diagnostic_counts(made).collect()}
        run.folder.write_json("candidate_diagnostics.json", signals.diagnostics(made, rows).first().asDict() | {"counts": counts})
        probes = any(isinstance(g, signals.EveryNth | signals.Peek) for g in found)
        path = _finish(run, "candidates", made, dry_run, generators=[g.key for g in found], test_generators_present=probes)
        unstage(made)
        return path


def _signals(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"signal_segment_id": "segment_id", "earliest_entry_date": "entry_date"})


def build_outcomes(spark: SparkSession, config: dict, resume: str | None = None, dry_run: bool = False, most: int | None = None) -> str:
    with Run(spark, config["execution"]["runs_root"], "outcomes", config, resume) as run:
        up = config["upstream"]
        held = _signals(stores.catalog(spark, {f"{i:04d}": f"{r}/store" for i, r in enumerate(up["candidate_roots"])}, SCHEMAS["candidates"]))
        rows = _features(spark, up["feature_root"])
        if dry_run or most is not None:
            few = held.select("instrument_id").distinct().orderBy("instrument_id").limit(most if most is not None else 25)
            held = held.join(few, "instrument_id", "left_semi")
        made = stage(outcomes.outcomes(held.drop("generator_root"), rows), "outcomes")
        signals.require(outcomes.outcome_violations(made), "outcome rows")
        stores.write_csv(outcomes.accounting(made), f"{run.path}/accounting.csv", ["instrument_id"])
        path = _finish(run, "outcomes", made, dry_run, candidates=held.count())
        unstage(made)
        return path


def build_research(spark: SparkSession, config: dict, resume: str | None = None, dry_run: bool = False, most: int | None = None) -> str:
    with Run(spark, config["execution"]["runs_root"], "research", config, resume) as run:
        up = config["upstream"]
        made = stores.read_store(spark, f"{up['outcome_root']}/store", SCHEMAS["outcomes"])
        held = _signals(stores.catalog(spark, {f"{i:04d}": f"{r}/store" for i, r in enumerate(up["candidate_roots"])}, SCHEMAS["candidates"])).drop("generator_root")
        development = outcomes.ticker_split(F.col("instrument_id")) == "development"  # before anything else is read
        rows = research.research_table(held.filter(development), made.filter(development), _features(spark, up["feature_root"]).filter(development))
        stores.write_csv(research.family_counts(rows), f"{run.path}/family_counts.csv", ["instrument_id"])
        return _finish(run, "research", rows, dry_run)


BUILDS = {"features": build_features, "candidates": build_candidates, "outcomes": build_outcomes, "research": build_research}


def verify(spark: SparkSession, module: str, root: str, output: str, config: dict | None = None) -> dict:
    """Checks a run's store, features also by computing them again from the archive; writes the report."""
    report = stores.verify_store(spark, f"{root}/store", PROTECTED.get(module))
    rows = stores.read_store(spark, f"{root}/store")
    if module == "candidates":
        report["violations"] = {r["check"]: r["violations"] for r in signals.row_violations(rows).collect()}
    elif module == "outcomes":
        report["violations"] = {r["check"]: r["violations"] for r in outcomes.outcome_violations(rows).collect()}
    elif module == "research":
        report["violations"] = {r["check"]: r["violations"] for r in research.leakage(rows).collect()}
    elif config:
        again = compute(_source(spark, config).bars(rows.select("instrument_id").distinct().join(_source(spark, config).manifest, "instrument_id")), int((config.get("features") or {}).get("max_calendar_gap_days", ft.MAX_GAP_DAYS)))
        report["violations"] = stores.compare_stores(rows, again).first().asDict()
    report["passed"] = stores.passed(report) and not any(report.get("violations", {}).values())
    folder, _, name = output.rpartition("/")
    Folder(spark, folder or ".").make().write_json(name, report)
    return report


def publish_run(spark: SparkSession, module: str, run: str, target: str) -> str:
    """Features and candidates replace what is published, outcomes, research and baselines refuse to."""
    folder = Folder(spark, run)
    summary, manifest = folder.read_json("summary.json"), folder.read_json("manifest.json")
    why = [k for k, bad in (("a dry run", summary.get("dry_run")), ("operational errors", summary.get("operational_errors")), ("test generators", summary.get("test_generators_present")), ("not completed", manifest["status"] != "completed")) if bad]
    if why:
        raise ValueError(f"the run cannot be published: {', '.join(why)}")
    if module in KEYS and not stores.passed(stores.verify_store(spark, f"{run}/store", PROTECTED.get(module))):
        raise ValueError("the run's store does not verify")
    return publish(spark, run, target, replace=module in ("data", "features", "candidates"))


# ------------------------------------------------------------------ baselines


def run_baselines(spark: SparkSession, config: dict, research_root: str, resume: str | None = None) -> str:
    """Walk-forward baselines of each family, the gate of their three scores, and the decisions."""
    own = config["baseline"]
    with Run(spark, config["execution"]["runs_root"], "baselines", config, resume) as run:
        rows = research.load_safe(stores.read_store(spark, f"{research_root}/store", SCHEMAS["research"]))
        columns = ["raw_setup_strength", *ft.NAMES]
        rows = rows.select("candidate_id", "instrument_id", "setup_family", "direction", "signal_date", "h20_end_date", "y_return", "y_target", *columns)
        members = stage(research.fold_members(rows, research.folds(spark)), "members")
        status = stage(research.fold_status(members, int(own["minimum_train_rows"]), int(own["minimum_test_rows"])), "status")
        valid = [(r["setup_family"], r["fold"]) for r in status.filter("status = 'valid'").orderBy("setup_family", "fold").collect()]
        oof = models.walk_forward(members, columns, valid, float(own["ridge_alpha"]), float(own["logistic_c"]))
        coefficients = {}
        for family, fold in valid:
            ready, line, odds = models.fitted(members, columns, family, fold, float(own["ridge_alpha"]), float(own["logistic_c"]))
            coefficients.setdefault(family, []).append({"fold": fold, "ridge_top_coefficients": models.top_coefficients(ready, line), "logistic_top_coefficients": models.top_coefficients(ready, odds)})
        gates = research.score_gates(oof, ("raw_score", "ridge_score", "logistic_score"), own.get("gate", research.GATE), float(own.get("top_fraction", 0.1)))
        decided = research.decide(gates, status, int(own["minimum_oof_rows"]), int(own["minimum_valid_folds"]))
        stores.write_predictions(oof, f"{run.path}/oof_predictions")
        stores.write_csv(status, f"{run.path}/fold_metrics.csv", ["setup_family", "fold"])
        stores.write_csv(decided, f"{run.path}/family_metrics.csv", ["setup_family"])
        run.folder.write_json("model_metadata.json", coefficients)
        report = {r["setup_family"]: r.asDict() for r in decided.collect()}
        for r in gates.collect():
            report[r["setup_family"]].setdefault("score_gates", {})[r["score"]] = r.asDict()
        run.folder.write_json("family_gate.json", report)
        summary = {"dry_run": False, "family_count": len(report), "total_oof_rows": oof.count(), "proceed_family_count": sum(r["decision"].startswith("PROCEED") for r in report.values()), "protected_rows_accessed": 0}
        run.folder.write_json("summary.json", summary)
        run.complete(**summary)
        unstage(members, status, oof)
        return run.path


def compare_runs(spark: SparkSession, first: str, second: str, output: str, tables: tuple[str, ...], counts: tuple[str, ...]) -> dict:
    """Tables row by row, and the counts of the summaries."""
    a, b = Folder(spark, first), Folder(spark, second)
    report: dict = {"tables": {}, "counts": {}}
    for name in tables:
        if a.exists(name) and b.exists(name):
            x, y = (spark.read.option("header", True).csv(f"{f.path}/{name}") for f in (a, b))
            report["tables"][name] = x.columns == y.columns and stores.compare_stores(x, y).first().asDict() == {"only_a": 0, "only_b": 0}
        else:
            report["tables"][name] = False
    x, y = a.read_json("summary.json"), b.read_json("summary.json")
    report["counts"] = {k: {"first": x.get(k), "second": y.get(k), "match": x.get(k) == y.get(k)} for k in counts}
    report |= {"first": first, "second": second, "deterministic_match": all(report["tables"].values()) and all(c["match"] for c in report["counts"].values())}
    folder, _, name = output.rpartition("/")
    Folder(spark, folder or ".").make().write_json(name, report)
    return report


AUDIT_TABLES = ("archive_inventory.csv", "symbol_manifest.csv", "invalid_rows.csv", "file_errors.csv")
AUDIT_COUNTS = ("archive_sha256", "dataset_fingerprint_sha256", "archive_member_count", "classified_member_count_in_inventory", "audited_member_count", "row_count", "valid_row_count", "invalid_row_count", "file_error_count", "empty_file_count")
BASELINE_TABLES = ("fold_metrics.csv", "family_metrics.csv")
BASELINE_COUNTS = ("family_count", "total_oof_rows", "proceed_family_count", "protected_rows_accessed")
