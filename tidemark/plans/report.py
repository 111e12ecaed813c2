"""The acceptance report of an audit run, as Markdown and JSON."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.files import Folder


def number(x) -> str:
    return f"{int(x or 0):,}"


def percent(x) -> str:
    return "n/a" if x is None else f"{100 * x:.2f}%"


def acceptance(summary: dict, comparison: dict | None) -> list[str]:
    """What speaks against a run; an empty list accepts it."""
    rules = {
        "it is a dry run": bool(summary.get("dry_run")),
        "not every classified member was audited": summary.get("audited_member_count") != summary.get("classified_member_count_in_inventory"),
        "members could not be read": summary.get("file_error_count") != 0,
        "instrument ids repeat": summary.get("duplicate_instrument_id_count") != 0,
        "the archive has no hash": not summary.get("archive_sha256"),
        "the dataset has no fingerprint": not summary.get("dataset_fingerprint_sha256"),
        "it was not compared with another full run": comparison is None,
        "another full run gave other results": comparison is not None and not comparison.get("deterministic_match"),
    }
    return [k for k, bad in rules.items() if bad]


def _list(pairs: dict) -> list[str]:
    return [f"- {k}: {number(n)}" for k, n in pairs.items()] or ["- none"]


def text(summary: dict, manifest: dict, comparison: dict | None, against: list[str]) -> str:
    get, lineage = summary.get, manifest.get("lineage", {})
    sections = {
        "Verdict": ["**NOT ACCEPTED**" if against else "**ACCEPTED**", "", *(f"- {x}" for x in against)],
        "Run": [
            f"- run: `{manifest.get('run_id')}`", f"- configuration: `{manifest.get('config_sha256')}`", f"- sources: `{lineage.get('source_tree_sha256')}`", f"- commit: `{lineage.get('git_commit')}`",
            f"- archive: `{get('archive_sha256')}`", f"- dataset: `{get('dataset_fingerprint_sha256')}`",
        ],
        "Coverage": [
            f"- members: {number(get('archive_member_count'))}, classified {number(get('classified_member_count_in_inventory'))}, audited {number(get('audited_member_count'))}",
            f"- dates: {get('global_first_date')} to {get('global_last_date')}",
        ],
        "Exchanges": _list(get("exchange_counts", {})),
        "Classes": _list(get("instrument_class_counts", {})),
        "Rows": [
            f"- all: {number(get('row_count'))}, valid {number(get('valid_row_count'))}, quarantined {number(get('invalid_row_count'))}", f"- zero volume: {number(get('zero_volume_row_count'))}",
            f"- moves above 50 %: {number(get('extreme_return_50_count'))}, above 100 %: {number(get('extreme_return_100_count'))}",
            f"- empty members: {number(get('empty_file_count'))}, with an invalid header: {number(get('invalid_header_file_count'))}, unreadable: {number(get('file_error_count'))}",
        ],
        "Quarantine": _list(get("invalid_reason_counts", {})),
        "Identity": [f"- repeated instrument ids: {number(get('duplicate_instrument_id_count'))}", f"- tickers in several places: {number(get('duplicate_ticker_count'))} (a ticker is no key)"],
        "Survivors": [f"- within {get('survivor_window_days')} days of the last date: {number(get('survivor_like_instrument_count'))} of {number(get('dated_instrument_count'))}, {percent(get('survivor_like_fraction'))}"],
        "Reproduction": ["- compared with another run: " + ("no" if comparison is None else "equal" if comparison.get("deterministic_match") else "different")],
    }
    return "# Acceptance of the audit\n\n" + "\n\n".join(f"## {k}\n\n" + "\n".join(x for x in v) for k, v in sections.items()) + "\n"


def write_report(spark: SparkSession, run: str, output: str) -> dict:
    """Writes ``output`` (Markdown) and its JSON beside it. The comparison is read from determinism_check.json in the run."""
    folder = Folder(spark, run)
    summary, manifest = folder.read_json("summary.json"), folder.read_json("manifest.json")
    comparison = folder.read_json("determinism_check.json") if folder.exists("determinism_check.json") else None
    against = acceptance(summary, comparison)
    place, _, name = output.rpartition("/")
    target = Folder(spark, place or ".").make()
    target.write(name, text(summary, manifest, comparison, against))
    verdict = {"accepted": not against, "failures": against, "run_id": manifest.get("run_id"), "module_version": summary.get("module_version"), "dataset_fingerprint_sha256": summary.get("dataset_fingerprint_sha256")}
    target.write_json(name.removesuffix(".md") + ".json", verdict)
    return verdict
