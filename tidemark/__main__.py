"""python -m tidemark AREA COMMAND: audits, builds, verification, publication, baselines, reports and the doctor."""

from __future__ import annotations

import argparse
import json
import sys


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description="Causal research on daily price bars")
    areas = top.add_subparsers(dest="area", required=True)

    def command(area, name: str, about: str, *arguments: str, **more):
        own = area.add_parser(name, help=about)
        for a in arguments:
            own.add_argument(f"--{a}", required=True)
        for a, how in more.items():
            own.add_argument(f"--{a.replace('_', '-')}", **how)

    flag, optional = {"action": "store_true"}, {"default": None}
    data = areas.add_parser("data", help="the archive").add_subparsers(dest="command", required=True)
    command(data, "audit", "audit every classified member", "config", resume=optional, dry_run=flag)
    command(data, "compare", "compare two audits", "first", "second", "output")
    command(data, "report", "write the acceptance report", "run", "output")
    command(data, "show", "show bars of one member", "archive", "member", rows={"type": int, "default": 5}, strict=flag)
    for name in ("features", "candidates", "outcomes", "research"):
        area = areas.add_parser(name, help=f"the {name}").add_subparsers(dest="command", required=True)
        command(area, "build", "build from a config", "config", resume=optional, dry_run=flag, max_new={"type": int, "default": None})
        command(area, "verify", "verify a run or what was published", "reference", "output", config=optional)
        command(area, "publish", "publish a completed run", "run", "target")
        if name == "research":
            command(area, "baselines", "walk-forward baselines and the gate", "config", "research-root", resume=optional)
            command(area, "compare-baselines", "compare two baseline runs", "first", "second", "output")
            command(area, "publish-baselines", "publish a baseline run", "run", "target")
    doctor = areas.add_parser("doctor", help="check files, packages and configs")
    doctor.add_argument("--project-root", default=None)
    doctor.add_argument("--config", action="append", default=[])
    doctor.add_argument("--json", action="store_true")
    return top


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(args: argparse.Namespace, spark=None):
    """What a command returns: a path, a report, or a table to show."""
    from .plans import builds, doctor, report
    from .plans.runs import ROOT, load_config

    if args.area == "doctor":
        return doctor.inspect(args.project_root or ROOT, tuple(args.config))
    spark = spark or session()
    key = (args.area, args.command)
    if key == ("data", "audit"):
        return builds.audit(spark, load_config(args.config), args.resume, args.dry_run)
    if key == ("data", "compare"):
        return builds.compare_runs(spark, args.first, args.second, args.output, builds.AUDIT_TABLES, builds.AUDIT_COUNTS)
    if key == ("data", "report"):
        return report.write_report(spark, args.run, args.output)
    if key == ("data", "show"):
        from .sources.archive import read_zip
        from .sources.catalog import bars_of

        return bars_of(read_zip(spark, args.archive, only=[args.member]), "raise" if args.strict else "drop").orderBy("source_row_number").limit(args.rows)
    if args.command == "build":
        return builds.BUILDS[args.area](spark, load_config(args.config), args.resume, args.dry_run, args.max_new)
    if args.command == "verify":
        return builds.verify(spark, args.area, args.reference, args.output, load_config(args.config) if args.config else None)
    if args.command == "baselines":
        return builds.run_baselines(spark, load_config(args.config), args.research_root, args.resume)
    if args.command == "compare-baselines":
        return builds.compare_runs(spark, args.first, args.second, args.output, builds.BASELINE_TABLES, builds.BASELINE_COUNTS)
    return builds.publish_run(spark, "baselines" if args.command == "publish-baselines" else args.area, args.run, args.target)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    found = run(args)
    if args.area == "doctor":
        if args.json:
            print(json.dumps(found, indent=2, sort_keys=True))
        else:
            print("\n".join([f"doctor: {'PASS' if found['passed'] else 'FAIL'}", *(f"[{'PASS' if c['passed'] else 'FAIL'}] {c['name']}: {c['detail']}" for c in found["checks"])]))
        return 0 if found["passed"] else 1
    if hasattr(found, "show"):
        found.show(truncate=False)
        return 0
    print(found if isinstance(found, str) else json.dumps(found, indent=2, sort_keys=True, default=str))
    return 0 if not isinstance(found, dict) or found.get("passed", found.get("deterministic_match", found.get("accepted", True))) else 1


if __name__ == "__main__":
    sys.exit(main())
