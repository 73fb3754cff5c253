"""The command line: scan, rules, init-ignore."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import tempfile

from csift import __version__
from csift.operators.baseline import BadBaseline
from csift.plans import report as reports
from csift.plans.progress import Progress
from csift.plans.scan import ScanConfig, scan_path
from csift.rules import catalog
from csift.sources.config import BadConfig, load_config

COMMANDS = ("scan", "rules", "init-ignore")
TEMPLATE = "# Paths that scans leave out; the last rule that matches decides, ! brings back.\nvendor/\nthird_party/\ntests/\n"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="csift", description="Analyses C source code with Spark.")
    out.add_argument("--version", action="version", version=f"csift {__version__}")
    commands = out.add_subparsers(dest="command")
    scan = commands.add_parser("scan")
    scan.add_argument("target", nargs="?", default=".")
    scan.add_argument("--config", "-c")
    scan.add_argument("--output", "-o")
    scan.add_argument("--format", "-f", choices=sorted(reports.FORMS))
    scan.add_argument("--quiet", "-q", action="store_true")
    scan.add_argument("--ignore-file")
    scan.add_argument("--ignore-pattern", action="append", default=[])
    scan.add_argument("--severity", choices=("all", "high", "medium", "low"), default="all")
    scan.add_argument("--engine", choices=("hybrid", "regex", "ast"), default="hybrid")
    scan.add_argument("--fail-on", choices=("high", "medium", "low", "all", "none"))
    scan.add_argument("--fail-on-high", action="store_true")
    scan.add_argument("--fail-on-error", action="store_true")
    scan.add_argument("--warn-on-fallback", action="store_true")
    scan.add_argument("--jobs", "-j", type=int, default=0, help="partitions that files are read in; 0: by the cluster's size")
    scan.add_argument("--baseline")
    scan.add_argument("--update-baseline")
    rules = commands.add_parser("rules")
    rules.add_argument("--config", "-c")
    commands.add_parser("init-ignore")
    return out


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("csift").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def show(completed: int, total: int, path: str | None) -> None:
    """One line of a terminal, written over and over."""
    width = shutil.get_terminal_size().columns - 1
    print(f"\r{f'[{completed}/{total}] {reports.plain(path or str())}'[:width]:{width}}", end="" if completed < total else "\n", file=sys.stderr, flush=True)


def write(scan, form: str, head: dict, path: str | None) -> None:
    """A report to a file, or by way of one to the terminal."""
    if path is not None:
        reports.write_report(scan, form, path if "://" in path else os.path.abspath(path), head)
        return
    with tempfile.TemporaryDirectory() as folder:
        reports.write_report(scan, form, f"{folder}/report", head)
        with open(f"{folder}/report", encoding="utf-8") as file:
            shutil.copyfileobj(file, sys.stdout)


def run_scan(args, spark=None) -> int:
    complain = lambda text: print(f"csift: {reports.plain(text)}", file=sys.stderr)
    try:
        project = load_config(args.config, args.target)
        for text in project.warnings:
            complain(f"warning: {text}")
        config = ScanConfig.of(project, mode=args.engine, severity=args.severity)
        spark = spark or session()
        with Progress(spark, show if sys.stderr.isatty() and not args.quiet else lambda *_: None) as progress:
            scan = scan_path(spark, args.target, config, project, args.ignore_file, args.ignore_pattern, args.jobs, progress=progress)
            head = reports.overview(scan)
        if args.update_baseline:
            write(scan, "json", head, args.update_baseline)
        if args.baseline:
            scan, warning = scan.against(args.baseline)
            if warning:
                complain(f"warning: {warning}")
            head = reports.overview(scan)
        write(scan, reports.chosen_format(args.format, project.default_format, args.output), head, args.output)
        if not args.quiet:
            for e in scan.errors.orderBy("file_path").toLocalIterator():
                complain(f"error: {e['file_path']}: {e['error_type']}: {e['message']}")
    except (OSError, BadConfig, BadBaseline, ValueError) as error:
        complain(f"error: {error}")
        return 1
    fail_on = "high" if args.fail_on_high else args.fail_on or project.fail_on
    return reports.exit_code(head, fail_on, args.fail_on_error, args.warn_on_fallback or project.warn_on_fallback)


def run_rules(args) -> int:
    try:
        project = load_config(args.config)
    except BadConfig as error:
        print(f"csift: error: {error}", file=sys.stderr)
        return 1
    place = {"High": 0, "Medium": 1}
    for r in sorted(catalog.RULES, key=lambda r: (place.get(project.severities.get(r.rule_id, r.impact), 2), r.rule_id)):
        state = "SKIPPED" if r.rule_id in project.skipped else "ACTIVE"
        print(f"{r.rule_id}  {project.severities.get(r.rule_id, r.impact):6}  {state:7}  {r.name}: {r.description}")
    return 0


def run_init_ignore() -> int:
    if os.path.exists(".csiftignore"):
        print("csift: .csiftignore is there already", file=sys.stderr)
        return 1
    with open(".csiftignore", "w", encoding="utf-8") as file:
        file.write(TEMPLATE)
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    """No arguments mean `scan .`, a bare path means `scan path`."""
    argv = list(sys.argv[1:] if argv is None else argv) or ["scan", "."]
    if argv[0] not in COMMANDS and not argv[0].startswith("-"):
        argv.insert(0, "scan")
    args = parser().parse_args(argv)
    try:
        if args.command == "rules":
            return run_rules(args)
        if args.command == "init-ignore":
            return run_init_ignore()
        return run_scan(args, spark)
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
