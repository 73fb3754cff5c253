"""A scan: files, their parses, hits, findings and sums, as DataFrames that nothing has run yet."""

from __future__ import annotations

import datetime
import os
import time
from dataclasses import asdict, dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from csift.operators import baseline as baselines
from csift.operators import summary
from csift.operators.findings import AST, HYBRID, REGEX, at_least, findings, in_report_order, needs_facts, with_hits
from csift.operators.parse import parsed
from csift.plans.progress import Progress
from csift.rules import catalog
from csift.rules.custom import NUMBERS, CustomRule
from csift.sources.config import Config
from csift.sources.files import from_lake, from_text, relative
from csift.sources.ignore import IgnoreRules
from csift.sources.listing import FILE, IGNORED, LISTED, list_tree, read_listing


@dataclass(frozen=True)
class ScanConfig:
    """What a scan does; plain values, so that it can be stored and given to others."""

    numbers: tuple[int, ...] = tuple(r.number for r in catalog.RULES)
    mode: str = HYBRID
    severity: str = "all"
    suppress: bool = True
    prefix: str = catalog.PREFIX
    keyword: str = "csift"
    overrides: dict[str, str] = field(default_factory=dict)
    banned: dict[str, tuple[str, str]] = field(default_factory=dict)
    allocators: tuple[str, ...] = ()
    reallocators: tuple[str, ...] = ()
    deallocators: tuple[str, ...] = ()

    def __post_init__(self):
        if self.mode not in (REGEX, AST, HYBRID):
            raise ValueError(f"mode must be regex, ast or hybrid: {self.mode!r}")

    @classmethod
    def of(cls, project: Config, **values) -> ScanConfig:
        prefix = values.get("prefix", catalog.PREFIX)
        kept = tuple(r.number for r in catalog.RULES if catalog.rule_id(r.number, prefix) not in project.skipped)
        return cls(numbers=kept, overrides=project.severities, banned=project.banned, allocators=tuple(project.allocators), reallocators=tuple(project.reallocators), deallocators=tuple(project.deallocators), **values)

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> ScanConfig:
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
        known["banned"] = {k: tuple(v) for k, v in known.get("banned", {}).items()}
        return cls(**known)


@dataclass
class Scan:
    """parses, findings (in no order) and summaries; ignored and failed paths; new findings only once a baseline is applied."""

    target: str
    config: ScanConfig
    parses: DataFrame
    findings: DataFrame
    summaries: DataFrame
    errors: DataFrame
    ignored_files: DataFrame | None = None
    discovered: int | None = None
    started: float = field(default_factory=time.time)
    timestamp: str = field(default_factory=lambda: datetime.datetime.now(datetime.timezone.utc).isoformat())
    resolved: int | None = None
    baseline_path: str | None = None
    rules: int = 0

    @property
    def ignored(self) -> list[str]:
        """Paths of files that ignore rules left out, in order; `ignored_files` has them as rows."""
        return sorted(r["file_path"] for r in self.ignored_files.collect()) if self.ignored_files is not None else []

    def ordered(self) -> DataFrame:
        return in_report_order(self.findings)

    def unpersist(self) -> None:
        """Gives up what the scan keeps for its reports."""
        self.findings.unpersist()
        self.parses.unpersist()

    def against(self, path: str) -> tuple[Scan, str | None]:
        """The scan with new findings only, and a warning if the baseline applied other rules. Summaries stay whole."""
        spark = self.findings.sparkSession
        counts, rules = baselines.read_baseline(spark, path)
        out = Scan(**{**self.__dict__, "findings": baselines.new_findings(self.findings, counts)})
        out.resolved, out.baseline_path = baselines.resolved_count(self.findings, counts).first()["resolved"], path
        warning = f"the baseline applied {rules} rules, this scan {self.rules}" if rules is not None and rules != self.rules else None
        return out, warning


def scan_files(files: DataFrame, config: ScanConfig = ScanConfig(), target: str = "", custom: tuple[CustomRule, ...] = (), progress: Progress | None = None) -> Scan:
    """files: path and content, and read_error where a file could not be read."""
    unread = files.filter("read_error is not null") if "read_error" in files.columns else None
    readable = files.filter("read_error is null") if unread is not None else files
    facts = needs_facts(config.numbers, config.mode) or config.mode != REGEX and any(r.query for r in custom)
    functions = tuple((NUMBERS + k, r.scan_line) for k, r in enumerate(custom) if r.scan_line is not None)
    numbers = config.numbers if config.mode != AST else ()
    parses = parsed(readable, facts, config.allocators, config.reallocators, config.deallocators, numbers, config.banned, functions, progress.seen if progress else None).persist(StorageLevel.MEMORY_AND_DISK)
    rows = with_hits(parses, config.numbers, config.mode, config.reallocators, custom)
    found = findings(rows, config.prefix, config.overrides, config.suppress, config.keyword, config.numbers, custom)
    found = at_least(found, config.severity).persist(StorageLevel.MEMORY_AND_DISK)
    errors = parses.filter("error is not null").select(F.col("path").alias("file_path"), "error.error_type", "error.message")
    # read by a weaker tier, for a stated reason
    errors = errors.unionByName(parses.filter("parse.reason is not null").select(F.col("path").alias("file_path"), F.lit("MacroLimit").alias("error_type"), F.col("parse.reason").alias("message")))
    sums = summary.file_summaries(parses, found)
    if unread is not None:
        errors = errors.unionByName(unread.select(F.col("path").alias("file_path"), F.lit("OSError").alias("error_type"), F.col("read_error").alias("message")))
        lost = unread.select(F.col("path").alias("file_path"), F.lit("failed").alias("status"), F.lit("parse-failed").alias("parser"))
        sums = sums.unionByName(lost, allowMissingColumns=True).fillna(0)
    return Scan(target, config, parses, found, sums, errors, rules=len(config.numbers) + len(custom))


def scan_text(spark: SparkSession, text: str, path: str = "source.c", config: ScanConfig = ScanConfig(), custom: tuple[CustomRule, ...] = ()) -> Scan:
    return scan_files(from_text(spark, text, path), config, path, custom)


def scan_path(spark: SparkSession, target: str, config: ScanConfig = ScanConfig(), project: Config | None = None, ignore_file: str | None = None, patterns=(), partitions: int | None = None, custom: tuple[CustomRule, ...] = (), progress: Progress | None = None) -> Scan:
    """A folder or a file. Ignore rules: defaults, patterns, the project's excludes, the folder's ignore file, a given one.

    A folder of a store (scheme://...) is listed and read by Spark; its ignored paths aren't told.
    """
    if partitions is not None and partitions < 0:
        raise ValueError("partitions must not be negative")
    if "://" in target:
        rules = IgnoreRules([*patterns, *(project.excludes if project else [])])
        if ignore_file:
            rules.add_file(ignore_file)
        files = from_lake(spark, target)
        files = files.withColumn("path", relative(F.col("path"), target)).filter(~rules.column(F.col("path")))
        return scan_files(files.repartition(partitions) if partitions else files, config, target, custom, progress)
    base = target if os.path.isdir(target) else os.path.dirname(os.path.abspath(target))
    rules = IgnoreRules([*patterns, *(project.excludes_from(base) if project else [])])
    rules.add_file(os.path.join(base, ".csiftignore"))
    if ignore_file:
        rules.add_file(ignore_file)
    if os.path.isfile(target):
        listing = spark.createDataFrame([(os.path.basename(target), FILE, os.path.getsize(target))], LISTED)
    elif os.path.isdir(target):
        listing = list_tree(spark, os.path.abspath(target), rules)
    else:
        raise FileNotFoundError(f"no such file or folder: {target}")
    if progress:
        progress.total = listing.filter(F.col("kind") == FILE).count()
    out = scan_files(read_listing(listing, os.path.abspath(base), partitions or None), config, target, custom, progress)
    out.ignored_files, out.discovered = listing.filter(F.col("kind") == IGNORED).select(F.col("path").alias("file_path")), listing.count()
    return out
