"""Linting: selection before plans are built, kernels, one ordering."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import columnar
from ..operators.catalogue import GUIDE, RANK, RULES, Config
from ..sources.scan import scan, views

#: What emitted diagnostics of a catalogue rule call their category, where it differs from the catalogue's.
EMITTED = {"AL206": "lance"}


def check(v: dict[str, DataFrame], cfg: Config | None = None) -> DataFrame:
    """Diagnostics over views: rule_id, severity, category, message, path, location, in the reporting order."""
    cfg = cfg or Config()
    parts = []
    for rules, kernel in columnar.KERNELS:
        on = [r for r in rules if cfg.enabled(r)]
        if on:
            parts.append(kernel(v, cfg, on) if kernel is columnar.chunk_rules else kernel(v, cfg))
    for rule in cfg.declared:
        if cfg.enabled(rule["rule"]) and (got := columnar.declared(v, cfg, rule)) is not None:
            parts.append(got)
    names = [r[0] for r in RULES] + [d["rule"] for d in cfg.declared]
    allowed = [r for r in names if cfg.enabled(r)]
    category = F.coalesce(*(F.when(F.col("rule_id") == r[0], EMITTED.get(r[0], r[2])) for r in RULES), F.lit("metadata"))
    found = columnar.union(parts) if parts else columnar.small_files(v, cfg).limit(0)
    found = found.filter(F.col("rule_id").isin(allowed)).withColumn("category", category)
    helps = F.element_at(F.create_map(*(F.lit(x) for r, (_, text) in GUIDE.items() for x in (r, text))), F.col("rule_id"))
    found = found.withColumn("help", F.coalesce(helps, F.lit("add the key to the file's or the schema's metadata")))
    return found.orderBy(F.col("path").asc_nulls_first(), "rule_id", "message", "file_idx", "seq").select("rule_id", "severity", "category", "message", "path", "location", "help")


def lint(spark: SparkSession, paths: list[str] | str, config: Config | None = None, only: list[str] | None = None, disabled: list[str] | None = None) -> DataFrame:
    """only replaces the configured selection, disabled adds to it. The scan stays cached for what is made of the result;
    linted() frees it."""
    cfg = _config(config, only, disabled)
    return check(views(scan(spark, [paths] if isinstance(paths, str) else list(paths), cfg)), cfg)


def _config(config: Config | None, only, disabled) -> Config:
    cfg = config or Config()
    return replace(cfg, only=cfg.only if only is None else list(only), disabled=[*cfg.disabled, *(disabled or [])])


@contextmanager
def linted(spark: SparkSession, paths: list[str] | str, config: Config | None = None, only: list[str] | None = None, disabled: list[str] | None = None):
    """(files, diagnostics) while the scan is cached; it's freed at the end."""
    cfg = _config(config, only, disabled)
    got = scan(spark, [paths] if isinstance(paths, str) else list(paths), cfg)
    found = check(views(got), cfg).persist()
    try:
        yield got, found
    finally:
        found.unpersist()
        got.unpersist()


def has_failure(diagnostics: DataFrame, at: str = "error") -> bool:
    rank = F.coalesce(*(F.when(F.col("severity") == s, n) for s, n in RANK.items()))
    return not diagnostics.filter(rank >= RANK[at]).limit(1).isEmpty()
