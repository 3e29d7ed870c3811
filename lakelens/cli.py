"""Command line: lint, rules, formats, diff."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .functions import report
from .operators.catalogue import Config
from .plans.diff import diff
from .plans.engine import has_failure, linted


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lakelens")
    sub = p.add_subparsers(dest="what", required=True)
    a = sub.add_parser("lint")
    a.add_argument("paths", nargs="+")
    a.add_argument("--config")
    a.add_argument("--only", action="append")
    a.add_argument("--disable", action="append")
    a.add_argument("--fail-on", default="error", choices=("info", "warning", "error", "never"))
    d = sub.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--exit-code", action="store_true")
    for x in (a, d, sub.add_parser("rules"), sub.add_parser("formats")):
        x.add_argument("--output", default="text")
    args = p.parse_args(argv)
    if args.what in ("rules", "formats"):
        got = report.rules() if args.what == "rules" else report.formats()
        print(json.dumps(got, indent=2) if report.output_format(args.output) == "json" else "\n".join(" ".join(map(str, r.values())) for r in got))
        return 0
    spark = spark or SparkSession.builder.appName("lakelens").getOrCreate()
    try:
        if args.what == "lint":
            with linted(spark, args.paths, Config.load(args.config) if args.config else None, args.only, args.disable) as (files, found):
                print(report.render(found, args.output, files), end="")
                return int(args.fail_on != "never" and has_failure(found, args.fail_on))
        got = diff(spark, [args.old], [args.new])
        print(report.render_diff(got, args.output), end="")
        return int(args.exit_code and got["has_changes"])
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
