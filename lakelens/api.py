"""The library's functions in one place."""

from .functions.report import formats, render, render_diff, rules
from .operators.catalogue import Config
from .plans.diff import diff
from .plans.engine import check, has_failure, lint, linted

__all__ = ["Config", "check", "diff", "formats", "has_failure", "lint", "linted", "render", "render_diff", "rules"]
