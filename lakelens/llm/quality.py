"""Operator 3: quality rules whose cutoffs hold the share of good documents they reject below a limit, with stated confidence."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .common import SPACE, stash, with_columns

#: The characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
#: Each rule's score, in thousandths, grows with what it dislikes.
RULES = {
    "symbols": "1000 * n_symbols / greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "1000 * n_repeat_words / greatest(n_words, 1)",
    "long_words": "1000 * word_chars / greatest(n_words, 1) / 100",
}
#: Cutoffs that are tested, loosest first.
GRID = tuple(sorted({round(1000 * 0.85**k, 1) for k in range(40)}, reverse=True))


def repeated(ws: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(ws) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
    _, at, n = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = n[at] > 1
    mark = np.zeros(len(ws), bool)
    mark[:-2] |= again
    mark[1:-1] |= again
    mark[2:] |= again
    return int(mark.sum())


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    ws = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (len(ws), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated(ws))


def features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of COUNTS and base_failed. A null text has none of anything; columns of these names are replaced."""

    def run(cols):
        got = [measure(t) for t in cols[0].to_pylist()]
        return [pa.array([g[i] for g in got], pa.int64()) for i in range(len(COUNTS))]

    out = with_columns(df, [text], run, [T.StructField(c, T.LongType()) for c in COUNTS])
    return out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


def cutoffs(good: dict[str, int], rejected: dict[tuple[str, str, float], int], limit: float, error: float) -> dict[str, dict[str, float]]:
    """By stratum and rule, the tightest cutoff whose rate of false rejection is below the limit.

    Within a rule, cutoffs are tested from the loosest on and testing stops at the first that fails (a fixed sequence needs
    no correction); over strata and rules the allowed error is divided (Bonferroni), as is the limit over the rules, which
    reject together. A test is the exact binomial one: what was seen, or less, has probability at most the error if the
    rate were the limit; that is, the Clopper-Pearson upper bound is below it."""
    out: dict[str, dict[str, float]] = {}
    for s, n in good.items():
        for rule in RULES:
            for c in GRID:
                if tail(n, rejected[s, rule, c], limit / len(RULES)) > error / (len(good) * len(RULES)):
                    break
                out.setdefault(s, {})[rule] = c
    return out


def judge(df: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.02, error: float = 0.05, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with counts, base_failed and kept. With confidence 1 - error, in every stratum at most the limit's share of good
    documents that pass the base is rejected.

    The holdout are all rows of df with a label of quality 1 that pass the base. A stratum with too few has no cutoffs and
    rejects by the base alone; null is a stratum of its own. Repeated labels count once. Strata are a few categories: their
    counts, and nothing else, come to the driver. kept is never null. Columns of the new names are replaced. Without keep_text the
    text isn't carried on."""
    got = features(df, text)
    got = stash(got if keep_text else got.drop(text), "quality")
    own = F.coalesce(F.col(stratum).cast("string"), F.lit("\x00none"))
    good = labels.filter("quality = 1").select(F.col(doc_id).alias("__good")).distinct()
    held = got.filter("not base_failed").select(own.alias("s"), F.col(doc_id).alias("__id"), *(F.expr(e).alias(r) for r, e in RULES.items())).join(good, F.col("__id") == F.col("__good"))
    sums = [F.count(F.when(F.col(r) > c, 1)).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(GRID)]
    rows = held.groupBy("s").agg(F.count("*").alias("n"), *sums).collect()
    found = cutoffs({r.s: r.n for r in rows}, {(r.s, rule, c): r[f"{rule}_{i}"] for r in rows for rule in RULES for i, c in enumerate(GRID)}, limit, error)
    reject = F.col("base_failed")
    for s, by in sorted(found.items()):
        for rule, c in by.items():
            reject = reject | ((own == s) & (F.expr(RULES[rule]) > c))
    return got.withColumn("kept", ~reject)
