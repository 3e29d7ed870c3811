"""Linting files as they arrive: a stream of paths, each micro-batch scanned and checked, diagnostics appended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalogue import Config
from ..plans.engine import check
from ..sources.scan import scan, views


def lint_stream(paths: DataFrame, out: str, checkpoint: str, cfg: Config | None = None) -> StreamingQuery:
    """paths streams a column path. Rules that compare files see those of one micro-batch. out gets a Parquet folder for
    each batch, overwritten if the batch is run again, so that diagnostics are written once."""

    def run(batch: DataFrame, n: int) -> None:
        got = [r.path for r in batch.select("path").distinct().toLocalIterator()]
        if got:
            check(views(scan(batch.sparkSession, got, cfg)), cfg).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return paths.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
