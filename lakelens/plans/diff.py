"""Comparing two datasets by their metadata: every section is a DataFrame over two sets of views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.scan import scan, views


def summary(v) -> DataFrame:
    """One row: formats, file_count, rows (null if any file's are unknown), size."""
    return v["files"].agg(F.array_join(F.array_sort(F.collect_set("format")), ",").alias("formats"), F.count("*").alias("file_count"), F.when(F.count("num_rows") == F.count("*"), F.sum(F.col("num_rows").cast("decimal(38,0)"))).cast("bigint").alias("num_rows"), F.sum("size_bytes").cast("bigint").alias("size_bytes"))


def first_schema(v) -> DataFrame:
    """(name, pos, data_type, nullable) of the first file that has a schema; of a repeated name, the last."""
    first = v["fields"].agg(F.min("file_idx").alias("f"))
    one = v["fields"].join(F.broadcast(first), F.col("file_idx") == F.col("f"))
    return one.groupBy("name").agg(F.max(F.struct("pos", "data_type", "nullable")).alias("x")).select("name", "x.*")


def schema_changes(old, new) -> DataFrame:
    """(name, change, old_type, new_type) by a full outer join on the name."""
    a, b = first_schema(old).select("name", F.struct("data_type", "nullable").alias("o")), first_schema(new).select("name", F.struct("data_type", "nullable").alias("n"))
    j = a.join(b, "name", "full_outer")
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return j.withColumn("change", change).filter("change is not null").select("name", "change", F.col("o.data_type").alias("old_type"), F.col("n.data_type").alias("new_type"))


def schema_identity(old, new) -> DataFrame:
    """One row: whether both have the same set of field lists, and whether the names come in another order."""
    from ..operators.columnar import fingerprint

    prints = lambda v: v["files"].filter("schema is not null").agg(F.array_sort(F.collect_set(fingerprint())).alias("p"), F.min_by(F.transform(F.col("schema")["fields"], lambda f: f["name"]), "file_idx").alias("names"))
    a, b = prints(old).toDF("pa", "na"), prints(new).toDF("pb", "nb")
    return a.join(b).select(F.when((F.size("pa") > 0) & (F.size("pb") > 0), F.col("pa") == F.col("pb")).alias("identical"), F.coalesce(F.col("na") != F.col("nb"), F.lit(False)).alias("order_changed"))


def changed_columns(old, new) -> DataFrame:
    """Columns that both have and whose chunks, by values and statistics, aren't the same multiset. Chunks are hashed and
    counted first, so that no column's chunks are gathered."""
    what = F.xxhash64(F.struct("num_values", "has_statistics", "null_count", "distinct_count", "min_hex", "max_hex"))
    count = lambda v, sign: v["chunks"].select("path", what.alias("h"), F.lit(sign).alias("s"))
    both = count(old, 1).union(count(new, -1)).groupBy("path", "h").agg(F.sum("s").alias("d"), F.sum(F.when(F.col("s") > 0, 1)).alias("o"), F.sum(F.when(F.col("s") < 0, 1)).alias("n"))
    return both.groupBy("path").agg(F.max(F.col("d") != 0).alias("changed"), F.sum("o").alias("o"), F.sum("n").alias("n")).filter("changed and o > 0 and n > 0").select("path")


def metadata_changes(old, new) -> DataFrame:
    values = lambda v, c: v["kv"].filter("key <> 'ARROW:schema'").groupBy("key").agg(F.array_join(F.array_sort(F.collect_set("value")), " | ").alias(c))
    j = values(old, "old_value").join(values(new, "new_value"), "key", "full_outer")
    change = F.when(F.col("old_value").isNull(), "added").when(F.col("new_value").isNull(), "removed").when(F.col("old_value") != F.col("new_value"), "changed")
    return j.withColumn("change", change).filter("change is not null").select("key", "change", "old_value", "new_value")


def row_groups(old, new) -> DataFrame:
    """One row: how many row groups each has, and whether their multisets differ by rows, bytes and values."""
    one = lambda v, sign: v["row_groups"].select("num_rows", "total_byte_size", F.lit(sign).alias("s"))
    both = one(old, 1).union(one(new, -1)).groupBy("num_rows", "total_byte_size").agg(F.sum("s").alias("d"), F.count(F.when(F.col("s") > 0, 1)).alias("o"), F.count(F.when(F.col("s") < 0, 1)).alias("n"))
    return both.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("old_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("new_count"), F.coalesce(F.max(F.col("d") != 0), F.lit(False)).alias("changed"))


def compression(v) -> DataFrame:
    return v["chunks"].agg(F.array_join(F.array_sort(F.collect_set("compression")), ",").alias("codecs"))


def scan_cost(v) -> DataFrame:
    """Compressed bytes of the chunks; of a file without any, its size."""
    per = v["chunks"].groupBy("file_idx").agg(F.sum(F.greatest("compressed_size", F.lit(0))).alias("c"))
    return v["files"].join(per, "file_idx", "left").agg(F.sum(F.when(F.coalesce("c", F.lit(0)) > 0, F.col("c").cast("decimal(38,0)")).otherwise(F.col("size_bytes"))).cast("bigint").alias("cost"))


def diff(spark: SparkSession, old: list[str], new: list[str]) -> dict:
    """The report of two datasets; small, as it has one entry for each change."""
    scans = scan(spark, old), scan(spark, new)
    a, b = map(views, scans)
    one = lambda df: df.first().asDict()
    rows = lambda df, *by: [r.asDict() for r in df.orderBy(*by).collect()]
    before, after = one(scan_cost(a))["cost"] or 0, one(scan_cost(b))["cost"] or 0
    out = {
        "old": one(summary(a)), "new": one(summary(b)), "schema": one(schema_identity(a, b)) | {"changes": rows(schema_changes(a, b), "name")},
        "columns": [r["path"] for r in rows(changed_columns(a, b), "path")], "metadata": rows(metadata_changes(a, b), "key"),
        "statistics": {"row_groups": one(row_groups(a, b)), "compression": [one(compression(a))["codecs"], one(compression(b))["codecs"]], "scan_cost": [before, after], "scan_cost_percent": 100 * (after - before) / before if before else None},
    }
    s = out["statistics"]
    out["has_changes"] = bool(out["old"] != out["new"] or out["schema"]["identical"] is False or out["schema"]["changes"] or out["columns"] or out["metadata"] or s["row_groups"]["changed"] or s["compression"][0] != s["compression"][1] or before != after)
    for x in scans:
        x.unpersist()
    return out
