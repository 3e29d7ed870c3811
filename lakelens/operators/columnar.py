"""Rules over files, fields, row groups and column chunks, as DataFrame queries.

Kernels take views, never paths: columns file_idx, path (of the file) and what the rule names. Each gives rule_id, severity,
message, file_idx, path, location and seq, a tie-break within the file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .catalogue import BY_ID, Config


def _out(df: DataFrame, rule: str, message, location=None, seq=(), path: str | None = "path", severity: str | None = None) -> DataFrame:
    text = lambda x: F.lit(None).cast("string") if x is None else x if isinstance(x, Column) else F.lit(x)
    order = F.array(*(F.col(s).cast("bigint") for s in seq)) if seq else F.array().cast("array<bigint>")
    return df.select(F.lit(rule).alias("rule_id"), F.lit(severity or BY_ID[rule][3]).alias("severity"), text(message).alias("message"), (F.col("file_idx") if path else F.lit(None)).cast("int").alias("file_idx"), (F.col(path) if path else F.lit(None)).cast("string").alias("path"), text(location).alias("location"), order.alias("seq"))


def _group() -> Column:
    return F.concat(F.lit("row_group="), F.col("ordinal").cast("string"))


def _chunk() -> Column:
    return F.concat(_group(), F.lit(",column="), F.col("path"))


def tiny_row_groups(v, cfg: Config) -> DataFrame:
    g = v["row_groups"].filter((F.col("format") == "parquet") & (F.col("num_rows") > 0) & (F.col("num_rows") < cfg.min_row_group_rows))
    return _out(g, "AL001", F.format_string("row group has %d rows", F.col("num_rows")), _group(), ("ordinal",))


def fingerprint(schema="schema") -> Column:
    return F.array_join(F.transform(F.col(schema)["fields"], lambda f: F.concat_ws(":", f["name"], f["data_type"], f["nullable"].cast("string"))), "|")


def inconsistent_schemas(v, cfg: Config) -> DataFrame:
    """Files whose schema isn't that of the first file that has one."""
    known = v["files"].filter("schema is not null").select("file_idx", "path", fingerprint().alias("fp"), F.array_join(F.transform(F.col("schema")["fields"], lambda f: F.concat_ws(":", f["name"], f["data_type"])), ", ").alias("shown"))
    base = known.agg(F.min_by("fp", "file_idx").alias("base"))
    return _out(known.join(base, known.fp != base.base), "AL003", F.concat(F.lit("schema differs from the first file's: "), "shown"))


def missing_schema_metadata(v, cfg: Config) -> DataFrame:
    f = v["files"].filter(F.col("format").isin("parquet", "arrow_ipc", "feather") & F.col("schema").isNotNull() & (F.coalesce(F.size(F.col("schema")["metadata"]), F.lit(0)) <= 0))
    return _out(f, "AL004", "schema has no metadata")


def nonportable_timestamps(v, cfg: Config) -> DataFrame:
    t = F.col("data_type")
    second, zoned = t.contains("Timestamp(Second"), t.contains("Timestamp(") & t.contains("Some(")
    f = v["fields"].filter(second | zoned)
    return _out(f, "AL005", F.when(second, "timestamp has second resolution").otherwise("timestamp has a time zone"), F.concat(F.lit("field="), "name"), ("pos",))


def mixed_dictionary(v, cfg: Config) -> DataFrame:
    has = F.exists("encodings", lambda e: e.contains("DICTIONARY"))
    c = v["chunks"].select("file_idx", "file", "path", has.alias("d")).groupBy("file_idx", "file", "path").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a <> b")
    return _out(c, "AL006", "dictionary and other encodings are mixed", F.concat(F.lit("column="), "path"), path="file")


def small_files(v, cfg: Config) -> DataFrame:
    f = v["files"].filter(F.col("format").isin("parquet", "arrow_ipc", "feather") & (F.col("size_bytes") > 0) & (F.col("size_bytes") < cfg.small_file_bytes)).agg(F.count("*").alias("n")).filter("n > 1")
    return _out(f, "AL007", F.format_string("%d files are small", F.col("n")), path=None)


def row_counts(v, cfg: Config) -> DataFrame:
    """Sums as decimals, so that a sum beyond 64 bits is a finding and no failure."""
    sums = v["row_groups"].groupBy("file_idx").agg(F.sum(F.col("num_rows").cast("decimal(38,0)")).alias("total"), F.min("num_rows").alias("low"))
    f = v["files"].filter((F.col("format") == "parquet") & F.col("num_rows").isNotNull()).select("file_idx", "path", "num_rows").join(sums, "file_idx", "left").filter("coalesce(low, 0) >= 0").withColumn("total", F.coalesce("total", F.lit(0).cast("decimal(38,0)")))
    over = F.col("total") > (1 << 63) - 1
    return _out(f.filter(over | (F.col("total") != F.col("num_rows"))), "AL013", F.when(over, "row counts of the groups overflow").otherwise(F.format_string("footer has %s rows, row groups %s", F.col("num_rows").cast("string"), F.col("total").cast("string"))))


def _fused(df: DataFrame, checks: list[tuple[str, Column, Column | str]], location: Column, seq: tuple, path: str) -> DataFrame:
    """All row-local checks of a view in one pass: an array of what fired, exploded."""
    fired = F.array(*(F.when(cond, F.struct(F.lit(rule).alias("rule_id"), F.lit(BY_ID[rule][3]).alias("severity"), (m if isinstance(m, Column) else F.lit(m)).alias("message"), F.lit(i).alias("n"))) for i, (rule, cond, m) in enumerate(checks)))
    hit = df.withColumn("x", F.explode(F.filter(fired, lambda x: x.isNotNull())))
    return hit.select("x.rule_id", "x.severity", "x.message", F.col("file_idx").cast("int").alias("file_idx"), F.col(path).alias("path"), location.alias("location"), F.array(*(F.col(s).cast("bigint") for s in seq), F.col("x.n").cast("bigint")).alias("seq"))


def chunk_checks(cfg: Config) -> list[tuple[str, Column, Column | str]]:
    c, n = F.col, F.col("num_values")
    old = F.array_sort(F.array_intersect("encodings", F.array(F.lit("PLAIN_DICTIONARY"), F.lit("BIT_PACKED"))))
    stats = c("has_statistics") & (n >= 0)
    return [
        ("AL002", ~c("has_statistics"), "column chunk has no statistics"),
        ("AL008", c("compression") == "UNCOMPRESSED", "column chunk isn't compressed"),
        ("AL009", c("physical_type") == "INT96", "INT96 is deprecated"),
        ("AL010", F.size(old) > 0, F.concat(F.lit("deprecated encodings: "), F.array_join(old, ", "))),
        ("AL011", c("compression") == "LZ4", "LZ4 framing is deprecated; LZ4_RAW is portable"),
        ("AL012", stats & (c("null_count") > n), "null count is above the number of values"),
        ("AL012", stats & (c("distinct_count") > n), "distinct count is above the number of values"),
        ("AL014", c("has_statistics") & c("null_count").isNull(), "statistics have no null count"),
        ("AL015", n < 0, "num_values is negative"),
        ("AL015", c("compressed_size") < 0, "compressed size is negative"),
        ("AL015", c("uncompressed_size") < 0, "uncompressed size is negative"),
    ]


CHUNK_RULES = ("AL002", "AL008", "AL009", "AL010", "AL011", "AL012", "AL014", "AL015")


def chunk_rules(v, cfg: Config, rules=CHUNK_RULES) -> DataFrame:
    return _fused(v["chunks"], [x for x in chunk_checks(cfg) if x[0] in rules], _chunk(), ("ordinal", "col_idx"), "file")


def negative_sizes(v, cfg: Config) -> DataFrame:
    files = _fused(v["files"].filter(F.col("format") == "parquet"), [("AL015", F.col("num_rows") < 0, "file row count is negative")], F.lit(None).cast("string"), (), "path")
    groups = _fused(v["row_groups"], [("AL015", F.col("num_rows") < 0, "row count is negative"), ("AL015", F.col("total_byte_size") < 0, "total byte size is negative")], _group(), ("ordinal",), "path")
    return files.union(groups)


def extension_format(v, cfg: Config) -> DataFrame:
    return _out(v["files"].filter("format = 'duckdb'"), "AL100", F.concat(F.col("format"), F.lit(" is recognised but not inspected")))


def document_rules(v, cfg: Config) -> DataFrame:
    f = v["findings"]
    return f.select("rule_id", "severity", "message", F.col("file_idx").cast("int").alias("file_idx"), "path", "location", F.array(F.col("seq").cast("bigint")).alias("seq"))


def declared(v, cfg: Config, rule: dict) -> DataFrame | None:
    """A YAML rule: files of the formats it applies to that have a key neither in their own nor in the schema's metadata."""
    key = (rule.get("check") or {}).get("metadata_key")
    if not key:
        return None
    applies = rule.get("applies_to") or []
    f = v["files"].filter(F.col("format").isin(applies)) if applies else v["files"]
    gone = f.join(v["kv"].filter(F.col("key") == key).select("file_idx").distinct(), "file_idx", "left_anti")
    out = gone.select(F.lit(rule["rule"]).alias("rule_id"), F.lit(rule.get("severity", "warning")).alias("severity"), F.lit(rule.get("description") or f"metadata key {key} is missing").alias("message"), F.col("file_idx").cast("int").alias("file_idx"), "path", F.lit(None).cast("string").alias("location"), F.array().cast("array<bigint>").alias("seq"))
    return out


#: Kernels and the rules that they answer for.
KERNELS = [(("AL001",), tiny_row_groups), (CHUNK_RULES, chunk_rules), (("AL003",), inconsistent_schemas), (("AL004",), missing_schema_metadata), (("AL005",), nonportable_timestamps), (("AL006",), mixed_dictionary), (("AL007",), small_files), (("AL013",), row_counts), (("AL015",), negative_sizes), (("AL100",), extension_format), (tuple(r for r in BY_ID if r[:3] in ("AL1", "AL2", "AL3") and r != "AL100") + tuple(f"AL0{n}" for n in range(16, 22)), document_rules)]


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
