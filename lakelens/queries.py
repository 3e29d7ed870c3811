"""A query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .adapters import halves, read, table_views
from .operators import columnar, samples
from .operators.catalogue import BY_ID, Config
from .plans import diff as d
from .plans.engine import lint

#: Thresholds for tables, whose numbers are smaller than those of files.
TABLE = Config(min_row_group_rows=20, small_file_bytes=100_000)
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _named(rule: str) -> str:
    return f"{rule.lower()}_{BY_ID[rule][1].replace('-', '_')}"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over the footers of a folder."""
    return lint(spark, [sf_dir])


# --- real footers -----------------------------------------------------------------------------------------------


def _footer(rule: str):
    def query(spark, sf_dir):
        got = lint(spark, [sf_dir], only=[rule])
        return got.select("rule_id", F.element_at(F.split("path", "/"), -1).alias("file"), "location")

    query.__doc__ = f"{rule} over the footers of a folder."
    return query


for _rule in ("AL001", "AL002", "AL003", "AL004", "AL005", "AL006", "AL007", "AL008", "AL009", "AL010", "AL011", "AL012", "AL013", "AL014", "AL015", "AL100"):
    add(_named(_rule), _footer(_rule))

#: The footers of the correctness run, as DuckDB reads them.
FOLDER = "/root/testdata/sf0.01/*.parquet"
META = f"(select regexp_extract(file_name, '[^/]*$') as file, row_group_id g, row_group_num_rows n, path_in_schema p, compression, type, stats_null_count nulls, stats_distinct_count dist, num_values vals, encodings enc, total_compressed_size packed, total_uncompressed_size size, row_group_bytes bytes, coalesce(stats_min, stats_max, stats_min_value, stats_max_value, stats_null_count::varchar) is not null has from parquet_metadata('{FOLDER}'))"
FILE = f"(select regexp_extract(file_name, '[^/]*$') as file, num_rows, file_size_bytes bytes from parquet_file_metadata('{FOLDER}'))"
LEAVES = f"(select regexp_extract(file_name, '[^/]*$') as file, string_agg(concat_ws(':', name, type, repetition_type, logical_type, converted_type), '|' order by column_id) shape from parquet_schema('{FOLDER}') where repetition_type is not null group by 1)"
CHUNKS_HIT = {
    "AL002": "not has", "AL008": "compression = 'UNCOMPRESSED'", "AL009": "type = 'INT96'", "AL010": "enc like '%PLAIN_DICTIONARY%' or enc like '%BIT_PACKED%'", "AL011": "compression = 'LZ4'",
    "AL012": "has and (nulls > vals or dist > vals)", "AL014": "has and nulls is null", "AL015": "vals < 0 or packed < 0 or size < 0",
}
HITS = {r: f"select distinct '{r}' rule_id, file, concat('row_group=', g, ',column=', p) as location from {META} where {w}" for r, w in CHUNKS_HIT.items()}
HITS |= {
    "AL001": f"select distinct 'AL001' rule_id, file, concat('row_group=', g) as location from {META} where n > 0 and n < 100000",
    "AL003": f"select 'AL003' rule_id, file, null::varchar as location from {LEAVES} where shape <> (select shape from {LEAVES} order by file limit 1)",
    "AL004": f"select 'AL004' rule_id, file, null::varchar as location from {FILE} where file not in (select regexp_extract(file_name, '[^/]*$') from parquet_kv_metadata('{FOLDER}') where key::varchar <> 'ARROW:schema')",
    "AL005": f"select 'AL005' rule_id, regexp_extract(file_name, '[^/]*$') as file, concat('field=', name) as location from parquet_schema('{FOLDER}') where logical_type like 'TimestampType(isAdjustedToUTC=1%'",
    "AL006": f"select 'AL006' rule_id, file, concat('column=', p) as location from {META} group by file, p having min(enc like '%DICTIONARY%') <> max(enc like '%DICTIONARY%')",
    "AL007": f"select 'AL007' rule_id, null::varchar as file, null::varchar as location from {FILE} where bytes > 0 and bytes < 67108864 having count(*) > 1",
    "AL013": f"select 'AL013' rule_id, f.file, null::varchar as location from {FILE} f left join (select file, sum(n) n from (select distinct file, g, n from {META}) group by file) m using (file) where coalesce(m.n, 0) <> f.num_rows",
    "AL100": f"select 'AL100' rule_id, regexp_extract(file, '[^/]*$') as file, null::varchar as location from glob('{FOLDER.replace('*.parquet', '*.duckdb')}')",
}
HITS["AL015"] += f" union all select 'AL015', file, concat('row_group=', g) from (select distinct file, g, n, bytes from {META}) where n < 0 or bytes < 0 union all select 'AL015', file, null from {FILE} where num_rows < 0"
for _rule, _sql in HITS.items():
    ORACLE[_named(_rule)] = _sql
add("lint_all", lambda spark, sf_dir: flagship(spark, sf_dir).select("rule_id", "severity", F.element_at(F.split("path", "/"), -1).alias("file"), "location"), "select rule_id, case rule_id " + " ".join(f"when '{r}' then '{BY_ID[r][3]}'" for r in HITS) + " end severity, file, location from (" + " union all ".join(HITS[r] for r in sorted(HITS)) + ")")

# --- tables in the shape of views -------------------------------------------------------------------------------

ENC = "case when l_partkey % 5 = 0 then ['PLAIN_DICTIONARY','RLE'] when l_linestatus = 'O' then ['PLAIN','BIT_PACKED'] else ['RLE_DICTIONARY','PLAIN'] end"
CHUNK = f"select l_orderkey file_idx, l_linenumber ordinal, concat('c', l_partkey % 7) path, case l_returnflag when 'N' then 'UNCOMPRESSED' when 'R' then 'LZ4' else 'ZSTD' end codec, {ENC} encodings, l_suppkey % 13 <> 0 has, case when l_suppkey % 11 = 0 then null else l_suppkey % 60 end nulls, l_partkey % 70 dist, cast(floor(l_quantity) as bigint) n, cast(floor(l_extendedprice) as bigint) - 20000 packed, cast(floor(l_extendedprice) as bigint) size, case when l_partkey % 17 = 0 then 'INT96' else 'INT64' end phys from lineitem"
SHOWN = "select '{0}' rule_id, cast(file_idx as integer) file_idx, concat('row_group=', ordinal, ',column=', path) as location from ({1}) c where {2}"


def _chunks(rule):
    return lambda spark, sf_dir: columnar.chunk_rules(table_views(spark, sf_dir), TABLE, [rule]).select("rule_id", "file_idx", "location")


for _rule, _where in {"AL002": "not has", "AL008": "codec = 'UNCOMPRESSED'", "AL009": "phys = 'INT96'", "AL010": "list_contains(encodings, 'PLAIN_DICTIONARY') or list_contains(encodings, 'BIT_PACKED')", "AL011": "codec = 'LZ4'", "AL014": "has and nulls is null"}.items():
    add(f"{_named(_rule)}_tbl", _chunks(_rule), SHOWN.format(_rule, CHUNK, _where))
for _rule, _wheres in {"AL012": ("has and n >= 0 and nulls > n", "has and n >= 0 and dist > n"), "AL015": ("packed < 0",)}.items():
    add(f"{_named(_rule)}_tbl", _chunks(_rule), " union all ".join(SHOWN.format(_rule, CHUNK, w) for w in _wheres))
add("chunk_rules_fused_tbl", lambda spark, sf_dir: columnar.chunk_rules(table_views(spark, sf_dir), TABLE).groupBy("rule_id").agg(F.count("*").alias("n")), "select rule_id, count(*) n from (" + " union all ".join(v for k, v in ORACLE.items() if k.endswith("_tbl")) + ") group by 1")


def _kernel(kernel, *columns, views=()):
    return lambda spark, sf_dir: kernel((v := table_views(spark, sf_dir)) | {a: v[b] for a, b in views}, TABLE).select("rule_id", *columns)


FILES = "select cast(o_orderkey as integer) file_idx, case when o_orderstatus = 'F' then 'duckdb' else 'parquet' end format, cast(floor(o_totalprice) as bigint) size, cast(floor(o_totalprice) as bigint) % 200 n from orders"
PARTS = "select cast(p_partkey as integer) file_idx, p_brand as name, case p_size % 4 when 0 then 'Timestamp(Second, None)' when 1 then 'Timestamp(Microsecond, Some(\"UTC\"))' else 'Int64' end t, p_size % 2 = 0 nullable, p_size % 5 = 0 bare from part"
add("al001_tiny_row_groups_tbl", _kernel(columnar.tiny_row_groups, "file_idx", "location"), "select 'AL001' rule_id, cast(l_orderkey as integer) file_idx, concat('row_group=', l_linenumber) as location from lineitem where floor(l_quantity) > 0 and floor(l_quantity) < 20")
add("al003_inconsistent_schemas_tbl", _kernel(columnar.inconsistent_schemas, "file_idx", views=[("files", "typed")]), f"with p as ({PARTS}), b as (select name, t, nullable from p order by file_idx limit 1) select 'AL003' rule_id, p.file_idx from p, b where (p.name, p.t, p.nullable) <> (b.name, b.t, b.nullable)")
add("al004_missing_schema_metadata_tbl", _kernel(columnar.missing_schema_metadata, "file_idx", views=[("files", "typed")]), f"select 'AL004' rule_id, file_idx from ({PARTS}) where bare")
add("al005_non_portable_timestamps_tbl", _kernel(columnar.nonportable_timestamps, "file_idx", "message", "location"), f"select 'AL005' rule_id, file_idx, case when t like '%Second, %' and t like 'Timestamp(Second%' then 'timestamp has second resolution' else 'timestamp has a time zone' end message, concat('field=', name) as location from ({PARTS}) where t like 'Timestamp(%'")
add("al006_mixed_dictionary_encodings_tbl", _kernel(columnar.mixed_dictionary, "file_idx", "location"), f"select 'AL006' rule_id, cast(file_idx as integer) file_idx, concat('column=', path) as location from ({CHUNK}) group by file_idx, path having min(list_has_any(encodings, ['PLAIN_DICTIONARY','RLE_DICTIONARY'])) <> max(list_has_any(encodings, ['PLAIN_DICTIONARY','RLE_DICTIONARY']))")
add("al007_small_files_tbl", _kernel(columnar.small_files, "message"), f"select 'AL007' rule_id, concat(count(*), ' files are small') message from ({FILES}) where format = 'parquet' and size > 0 and size < 100000 having count(*) > 1")
add("al013_row_count_mismatch_tbl", _kernel(columnar.row_counts, "file_idx"), f"select 'AL013' rule_id, f.file_idx from ({FILES}) f left join (select l_orderkey k, sum(floor(l_quantity)) total from lineitem group by 1) g on g.k = f.file_idx where f.format = 'parquet' and coalesce(g.total, 0) <> f.n")
add("al100_recognized_extension_format_tbl", _kernel(columnar.extension_format, "file_idx"), f"select 'AL100' rule_id, file_idx from ({FILES}) where format = 'duckdb'")
add("declarative_rule_tbl", lambda spark, sf_dir: columnar.declared((v := table_views(spark, sf_dir)) | {"files": v["logged"]}, TABLE, {"rule": "ORG001", "severity": "error", "check": {"metadata_key": "k1"}, "applies_to": ["parquet"]}).select("rule_id", "file_idx", "severity"), "select 'ORG001' rule_id, cast(event_id as integer) file_idx, 'error' severity from events where cast(json_extract_string(props, '$.k') as integer) % 3 <> 1")

# --- documents --------------------------------------------------------------------------------------------------


def _documents(rule: str):
    def query(spark, sf_dir):
        line = F.struct(F.col("l_linenumber").cast("long").alias("n"), F.col("l_partkey").cast("long").alias("p"), F.col("l_suppkey").cast("long").alias("s"), F.floor("l_quantity").cast("long").alias("q"))
        orders = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("order_key")).agg(F.array_sort(F.collect_list(line)).alias("lines"))

        def run(batches):
            for b in batches:
                got = [(k, n) for k, lines in zip(*(x.to_pylist() for x in b.columns)) if (n := samples.fired(rule, k, lines))]
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], names=["order_key", "n"])

        return orders.mapInArrow(run, "order_key long, n long")

    query.__doc__ = f"How often {rule} fires in the document of each order (see samples.py)."
    return query


for _rule in samples.EXPECTED:
    add(f"{_named(_rule)}_documents", _documents(_rule), samples.expected_sql(_rule))

# --- comparison -------------------------------------------------------------------------------------------------

SIDE = "select *, file_idx % 2 side from ({0})"
add("diff_summary_tbl", lambda spark, sf_dir: d.summary(halves(spark, sf_dir)[0]), f"select string_agg(distinct format, ',' order by format) formats, count(*) file_count, cast(sum(n) as bigint) num_rows, cast(sum(size) as bigint) size_bytes from ({FILES}) where file_idx % 2 = 0")
_first = "select name, arg_max(t, file_idx) t, arg_max(nullable, file_idx) nullable from (" + PARTS + ") where file_idx % 2 = {0} group by name"
add("diff_schema_tbl", lambda spark, sf_dir: d.schema_changes(*halves(spark, sf_dir)), f"select coalesce(a.name, b.name) as name, case when a.name is null then 'added' when b.name is null then 'removed' else 'changed' end as change, a.t old_type, b.t new_type from ({_first.format(0)}) a full join ({_first.format(1)}) b on a.name = b.name where a.name is null or b.name is null or (a.t, a.nullable) <> (b.t, b.nullable)")
_cols = f"select path, n, has, nulls, dist, st, sum(case when side = 0 then 1 else -1 end) d, sum(1 - side) o, sum(side) w from (select c.*, file_idx % 2 side from ({CHUNK.replace(' phys from', ' phys, l_linestatus st from')}) c) group by all"
add("diff_columns_tbl", lambda spark, sf_dir: d.changed_columns(*halves(spark, sf_dir)), f"select path from ({_cols}) group by path having bool_or(d <> 0) and sum(o) > 0 and sum(w) > 0")
_kv = "select concat('k', cast(json_extract_string(props, '$.k') as integer) % 3) as key, string_agg(distinct event_type, ' | ' order by event_type) v from events where event_id % 2 = {0} group by 1"
add("diff_metadata_tbl", lambda spark, sf_dir: d.metadata_changes(*halves(spark, sf_dir)), f"select coalesce(a.key, b.key) as key, case when a.key is null then 'added' when b.key is null then 'removed' else 'changed' end as change, a.v old_value, b.v new_value from ({_kv.format(0)}) a full join ({_kv.format(1)}) b on a.key = b.key where a.v is distinct from b.v")
add("diff_row_groups_tbl", lambda spark, sf_dir: d.row_groups(*halves(spark, sf_dir)), "select cast(sum(o) as bigint) old_count, cast(sum(w) as bigint) new_count, bool_or(o <> w) changed from (select floor(l_quantity) a, floor(l_extendedprice) b, sum(case when l_orderkey % 2 = 0 then 1 else 0 end) o, sum(l_orderkey % 2) w from lineitem group by 1, 2)")
add("diff_compression_tbl", lambda spark, sf_dir: d.compression(halves(spark, sf_dir)[1]), f"select string_agg(distinct codec, ',' order by codec) codecs from ({CHUNK}) where file_idx % 2 = 1")
add("diff_scan_cost_tbl", lambda spark, sf_dir: d.scan_cost(halves(spark, sf_dir)[0]), f"select cast(sum(case when coalesce(c, 0) > 0 then c else size end) as bigint) as cost from ({FILES}) f left join (select file_idx k, sum(greatest(packed, 0)) c from ({CHUNK}) group by 1) g on g.k = f.file_idx where f.file_idx % 2 = 0")


def _sides(view: str):
    def sides(spark, sf_dir):
        v = table_views(spark, sf_dir)[view]
        return [{"files": v.filter(F.col("file_idx") % 2 == n)} for n in (0, 1)]

    return sides


add("diff_schema_identity_tbl", lambda spark, sf_dir: d.schema_identity(*_sides("typed")(spark, sf_dir)), f"with x as (select file_idx % 2 side, list_sort(list(distinct concat_ws(':', name, t, nullable))) prints, arg_min(name, file_idx) as first from ({PARTS}) group by 1) select a.prints = b.prints as identical, a.first <> b.first as order_changed from x a, x b where a.side = 0 and b.side = 1")


def _negative(spark, sf_dir):
    v = table_views(spark, sf_dir)
    less = lambda df, c, n: df.withColumn(c, F.col(c) - n)
    shifted = {"files": less(v["files"], "num_rows", 20), "row_groups": less(less(v["row_groups"], "num_rows", 5), "total_byte_size", 20_000)}
    return columnar.negative_sizes(shifted, TABLE).select("rule_id", "file_idx", "message", "location")


add("al015_negative_sizes_tbl", _negative, f"select 'AL015' rule_id, file_idx, 'file row count is negative' message, null::varchar as location from ({FILES}) where format = 'parquet' and n < 20 union all select 'AL015', l_orderkey::int, 'row count is negative', concat('row_group=', l_linenumber) from lineitem where floor(l_quantity) < 5 union all select 'AL015', l_orderkey::int, 'total byte size is negative', concat('row_group=', l_linenumber) from lineitem where floor(l_extendedprice) < 20000")

PAIRS = (("documents", "documents"), ("documents", "pages"), ("orders", "lineitem"), ("region", "region"))


def _changes(spark, sf_dir):
    got = [(a, b, (r := d.diff(spark, [f"{sf_dir}/{a}.parquet"], [f"{sf_dir}/{b}.parquet"]))["has_changes"], r["old"]["num_rows"], r["new"]["num_rows"], len(r["schema"]["changes"])) for a, b in PAIRS]
    return spark.createDataFrame(got, "old string, new string, has_changes boolean, old_rows long, new_rows long, schema_changes long")


_shape = f"(select regexp_extract(file_name, '([^/]*).parquet$', 1) as file, name, concat_ws(':', type, repetition_type, logical_type) t from parquet_schema('{FOLDER}') where repetition_type is not null)"
_pairs = f"(values {', '.join(map(str, PAIRS))}) x(a, b)"
add("diff_has_changes", _changes, f"with f as (select replace(file, '.parquet', '') as file, num_rows, bytes from {FILE}), c as (select x.a, x.b, (select count(*) from (select name, t from {_shape} s where s.file = x.a) p full join (select name, t from {_shape} s where s.file = x.b) q on p.name = q.name where p.t is distinct from q.t) n from {_pairs}) select c.a as old, c.b as new, n > 0 or (p.num_rows, p.bytes) <> (q.num_rows, q.bytes) as has_changes, p.num_rows as old_rows, q.num_rows as new_rows, n as schema_changes from c join f p on p.file = c.a join f q on q.file = c.b")
