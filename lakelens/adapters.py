"""Tables in the shape of metadata views, so that kernels have rows, hits and an SQL oracle at any scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders, lines, part, events = (read(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "events"))
    e = F.expr
    field = e("named_struct('name', p_brand, 'data_type', case p_size % 4 when 0 then 'Timestamp(Second, None)' when 1 then 'Timestamp(Microsecond, Some(\"UTC\"))' else 'Int64' end, 'nullable', p_size % 2 = 0, 'metadata', cast(map() as map<string,string>))")
    meta = e("case when p_size % 5 = 0 then cast(map() as map<string,string>) else map('k', p_type) end")
    files = orders.select(F.col("o_orderkey").cast("int").alias("file_idx"), F.concat(F.lit("f"), "o_orderkey").alias("path"), e("case when o_orderstatus = 'F' then 'duckdb' else 'parquet' end").alias("format"), e("cast(floor(o_totalprice) as decimal(20,0))").alias("size_bytes"), e("cast(floor(o_totalprice) as bigint) % 200").alias("num_rows"))
    typed = part.select(F.col("p_partkey").cast("int").alias("file_idx"), F.concat(F.lit("p"), "p_partkey").alias("path"), F.lit("parquet").alias("format"), F.struct(F.array(field).alias("fields"), meta.alias("metadata")).alias("schema"))
    place = (F.col("l_orderkey").cast("int").alias("file_idx"), F.concat(F.lit("f"), "l_orderkey").alias("file"), F.col("l_linenumber").alias("ordinal"))
    chunks = lines.select(*place, F.lit(0).alias("col_idx"), e("concat('c', l_partkey % 7)").alias("path"), e("case when l_partkey % 17 = 0 then 'INT96' else 'INT64' end").alias("physical_type"), e("case l_returnflag when 'N' then 'UNCOMPRESSED' when 'R' then 'LZ4' else 'ZSTD' end").alias("compression"), e("case when l_partkey % 5 = 0 then array('PLAIN_DICTIONARY', 'RLE') when l_linestatus = 'O' then array('PLAIN', 'BIT_PACKED') else array('RLE_DICTIONARY', 'PLAIN') end").alias("encodings"), e("l_suppkey % 13 <> 0").alias("has_statistics"), e("cast(case when l_suppkey % 11 = 0 then null else l_suppkey % 60 end as decimal(20,0))").alias("null_count"), e("cast(l_partkey % 70 as decimal(20,0))").alias("distinct_count"), e("cast(floor(l_quantity) as bigint)").alias("num_values"), e("cast(floor(l_extendedprice) as bigint) - 20000").alias("compressed_size"), e("cast(floor(l_extendedprice) as bigint)").alias("uncompressed_size"), F.lit(None).cast("string").alias("min_hex"), F.col("l_linestatus").alias("max_hex"))
    groups = lines.select(place[0], F.concat(F.lit("f"), "l_orderkey").alias("path"), F.lit("parquet").alias("format"), place[2], e("cast(floor(l_quantity) as bigint)").alias("num_rows"), e("cast(floor(l_extendedprice) as bigint)").alias("total_byte_size"))
    kv = events.select(F.col("event_id").cast("int").alias("file_idx"), e("concat('k', cast(get_json_object(props, '$.k') as int) % 3)").alias("key"), F.col("event_type").alias("value"))
    logged = events.select(F.col("event_id").cast("int").alias("file_idx"), F.concat(F.lit("e"), "event_id").alias("path"), F.lit("parquet").alias("format"))
    fields = typed.select("file_idx", "path", "format", F.posexplode("schema.fields").alias("pos", "f")).select("file_idx", "path", "format", "pos", "f.name", "f.data_type", "f.nullable")
    return {"files": files, "typed": typed, "fields": fields, "row_groups": groups, "chunks": chunks, "kv": kv, "logged": logged}


def halves(spark: SparkSession, sf_dir: str) -> tuple[dict, dict]:
    """An old and a new side: files with even and with odd numbers."""
    v = table_views(spark, sf_dir)
    out = []
    for side in (0, 1):
        own = F.col("file_idx") % 2 == side
        out.append({"files": v["files"].filter(own).drop("schema"), "chunks": v["chunks"].filter(own), "row_groups": v["row_groups"].filter(own), "kv": v["kv"].filter(own), "fields": v["fields"].withColumn("pos", F.col("file_idx")).filter(own).withColumn("file_idx", F.lit(0))})
    return out[0], out[1]
