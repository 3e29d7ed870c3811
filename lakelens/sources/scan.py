"""From paths to one row of metadata per file, read on the executors."""

from __future__ import annotations

import gzip
import io
import json
import os
import re
import urllib.request
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import documents
from ..operators.catalogue import Config
from . import decode

SCHEMA = """path string, format string, size_bytes decimal(20,0), num_rows bigint,
schema struct<fields:array<struct<name:string,data_type:string,nullable:boolean,metadata:map<string,string>>>,metadata:map<string,string>>,
metadata map<string,string>,
row_groups array<struct<ordinal:int,num_rows:bigint,total_byte_size:bigint,columns:array<struct<path:string,physical_type:string,compression:string,encodings:array<string>,has_statistics:boolean,null_count:decimal(20,0),distinct_count:decimal(20,0),min_hex:string,max_hex:string,num_values:bigint,uncompressed_size:bigint,compressed_size:bigint>>>>,
findings array<struct<rule_id:string,severity:string,message:string,location:string>>, scan_error string"""
#: Suffixes of each format, in order of precedence (fixed values).
SUFFIXES = [("parquet", (".parquet",)), ("feather", (".feather",)), ("arrow_ipc", (".arrow", ".arrows", ".ipc")), ("iceberg", (".metadata.json", ".metadata.json.gz")), ("lance", (".lance", ".lance/")), ("vortex", (".vortex", ".vx")), ("duckdb", (".duckdb", ".db"))]


class InputError(ValueError):
    """Nothing to read, or a file that can't be read."""


def format_of(path: str) -> str:
    p = re.split(r"[?#]", path.lower())[0]
    return next((f for f, ends in SUFFIXES if p.endswith(ends)), "unknown")


def expand(paths: list[str], cfg: Config) -> list[str]:
    """Files under local paths, Lance datasets as their roots, URLs as they are; sorted by path component, without repeats."""
    out = set()
    for p in paths:
        if "://" in p:
            out.add(p)
            continue
        parts = p.split(os.sep)
        root = next((os.sep.join(parts[: i + 1]) for i in range(len(parts) - 1, -1, -1) if parts[i].lower().endswith(".lance")), None)
        if not os.path.exists(p):
            raise InputError(f"no such path: {p}")
        if root and os.path.isdir(root):
            out.add(root)
        elif os.path.isfile(p):
            out.add(p)
        else:
            for d, dirs, files in os.walk(p, followlinks=cfg.follow_links):
                out |= {os.path.join(d, x) for x in dirs if x.lower().endswith(".lance")}
                dirs[:] = [x for x in dirs if not x.lower().endswith(".lance")] if cfg.recursive else []
                out |= {os.path.join(d, x) for x in files}
    return sorted(out, key=lambda p: p.split("/"))


def stored(path: str) -> bool:
    """Whether a path is in a store that Spark's file systems read: any scheme but HTTP(S)."""
    return "://" in path and not path.startswith(("http://", "https://"))


def listed(spark: SparkSession, paths: list[str], cfg: Config) -> list[str]:
    """Files of known formats below URIs such as s3a://, gs://, abfss://, hdfs:// or file://, as Spark lists them."""
    out = set()
    for p in paths:
        got = spark.read.format("binaryFile").option("recursiveFileLookup", cfg.recursive).load(p).select("path")
        out |= {r.path for r in got.toLocalIterator() if format_of(r.path) not in ("unknown", "lance") and ".lance/" not in r.path.lower()}
    return sorted(out, key=lambda p: p.split("/"))


def _reader(path: str, data: bytes | None = None):
    if data is not None:
        return (lambda o, n: data[o : o + n]), len(data)
    if path.startswith(("http://", "https://")):
        with urllib.request.urlopen(path, timeout=30) as r:
            data = r.read()
        return (lambda o, n: data[o : o + n]), len(data)
    size = os.path.getsize(path)

    def read(offset, n):
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(n)

    return read, size


def _parquet(path, read, size, cfg):
    import pyarrow.parquet as pq

    foot = decode.parquet_footer(read, size)
    try:
        schema = pq.read_schema(path) if "://" not in path else pq.read_schema(pa.BufferReader(read(0, size)))
    except (pa.ArrowException, OSError):  # a footer that only the raw decoder takes; its own column paths stand in
        schema = None
    model = decode.arrow_schema(schema) if schema is not None else None
    geos = [v for k, v in foot["kv"] if k == "geo"]
    found = []
    if geos:
        error = doc = None
        if len(geos) > 1:
            error = "more than one geo entry"
        elif geos[0] is None:
            error = "geo entry has no value"
        else:
            try:
                doc = json.loads(geos[0])
            except ValueError as e:
                error = f"geo metadata isn't valid JSON: {e}"
        physical: dict = {}
        for g in foot["row_groups"]:
            for c in g["columns"]:
                physical.setdefault(c["path"], set()).add(c["physical_type"])
        found = list(documents.geo(error, doc, {f["name"]: f["data_type"] for f in model["fields"]} if model else {}, physical))
    return {"num_rows": foot["num_rows"], "schema": model, "metadata": {k: v for k, v in foot["kv"] if v is not None}, "row_groups": foot["row_groups"], "findings": found}


def _ipc(path, read, size, fmt):
    data = read(0, size)
    try:
        with pa.ipc.open_file(io.BytesIO(data)) as r:
            return {"num_rows": sum(r.get_batch(i).num_rows for i in range(r.num_record_batches)), "schema": decode.arrow_schema(r.schema), "metadata": {"arrow.ipc_kind": "file"}, "findings": []}
    except (pa.ArrowException, OSError):
        pass
    got = decode.ipc_stream(data)
    rows = schema = None
    if not got["errors"]:
        try:
            with pa.ipc.open_stream(io.BytesIO(data)) as r:
                schema = decode.arrow_schema(r.schema)
                rows = sum(b.num_rows for b in r)
        except (pa.ArrowException, OSError) as e:
            got["errors"].append(f"stream can't be decoded: {e}")
            rows = None
    found = list(documents.stream("stream", got["errors"], got["legacy"])) if fmt == "arrow_ipc" else []
    return {"num_rows": rows, "schema": schema, "metadata": {"arrow.ipc_kind": "stream", "arrow.ipc_messages": str(got["messages"])}, "findings": found}


def _lance(path, cfg):
    out = {"errors": [], "named": None, "count": 0, "manifest": None}
    folder, named, size = os.path.join(path, "_versions"), [], 0
    if not os.path.isdir(folder):
        out["errors"].append("dataset has no _versions folder")
    else:
        for name in sorted(os.listdir(folder)):
            if not name.endswith(".manifest") or name.startswith("d"):
                continue
            stem = name.removesuffix(".manifest")
            if not stem.isdigit() or int(stem) >= 1 << 64:
                out["errors"].append(f"manifest name {name} is no version")
                continue
            named.append((((1 << 64) - 1 - int(stem)) if len(stem) == 20 else int(stem), len(stem) == 20, name))
        if len({v2 for _, v2, _ in named}) > 1:
            out["errors"].append("manifest names follow two schemes")
        if not named:
            out["errors"].append("no manifest is attached")
    out["count"] = len(named)
    if named:
        out["named"], _, name = max(named)
        with open(os.path.join(folder, name), "rb") as f:
            data = f.read()
        size = len(data)
        try:
            out["manifest"] = decode.lance_manifest(data)
        except (decode.Bad, UnicodeDecodeError) as e:
            out["errors"].append(f"manifest can't be decoded: {e}")
    stat = lambda rel: os.path.getsize(p) if os.path.isfile(p := os.path.join(path, rel)) else None
    m = out["manifest"]
    rows = None
    if m is not None:
        rows = sum(max(f["rows"] - (f["deletion"]["rows"] if f["deletion"] else 0), 0) for f in m["fragments"])
        rows = rows if rows < 1 << 63 else None
    meta = {"lance.version": str(m["version"]), "lance.fragments": str(len(m["fragments"])), "lance.data_format": m["data_format"] or ""} if m else {}
    return size, {"num_rows": rows, "metadata": meta, "findings": list(documents.lance(out, cfg, stat))}


def inspect(path: str, cfg: Config, data: bytes | None = None) -> dict | None:
    """One file's metadata; None for a format that isn't known. What can't be read has a scan_error. data: the file's bytes,
    where Spark has read them."""
    fmt = format_of(path)
    if fmt == "unknown":
        return None
    base = {"path": path, "format": fmt, "num_rows": None, "schema": None, "metadata": {}, "row_groups": [], "findings": [], "scan_error": None}
    try:
        if fmt == "lance":
            if "://" in path:
                raise InputError("remote Lance datasets aren't supported")
            size, got = _lance(path, cfg)
        else:
            read, size = _reader(path, data)
            if fmt == "parquet":
                got = _parquet(path, read, size, cfg)
            elif fmt in ("arrow_ipc", "feather"):
                got = _ipc(path, read, size, fmt)
            elif fmt == "iceberg":
                data = read(0, size)
                low = re.split(r"[?#]", path.lower())[0]
                doc = json.loads(gzip.decompress(data) if low.endswith((".gz.metadata.json", ".metadata.json.gz")) else data)
                if not isinstance(doc, dict):
                    raise InputError("table metadata isn't an object")
                got = {"metadata": {"iceberg.format_version": str(doc.get("format-version"))}, "findings": list(documents.iceberg(doc, cfg))}
            elif fmt == "vortex":
                got = {"findings": list(documents.vortex(decode.vortex(read, size)))}
            else:
                got = {}
    except (ValueError, OSError) as e:
        size, got = 0, {"scan_error": f"{type(e).__name__}: {e}"}
    got["findings"] = [dict(zip(("rule_id", "severity", "message", "location"), f)) for f in got.get("findings", [])]
    return base | {"size_bytes": size} | got


def scan(spark: SparkSession, paths: list[str], cfg: Config | None = None) -> DataFrame:
    """A row for each known file, with file_idx in order of path components. The first file that can't be read is an error.
    Files in stores are read whole, by Spark; of local ones, only the metadata."""
    cfg = cfg or Config()
    local = [p for p in expand([p for p in paths if not stored(p)], cfg) if format_of(p) != "unknown"]
    remote = listed(spark, [p for p in paths if stored(p)], cfg)
    found = list(enumerate(sorted([*local, *remote], key=lambda p: p.split("/"))))
    if not found:
        raise InputError("no supported inputs found")
    place = spark.createDataFrame(found, "file_idx int, path string")

    def run(batches):
        for b in batches:
            data = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            docs = [json.dumps(inspect(p, cfg, x)) for p, x in zip(b.column(1).to_pylist(), data)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(docs, pa.string())], names=["file_idx", "doc"])

    parts = []
    if local:
        n = min(len(local), max(1, spark.sparkContext.defaultParallelism * 4))
        own = set(local)
        parts.append(spark.createDataFrame([f for f in found if f[1] in own], place.schema).repartition(n).mapInArrow(run, "file_idx int, doc string"))
    if remote:
        read = spark.read.format("binaryFile").load(remote).select("path", "content")
        parts.append(read.join(place, "path").select("file_idx", "path", "content").mapInArrow(run, "file_idx int, doc string"))
    got = reduce(DataFrame.union, parts).select("file_idx", F.from_json("doc", SCHEMA).alias("d")).select("file_idx", "d.*").persist()
    failed = got.filter("scan_error is not null").orderBy("file_idx").limit(1).collect()
    if failed:
        raise InputError(f"{failed[0].path}: {failed[0].scan_error}")
    return got


def views(got: DataFrame) -> dict[str, DataFrame]:
    """files, fields, row_groups, chunks, kv and findings of a scan."""
    files = got.select("file_idx", "path", "format", "size_bytes", "num_rows", "schema", "metadata")
    groups = got.select("file_idx", "path", "format", F.explode("row_groups").alias("g"))
    return {
        "files": files,
        "fields": files.select("file_idx", "path", "format", F.posexplode("schema.fields").alias("pos", "f")).select("file_idx", "path", "format", "pos", "f.name", "f.data_type", "f.nullable"),
        "row_groups": groups.select("file_idx", "path", "format", "g.ordinal", "g.num_rows", "g.total_byte_size"),
        "chunks": groups.select("file_idx", "path", "g.ordinal", F.posexplode("g.columns").alias("col_idx", "c")).select("file_idx", F.col("path").alias("file"), "ordinal", "col_idx", "c.*"),
        "kv": files.select("file_idx", F.explode("metadata").alias("key", "value")).union(files.select("file_idx", F.explode("schema.metadata").alias("key", "value"))),
        "findings": got.select("file_idx", "path", F.posexplode("findings").alias("seq", "x")).select("file_idx", "path", "seq", "x.*"),
    }
