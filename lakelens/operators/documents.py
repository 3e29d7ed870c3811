"""Rules over one file's metadata document: GeoParquet, Iceberg, Lance, Vortex and IPC streams.

Each check yields (rule, severity, message, location). They run on the executor that has read the file, as a document is
small and its parts nest without bound; everything across files or rows is a DataFrame query."""

from __future__ import annotations

import re
from collections import Counter

ENCODINGS = ("WKB", "point", "linestring", "polygon", "multipoint", "multilinestring", "multipolygon")
GEOMETRIES = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon", "GeometryCollection")


def integer(obj, key):
    """A JSON integer within 64 bits; anything else counts as missing."""
    v = obj.get(key) if isinstance(obj, dict) else None
    return v if isinstance(v, int) and not isinstance(v, bool) and -(1 << 63) <= v < 1 << 63 else None


def objects(obj, key) -> list[dict]:
    v = obj.get(key)
    return [x for x in v if isinstance(x, dict)] if isinstance(v, list) else []


def repeats(values) -> list:
    return sorted(v for v, n in Counter(values).items() if n > 1)


def number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


# --- GeoParquet -------------------------------------------------------------------------------------------------


def _covering(cover, names) -> str | None:
    if not isinstance(cover, dict):
        return "covering must be an object"
    box = cover.get("bbox")
    if not isinstance(box, dict):
        return "covering must contain a bbox object"
    root = None
    for c in ("xmin", "ymin", "xmax", "ymax"):
        path = box.get(c)
        if not isinstance(path, list):
            return f"covering.bbox has no path for {c}"
        if len(path) != 2 or not isinstance(path[0], str) or not path[0] or path[1] != c:
            return f"covering.bbox.{c} must name a column and {c}"
        if root not in (None, path[0]):
            return "covering paths have more than one root column"
        root = path[0]
    return None if root in names else f"covering root column {root} is absent from the schema"


def _bbox(v) -> bool:
    return isinstance(v, list) and len(v) in (4, 6) and all(map(number, v)) and all(a <= b for a, b in zip(v[: len(v) // 2], v[len(v) // 2 :]))


def geo(error, doc, fields: dict[str, str], physical: dict[str, set[str]]):
    """fields: type by column name; physical: chunks' physical types by column path."""
    if error:
        yield "AL018", "error", error, None
        return
    if not isinstance(doc, dict):
        yield "AL018", "error", "geo metadata isn't an object", None
        return
    version, primary, columns = doc.get("version"), doc.get("primary_column"), doc.get("columns")
    if not isinstance(version, str):
        yield "AL018", "error", "version is missing or no string", None
    elif not re.fullmatch(r"1(\.(0|[1-9][0-9]*)){2}", version):
        yield "AL018", "error", f"unsupported GeoParquet version {version}", None
    if not isinstance(primary, str) or not primary:
        yield "AL018", "error", "primary_column is missing or empty", None
    if not isinstance(columns, dict) or not columns:
        yield "AL018", "error", "columns is missing or empty", None
        return
    if isinstance(primary, str) and primary and primary not in columns:
        yield "AL019", "error", f"primary column {primary} isn't among the columns", None
    minor = re.match(r"[^.]*\.(\d+)", version) if isinstance(version, str) else None
    for name, col in sorted(columns.items()):
        loc = f"column={name}"
        if not isinstance(col, dict):
            yield "AL019", "error", "column metadata isn't an object", loc
            continue
        if not name:
            yield "AL019", "error", "column name is empty", loc
        if name not in fields:
            yield "AL019", "error", f"column {name} is absent from the schema", loc
        enc = col.get("encoding")
        if enc not in ENCODINGS or (enc != "WKB" and not (minor and int(minor[1]) >= 1)):
            yield "AL019", "error", f"unsupported encoding {enc}", loc
        types = col.get("geometry_types")
        if not isinstance(types, list):
            yield "AL019", "error", "geometry_types isn't an array", loc
        else:
            seen = set()
            for t in types:
                if not isinstance(t, str) or t.removesuffix(" Z") not in GEOMETRIES:
                    yield "AL019", "error", f"invalid geometry type {t}", loc
                elif t in seen:
                    yield "AL019", "error", f"duplicate geometry type {t}", loc
                else:
                    seen.add(t)
        if enc == "WKB" and not (physical[name] <= {"BYTE_ARRAY"} if physical.get(name) else fields.get(name) in ("Binary", "LargeBinary")):
            yield "AL019", "error", "WKB column isn't stored as BYTE_ARRAY", loc
        if "crs" in col and col["crs"] is not None and not isinstance(col["crs"], dict):
            yield "AL020", "error", "crs must be an object or null", loc
        if "epoch" in col and not number(col["epoch"]):
            yield "AL020", "error", "epoch must be a number", loc
        if "orientation" in col and col["orientation"] != "counterclockwise":
            yield "AL020", "error", "orientation must be counterclockwise", loc
        if "edges" in col and col["edges"] not in ("planar", "spherical"):
            yield "AL020", "error", "edges must be planar or spherical", loc
        if "bbox" in col and not _bbox(col["bbox"]):
            yield "AL020", "error", "bbox must have 4 or 6 ordered numbers", loc
        if "covering" in col and (e := _covering(col["covering"], fields)):
            yield "AL020", "error", e, loc
        if "bbox" not in col and "covering" not in col:
            yield "AL021", "info", "column has neither bbox nor covering", loc


# --- Iceberg ----------------------------------------------------------------------------------------------------


def schemas(m) -> list[dict]:
    return objects(m, "schemas") or ([m["schema"]] if isinstance(m.get("schema"), dict) else [])


def field_ids(schema):
    """Every field's id in order, None where one is missing; nested structs, lists and maps have theirs."""
    def walk(t):
        if not isinstance(t, dict):
            return
        if t.get("type") == "struct":
            for f in objects(t, "fields"):
                yield integer(f, "id")
                yield from walk(f.get("type"))
        elif t.get("type") == "list":
            yield integer(t, "element-id")
            yield from walk(t.get("element"))
        elif t.get("type") == "map":
            yield integer(t, "key-id")
            yield from walk(t.get("key"))
            yield integer(t, "value-id")
            yield from walk(t.get("value"))

    yield from walk(schema | {"type": "struct"})


def _sources(f, version) -> list | None:
    """A field's source columns; None where they aren't integers."""
    if version >= 3 and "source-ids" in f:
        v = f["source-ids"]
        ok = isinstance(v, list) and v and all(isinstance(x, int) and not isinstance(x, bool) for x in v)
        return v if ok else None
    v = integer(f, "source-id")
    return None if v is None else [v]


def iceberg(m: dict, cfg):
    E = "error"
    version = integer(m, "format-version")
    if version is None:
        yield "AL101", E, "format-version is missing or no integer", None
    elif version not in (1, 2, 3):
        yield "AL101", E, f"unsupported format-version {version}", None
    if version in (1, 2, 3):
        yield from _required(m, version)
        yield from _snapshots(m, version)
    known = [integer(s, "schema-id") for s in objects(m, "schemas")]
    snapshots = [integer(s, "snapshot-id") for s in objects(m, "snapshots")]
    for key, ids, zero in (("current-schema-id", known, False), ("default-spec-id", [integer(s, "spec-id") for s in objects(m, "partition-specs")], False), ("default-sort-order-id", [integer(s, "order-id") for s in objects(m, "sort-orders")], True)):
        v = integer(m, key)
        if v is not None and v not in ids and not (zero and v == 0):
            yield "AL103", E, f"{key} {v} refers to nothing", f"field={key}"
    current = integer(m, "current-snapshot-id")
    current = None if current == -1 else current
    if current is not None and current not in snapshots:
        yield "AL103", E, f"current-snapshot-id {current} refers to nothing", "field=current-snapshot-id"
    refs = m.get("refs")
    if isinstance(refs, dict):
        main = refs.get("main")
        if isinstance(main, dict):
            if integer(main, "snapshot-id") != current:
                yield "AL103", E, "refs.main isn't the current snapshot", "field=refs.main"
        else:
            yield "AL103", E, "refs have no main", "field=refs"
        for name, r in sorted(refs.items()):
            i = integer(r, "snapshot-id")
            if i is None:
                yield "AL103", E, f"reference {name} has no snapshot-id", f"field=refs.{name}"
            elif i not in snapshots:
                yield "AL103", E, f"reference {name} has the unknown snapshot {i}", f"field=refs.{name}"
    for key, name in (("schemas", "schema-id"), ("partition-specs", "spec-id"), ("sort-orders", "order-id"), ("snapshots", "snapshot-id")):
        for v in repeats(i for o in objects(m, key) if (i := integer(o, name)) is not None):
            yield "AL104", E, f"{key} repeat {name} {v}", f"field={key}"
    yield from _fields(m, version if version is not None else 1)
    for key, most in (("snapshots", cfg.iceberg_max_snapshots), ("metadata-log", cfg.iceberg_max_metadata_log_entries)):
        n = len(m[key]) if isinstance(m.get(key), list) else 0
        if most and n > most:
            yield "AL107", "info", f"{key} has {n} entries, more than {most}", f"field={key}"


def _required(m, version):
    def bad(text, key):
        return "AL102", "error", text, f"field={key}"

    location = m.get("location")
    if not isinstance(location, str) or not location:
        yield bad("location is missing or empty", "location")
    if not isinstance(location, str) or not (location.startswith("/") or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:.+", location)):
        yield bad("location isn't absolute", "location")
    least = [("last-updated-ms", 0), ("last-column-id", 0)]
    if version >= 2:
        least.append(("last-sequence-number", 0))
    if version >= 3:
        least.append(("next-row-id", 0))
    for key, low in least:
        v = integer(m, key)
        if v is None or v < low:
            yield bad(f"{key} is missing or negative", key)
    if version == 1:
        if not isinstance(m.get("schema"), dict) and not (objects(m, "schemas") and integer(m, "current-schema-id") is not None):
            yield bad("schema is missing", "schema")
        if not isinstance(m.get("partition-spec"), list) and not (isinstance(m.get("partition-specs"), list) and integer(m, "default-spec-id") is not None):
            yield bad("partition-spec is missing", "partition-spec")
        return
    uid = m.get("table-uuid")
    if not isinstance(uid, str) or not re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", uid):
        yield bad("table-uuid is missing or malformed", "table-uuid")
    for key in ("schemas", "partition-specs"):
        if not objects(m, key):
            yield bad(f"{key} is missing or empty", key)
    if not isinstance(m.get("sort-orders"), list):
        yield bad("sort-orders is missing", "sort-orders")
    for key in ("current-schema-id", "default-spec-id", "last-partition-id", "default-sort-order-id"):
        if integer(m, key) is None:
            yield bad(f"{key} is missing or no integer", key)


def _snapshots(m, version):
    updated, last = integer(m, "last-updated-ms"), integer(m, "last-sequence-number")
    known = {integer(s, "schema-id") for s in objects(m, "schemas")}
    all_ids = {integer(s, "snapshot-id") for s in objects(m, "snapshots")}
    for n, s in enumerate(objects(m, "snapshots")):
        def bad(text, n=n):
            return "AL105", "error", text, f"field=snapshots[{n}]"

        i, ts, seq = integer(s, "snapshot-id"), integer(s, "timestamp-ms"), integer(s, "sequence-number")
        if i is None or i <= 0:
            yield bad("snapshot-id isn't positive")
        if ts is None or ts < 0:
            yield bad("timestamp-ms is missing or negative")
        elif updated is not None and ts > updated:
            yield bad("timestamp-ms is later than last-updated-ms")
        if "manifest-list" in s and "manifests" in s:
            yield bad("snapshot has both manifest-list and manifests")
        if version >= 2:
            if seq is None or seq < 0:
                yield bad("sequence-number is missing or negative")
            elif last is not None and seq > last:
                yield bad("sequence-number is above last-sequence-number")
            if not isinstance(s.get("manifest-list"), str) or not s["manifest-list"]:
                yield bad("manifest-list is missing or empty")
            summary = s.get("summary")
            if not isinstance(summary, dict) or summary.get("operation") not in ("append", "replace", "overwrite", "delete"):
                yield bad("summary has no valid operation")
        if (own := integer(s, "schema-id")) is not None and own not in known:
            yield bad("schema-id refers to nothing")
        if version >= 3:
            for key in ("first-row-id", "added-rows"):
                if (v := integer(s, key)) is None or v < 0:
                    yield bad(f"{key} is missing or negative")
    before, log = None, objects(m, "snapshot-log")
    for n, e in enumerate(log):
        def bad(text, n=n):
            return "AL105", "error", text, f"field=snapshot-log[{n}]"

        ts, i = integer(e, "timestamp-ms"), integer(e, "snapshot-id")
        if ts is None:
            yield bad("timestamp-ms is missing")
            continue
        if before is not None and ts <= before:
            yield bad("timestamps don't increase")
        before = ts
        if updated is not None and ts > updated:
            yield bad("timestamp-ms is later than last-updated-ms")
        if i is None:
            yield bad("snapshot-id is missing")
        elif i not in all_ids:
            yield bad(f"snapshot {i} is unknown")
    current = integer(m, "current-snapshot-id")
    if log and current not in (None, -1) and integer(log[-1], "snapshot-id") != current:
        yield "AL105", "error", "the last entry isn't the current snapshot", "field=snapshot-log"


def _fields(m, version):
    def bad(text, loc):
        return "AL106", "error", text, f"field={loc}"

    highest, every = None, set()
    for n, s in enumerate(schemas(m)):
        ids = list(field_ids(s))
        if None in ids:
            yield bad("schema has a field without id", f"schemas[{n}]")
        ids = [i for i in ids if i is not None]
        for d in repeats(ids):
            yield bad(f"schema repeats field ID {d}", f"schemas[{n}]")
        for i in ids:
            if i <= 0:
                yield bad(f"schema has the non-positive field ID {i}", f"schemas[{n}]")
            highest = i if highest is None else max(highest, i)
            every.add(i)
    last = integer(m, "last-column-id")
    if last is not None and highest is not None and last < highest:
        yield bad(f"last-column-id {last} is below field ID {highest}", "last-column-id")
    top, by_id, by_signature = None, {}, {}
    specs = [(f"partition-specs[{n}]", objects(s, "fields")) for n, s in enumerate(objects(m, "partition-specs"))]
    if not specs and version == 1:
        specs = [("partition-spec", objects(m, "partition-spec"))]
    for loc, fs in specs:
        for d in repeats(i for f in fs if (i := integer(f, "field-id")) is not None):
            yield bad(f"partition spec repeats field ID {d}", loc)
        for f in fs:
            at, i, sources = f"{loc}.fields", integer(f, "field-id"), _sources(f, version)
            if i is not None and i > 0:
                top = i if top is None else max(top, i)
                if version >= 2 and sources is not None and isinstance(f.get("transform"), str):
                    sign = (tuple(sources), f["transform"])
                    if by_id.get(i, sign) != sign:
                        yield bad(f"partition field ID {i} is reused for another field", at)
                    by_id[i] = sign
                    if by_signature.get(sign, i) != i:
                        yield bad(f"equal partition fields have the IDs {by_signature[sign]} and {i}", at)
                    by_signature[sign] = i
            elif version >= 2:
                yield bad("partition field has no positive ID", at)
            if sources is None:
                yield bad("partition field has no valid source", at)
            else:
                for x in sources:
                    if x not in every:
                        yield bad(f"partition field has the unknown source {x}", at)
    last = integer(m, "last-partition-id")
    if last is not None and top is not None and last < top:
        yield bad(f"last-partition-id {last} is below partition field ID {top}", "last-partition-id")
    for n, o in enumerate(objects(m, "sort-orders")):
        for f in objects(o, "fields"):
            at, sources = f"sort-orders[{n}].fields", _sources(f, version)
            if sources is None:
                yield bad("sort field has no valid source", at)
            for x in sources or []:
                if x not in every:
                    yield bad(f"sort field has the unknown source {x}", at)


# --- Lance ------------------------------------------------------------------------------------------------------

DELETIONS, V2_DEPRECATED, TABLE_CONFIG, BASE_PATHS, OVERLAYS, UNKNOWN = 1, 4, 8, 16, 64, 128


def unsafe(path: str) -> bool:
    return not path or path.startswith(("/", "\\")) or "\\" in path or ":" in path.split("/")[0] or any(p in ("", ".", "..") for p in path.split("/"))


def lance(d: dict, cfg, stat):
    """d: errors, named version, number of manifests and the newest manifest; stat(relative path) gives a size or None."""
    E = "error"
    for e in d["errors"]:
        yield "AL201", E, e, None
    m = d["manifest"]
    if m is None:
        return
    if d["named"] != m["version"]:
        yield "AL201", E, f"manifest name says version {d['named']}, its content {m['version']}", None
    if m["version"] == 0:
        yield "AL201", E, "manifest version is 0", None
    seen, highest = set(), None
    for f in m["fragments"]:
        if f["id"] in seen:
            yield "AL202", E, f"fragment ID {f['id']} is repeated", f"fragment={f['id']}"
        seen.add(f["id"])
        highest = f["id"] if highest is None else max(highest, f["id"])
    if m["max_fragment_id"] is not None and highest is not None and m["max_fragment_id"] < highest:
        yield "AL202", E, f"max_fragment_id {m['max_fragment_id']} is below fragment ID {highest}", None
    bases = {b["id"]: b for b in m["bases"]}
    for f in m["fragments"]:
        active, here = set(), f"fragment={f['id']}"
        for x in f["files"]:
            loc = f"{here},data_file={x['path']}"
            if unsafe(x["path"]):
                yield "AL203", E, f"data file path {x['path']!r} is unsafe", loc
            columns = set()
            for i in x["fields"]:
                if i == -1:
                    yield "AL203", E, "data file has field ID -1", loc
                elif i >= 0 and i in active:
                    yield "AL203", E, f"field {i} is already active in the fragment", loc
                active.add(i)
            if x["major"] > 0 and len(x["fields"]) != len(x["columns"]):
                yield "AL203", E, "fields and column indices differ in number", loc
            for c in x["columns"]:
                if c >= 0 and c in columns:
                    yield "AL203", E, f"column index {c} is repeated", loc
                columns.add(c)
        if x := f["deletion"]:
            if x["type"] not in (0, 1):
                yield "AL204", E, f"unknown deletion file type {x['type']}", here
            if x["read_version"] > m["version"]:
                yield "AL204", E, "deletion file was read from a later version", here
            if x["rows"] > f["rows"]:
                yield "AL204", E, f"{x['rows']} of {f['rows']} rows are deleted", here
    for kind in ("reader", "writer"):
        if unknown := m[kind] & ~(UNKNOWN - 1):
            yield "AL205", E, f"unknown {kind} feature flag bits are set: 0x{unknown:x}", None
    if m["writer"] & V2_DEPRECATED:
        yield "AL205", "warning", "deprecated V2-format writer flag is set", None
    if (m["reader"] | m["writer"]) & OVERLAYS or any(f["overlays"] for f in m["fragments"]):
        yield "AL205", "warning", "unstable data overlays are used", None
    if any(f["deletion"] for f in m["fragments"]) and not m["reader"] & m["writer"] & DELETIONS:
        yield "AL205", E, "deletion files without both of their feature flags", None
    if m["config"] and not m["writer"] & TABLE_CONFIG:
        yield "AL205", E, "table config without its writer flag", None
    if m["bases"] and not m["reader"] & m["writer"] & BASE_PATHS:
        yield "AL205", E, "base paths without both of their feature flags", None
    if m["data_format"] == "2.3":
        yield "AL205", "warning", "data format 2.3 is unstable", None
    for i in repeats(b["id"] for b in m["bases"]):
        yield "AL206", E, f"base path ID {i} is repeated", None
    for b in m["bases"]:
        if not b["path"]:
            yield "AL206", E, f"base path {b['id']} is empty", None
    for f in m["fragments"]:
        for x in f["files"]:
            loc = f"fragment={f['id']},data_file={x['path']}"
            if x["base_id"] is not None:
                if x["base_id"] not in bases:
                    yield "AL206", E, f"base path {x['base_id']} is unknown", loc
                continue
            if unsafe(x["path"]):
                continue
            size = stat(f"data/{x['path']}")
            if size is None:
                yield "AL206", E, f"data file {x['path']} is missing", loc
            elif x["size"] > 0 and size != x["size"]:
                yield "AL206", E, f"data file {x['path']} has {size} bytes, not {x['size']}", loc
        if x := f["deletion"]:
            if x["base_id"] is not None:
                if x["base_id"] not in bases:
                    yield "AL206", E, f"base path {x['base_id']} is unknown", f"fragment={f['id']}"
            elif x["type"] in (0, 1):
                name = f"_deletions/{f['id']}-{x['read_version']}-{x['id']}.{'arrow' if x['type'] == 0 else 'bin'}"
                if stat(name) is None:
                    yield "AL206", E, f"deletion file {name} is missing", f"fragment={f['id']}"
    if m["transaction"]:
        if unsafe(m["transaction"]):
            yield "AL206", E, "transaction path is unsafe", None
        elif stat(f"_transactions/{m['transaction']}") is None:
            yield "AL206", E, f"transaction file {m['transaction']} is missing", None
    if cfg.lance_max_versions and d["count"] > cfg.lance_max_versions:
        yield "AL207", "info", f"{d['count']} versions, more than {cfg.lance_max_versions}", None
    small = sum(0 < f["rows"] < cfg.lance_target_fragment_rows for f in m["fragments"])
    if cfg.lance_target_fragment_rows and cfg.lance_small_fragment_count and small >= cfg.lance_small_fragment_count:
        yield "AL207", "info", f"{small} fragments have fewer than {cfg.lance_target_fragment_rows} rows", None
    for f in m["fragments"]:
        if f["deletion"] and f["rows"] and 0 < cfg.lance_deletion_compaction_threshold < f["deletion"]["rows"] / f["rows"]:
            yield "AL207", "info", f"{100 * f['deletion']['rows'] / f['rows']:.1f}% of the rows are deleted", f"fragment={f['id']}"


# --- Vortex -----------------------------------------------------------------------------------------------------


def _segment(s, bound):
    if s["offset"] < 4:
        yield "segment overlaps the leading magic"
    if s["offset"] + s["length"] > bound:
        yield "segment goes beyond its bound"
    if s["exponent"] >= 64:
        yield f"alignment exponent {s['exponent']} is too large"
    elif s["offset"] % (1 << s["exponent"]):
        yield "segment isn't aligned"


def vortex(d: dict):
    E, I = "error", "info"
    for e in d["errors"]:
        yield "AL301", E, e, None
    ps, f = d["postscript"], d["footer"]
    if ps is None:
        return
    for k in ("layout", "footer"):
        if ps[k] is None:
            yield "AL302", E, f"postscript has no {k} segment", None
    for k in ("dtype", "layout", "statistics", "footer"):
        for e in _segment(ps[k], d["start"]) if ps[k] else ():
            yield "AL302", E, f"{k} {e}", None
    if len(ps["metadata"]) > 16:
        yield "AL303", E, f"{len(ps['metadata'])} user metadata entries, more than 16", None
    seen = set()
    for n, e in enumerate(ps["metadata"]):
        key, loc = e["key"], f"metadata={n}"
        if key is None:
            yield "AL303", E, "user metadata key is missing", loc
        elif not key:
            yield "AL303", E, "user metadata key is empty", loc
        elif len(key.encode()) > 64:
            yield "AL303", E, "user metadata key is longer than 64 bytes", loc
        elif key in seen:
            yield "AL303", E, f"user metadata key {key} is repeated", loc
        else:
            seen.add(key)
        if e["segment"] is None:
            yield "AL303", E, "user metadata segment is missing", loc
        for x in _segment(e["segment"], d["size"]) if e["segment"] else ():
            yield "AL303", E, x, loc
    if d["footer_error"]:
        yield "AL304", E, f"footer is no valid FlatBuffer: {d['footer_error']}", None
    if d["footer_skip"] == "size":
        yield "AL304", I, "footer is beyond the inspection limit", None
    if f is not None:
        if f["segments"] is None:
            yield "AL304", E, "footer has no segment registry", None
        before = 0
        for n, s in enumerate(f["segments"] or []):
            if s["offset"] < before:
                yield "AL304", E, "segment offsets don't increase", f"segment={n}"
            before = s["offset"]
            for x in _segment(s, d["start"]):
                yield "AL304", E, x, f"segment={n}"
        for kind in ("array", "layout"):
            known = set()
            for n, i in enumerate(f[f"{kind}s"]):
                loc = f"{kind}_registry={n}"
                if not i:
                    yield "AL305", E, f"{kind} identifier is {'missing' if i is None else 'empty'}", loc
                elif i in known:
                    yield "AL305", E, f"{kind} identifier {i} is repeated", loc
                known.add(i)
    for k in ("dtype", "layout", "statistics", "footer"):
        if ps[k] and (ps[k]["compression"] or 0) > 3:
            yield "AL306", E, f"{k} segment has the unknown compression scheme {ps[k]['compression']}", None
    if d["footer_skip"] == "opaque":
        yield "AL306", I, "footer is compressed or encrypted and wasn't inspected", None
    if f is not None:
        if len(f["schemes"]) > 8:
            yield "AL306", E, f"{len(f['schemes'])} compression schemes, more than 8", None
        for n, c in enumerate(f["schemes"]):
            if c > 3:
                yield "AL306", E, f"unknown compression scheme {c}", f"compression_registry={n}"
    for k in ("dtype", "statistics"):
        if ps[k] is None:
            yield "AL307", I, f"file has no {k} segment", None


def stream(kind: str | None, errors: list[str], legacy: bool):
    if kind == "stream":
        for e in errors:
            yield "AL016", "error", e, None
        if legacy:
            yield "AL017", "warning", "stream has legacy framing without continuation markers", None
