"""Byte-level readers of container metadata: Parquet footers, Arrow IPC streams, Lance manifests, Vortex files."""

from __future__ import annotations

import struct

# Parquet's enumerations, by number (fixed values of the format)
TYPES = ("BOOLEAN", "INT32", "INT64", "INT96", "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY")
CODECS = ("UNCOMPRESSED", "SNAPPY", "GZIP", "LZO", "BROTLI", "LZ4", "ZSTD", "LZ4_RAW")
ENCODINGS = {0: "PLAIN", 2: "PLAIN_DICTIONARY", 3: "RLE", 4: "BIT_PACKED", 5: "DELTA_BINARY_PACKED", 6: "DELTA_LENGTH_BYTE_ARRAY", 7: "DELTA_BYTE_ARRAY", 8: "RLE_DICTIONARY", 9: "BYTE_STREAM_SPLIT"}
METADATA_CAP = 64 << 20


class Bad(ValueError):
    """The bytes aren't what their format says."""


def varint(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(b) or shift > 70:
            raise Bad("truncated integer")
        out |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return out, at
        shift += 7


class Thrift:
    """A compact-protocol reader: structs become dicts by field id, so that nothing that the file says is lost."""

    def __init__(self, b: bytes):
        self.b, self.at = b, 0

    def int(self) -> int:
        n, self.at = varint(self.b, self.at)
        return (n >> 1) ^ -(n & 1)

    def value(self, kind: int):
        if kind in (1, 2):
            return kind == 1
        if kind == 3:
            self.at += 1
            return struct.unpack_from("b", self.b, self.at - 1)[0]
        if kind in (4, 5, 6):
            return self.int()
        if kind == 7:
            self.at += 8
            return struct.unpack_from("<d", self.b, self.at - 8)[0]
        if kind == 8:
            n, self.at = varint(self.b, self.at)
            if self.at + n > len(self.b):
                raise Bad("truncated bytes")
            self.at += n
            return self.b[self.at - n : self.at]
        if kind in (9, 10):
            head = self.b[self.at]
            self.at += 1
            n, kind = head >> 4, head & 15
            if n == 15:
                n, self.at = varint(self.b, self.at)
            if kind in (1, 2):  # in lists a boolean has a byte of its own
                self.at += n
                return [x == 1 for x in self.b[self.at - n : self.at]]
            return [self.value(kind) for _ in range(n)]
        if kind == 11:
            n, self.at = varint(self.b, self.at)
            if n == 0:
                return {}
            kinds = self.b[self.at]
            self.at += 1
            return {self.value(kinds >> 4): self.value(kinds & 15) for _ in range(n)}
        if kind == 12:
            return self.struct()
        raise Bad(f"unknown thrift type {kind}")

    def struct(self) -> dict:
        out, last = {}, 0
        while True:
            head = self.b[self.at]
            self.at += 1
            if head == 0:
                return out
            last = last + (head >> 4) if head >> 4 else self.int()
            out[last] = self.value(head & 15)


def parquet_footer(read, size: int) -> dict:
    """read(offset, length) gives bytes. Row groups, columns and key-value entries as the footer has them."""
    if size < 12:
        raise Bad("too small for Parquet")
    tail = read(size - 8, 8)
    n = struct.unpack("<I", tail[:4])[0]
    if tail[4:] != b"PAR1" or n + 12 > size:
        raise Bad("not a Parquet footer")
    try:
        meta = Thrift(read(size - 8 - n, n)).struct()
    except (IndexError, struct.error) as e:
        raise Bad("truncated footer") from e
    text = lambda x: x.decode("utf-8", "replace")
    groups = []
    for i, g in enumerate(meta.get(4, [])):
        cols = []
        for c in g.get(1, []):
            m = c.get(3, {})
            s = m.get(12)
            low, high = (s or {}).get(6, (s or {}).get(2)), (s or {}).get(5, (s or {}).get(1))
            cols.append({
                "path": ".".join(map(text, m.get(3, []))), "physical_type": TYPES[m[1]] if 0 <= m.get(1, -1) < len(TYPES) else "UNKNOWN",
                "compression": CODECS[m[4]] if 0 <= m.get(4, -1) < len(CODECS) else "UNKNOWN", "encodings": [ENCODINGS.get(e, f"UNKNOWN_{e}") for e in m.get(2, [])],
                "has_statistics": s is not None, "null_count": (s or {}).get(3), "distinct_count": (s or {}).get(4), "min_hex": low.hex() if low is not None else None, "max_hex": high.hex() if high is not None else None,
                "num_values": m.get(5, 0), "uncompressed_size": m.get(6, 0), "compressed_size": m.get(7, 0),
            })
        groups.append({"ordinal": i, "num_rows": g.get(3, 0), "total_byte_size": g.get(2, 0), "columns": cols})
    kv = [(text(e.get(1, b"")), text(e[2]) if 2 in e else None) for e in meta.get(5, [])]
    return {"num_rows": meta.get(3, 0), "row_groups": groups, "kv": kv}


def arrow_type(t) -> str:
    """An Arrow type in the spelling that rules match."""
    import pyarrow as pa

    units = {"s": "Second", "ms": "Millisecond", "us": "Microsecond", "ns": "Nanosecond"}
    plain = {"string": "Utf8", "large_string": "LargeUtf8", "binary": "Binary", "large_binary": "LargeBinary", "bool": "Boolean", "float": "Float32", "double": "Float64", "halffloat": "Float16", "date32[day]": "Date32", "date64[ms]": "Date64", "null": "Null", "string_view": "Utf8View", "binary_view": "BinaryView"}
    if pa.types.is_timestamp(t):
        return f"Timestamp({units[t.unit]}, {f'Some({chr(34)}{t.tz}{chr(34)})' if t.tz else 'None'})"
    if pa.types.is_dictionary(t):
        return f"Dictionary({arrow_type(t.index_type)}, {arrow_type(t.value_type)})"
    if pa.types.is_struct(t):
        return "Struct([" + ", ".join(f"{f.name}: {arrow_type(f.type)}" for f in t) + "])"
    if pa.types.is_map(t):
        return f"Map({arrow_type(t.key_type)}, {arrow_type(t.item_type)})"
    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        return f"{'LargeList' if pa.types.is_large_list(t) else 'FixedSizeList' if pa.types.is_fixed_size_list(t) else 'List'}({arrow_type(t.value_type)})"
    if pa.types.is_decimal(t):
        return f"Decimal{t.bit_width}({t.precision}, {t.scale})"
    if pa.types.is_time(t):
        return f"Time{t.bit_width}({units[t.unit]})"
    if pa.types.is_duration(t):
        return f"Duration({units[t.unit]})"
    s = str(t)
    return plain.get(s, s.replace("uint", "UInt").replace("int", "Int") if "int" in s else s)


def arrow_schema(schema, drop: str = "ARROW:schema") -> dict:
    text = lambda m: {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in (m or {}).items() if k != drop.encode()}
    return {"fields": [{"name": f.name, "data_type": arrow_type(f.type), "nullable": f.nullable, "metadata": text(f.metadata)} for f in schema], "metadata": text(schema.metadata)}


def _flat_field(b: bytes, table: int, slot: int) -> int | None:
    """Position of a FlatBuffer table's field, or None where it has none."""
    vtable = table - struct.unpack_from("<i", b, table)[0]
    if vtable < 0 or vtable + 4 > len(b):
        raise Bad("vtable out of bounds")
    at = 4 + 2 * slot
    if at + 2 > struct.unpack_from("<H", b, vtable)[0]:
        return None
    off = struct.unpack_from("<H", b, vtable + at)[0]
    return table + off if off else None


def ipc_stream(b: bytes) -> dict:
    """Frames of an Arrow IPC stream: errors in order, message count, whether framing is legacy and an end mark was met."""
    errors, at, legacy, eos, count, schemas = [], 0, False, False, 0, 0
    while at < len(b):
        start = at
        if at + 4 > len(b):
            errors.append("truncated message prefix")
            break
        n = struct.unpack_from("<I", b, at)[0]
        at += 4
        marked = n == 0xFFFFFFFF
        if marked:
            if at + 4 > len(b):
                errors.append("message is truncated after its continuation marker")
                break
            n = struct.unpack_from("<I", b, at)[0]
            at += 4
        else:
            legacy = legacy or n != 0
        if n == 0:
            eos = True
            if at < len(b):
                errors.append(f"{len(b) - at} bytes follow the end of the stream")
            break
        if n > METADATA_CAP:
            errors.append(f"message metadata of {n} bytes is beyond the limit")
            break
        if marked and n % 8:
            errors.append("message metadata length is no multiple of 8")
        if not legacy and start % 8:
            errors.append("message doesn't start at a multiple of 8")
        if at + n > len(b):
            errors.append("message metadata goes beyond the end of the file")
            break
        try:
            root = struct.unpack_from("<I", b, at)[0]
            meta = b[at : at + n]
            kind_at, body_at = _flat_field(meta, root, 1), _flat_field(meta, root, 3)
            kind = meta[kind_at] if kind_at else 0
            body = struct.unpack_from("<q", meta, body_at)[0] if body_at else 0
        except (struct.error, IndexError, Bad) as e:
            errors.append(f"message metadata is no valid FlatBuffer: {e}")
            break
        at += n
        count += 1
        if body < 0:
            errors.append("message body length is negative")
            break
        if body % 8:
            errors.append("message body length is no multiple of 8")
        if kind == 1:
            if count > 1:
                errors.append("schema isn't the first message")
            if body:
                errors.append("schema message has a body")
            schemas += 1
        elif kind in (2, 3):
            if not schemas:
                errors.append("data precede the schema")
        else:
            errors.append(f"message type {kind} has no place in a stream")
        if at + body > len(b):
            errors.append("message body goes beyond the end of the file")
            break
        at += body
    if schemas == 0:
        errors.append("stream has no schema")
    elif schemas > 1:
        errors.append("stream has more than one schema")
    return {"errors": errors, "legacy": legacy, "has_eos": eos, "messages": count}


def protobuf(b: bytes) -> dict[int, list]:
    """Fields of a message by tag: integers, or bytes for what has a length."""
    out: dict[int, list] = {}
    at = 0
    while at < len(b):
        key, at = varint(b, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(b, at)
        elif kind == 2:
            n, at = varint(b, at)
            if at + n > len(b):
                raise Bad("truncated field")
            value, at = b[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = int.from_bytes(b[at : at + n], "little"), at + n
        else:
            raise Bad(f"unknown wire type {kind}")
        out.setdefault(key >> 3, []).append(value)
    return out


def _int32s(values: list) -> list[int]:
    out = []
    for v in values:
        if isinstance(v, bytes):
            at = 0
            while at < len(v):
                x, at = varint(v, at)
                out.append(x)
        else:
            out.append(v)
    return [struct.unpack("<i", struct.pack("<I", x & 0xFFFFFFFF))[0] for x in out]


def lance_manifest(b: bytes) -> dict:
    """A manifest file: envelope, then the message."""
    if len(b) < 20 or b[-4:] != b"LANC":
        raise Bad("manifest has no Lance trailer")
    position, major, minor = struct.unpack("<qhh", b[-16:-4])
    if (major, minor) != (0, 1):
        raise Bad(f"unsupported manifest version {major}.{minor}")
    if not 0 <= position <= len(b) - 20:
        raise Bad("manifest position is out of range")
    n = struct.unpack_from("<I", b, position)[0]
    if position + 4 + n != len(b) - 16:
        raise Bad("manifest length doesn't match its envelope")
    m = protobuf(b[position + 4 : position + 4 + n])
    one = lambda d, k, default=0: d.get(k, [default])[-1]
    text = lambda d, k: one(d, k, b"").decode()
    fragments = []
    for f in map(protobuf, m.get(2, [])):
        files = [{"path": text(d, 1), "fields": _int32s(d.get(2, [])), "columns": _int32s(d.get(3, [])), "major": one(d, 4), "minor": one(d, 5), "size": one(d, 6), "base_id": one(d, 7, None)} for d in map(protobuf, f.get(2, []))]
        deletion = None
        if 3 in f:
            d = protobuf(f[3][-1])
            deletion = {"type": _int32s([one(d, 1)])[0], "read_version": one(d, 2), "id": one(d, 3), "rows": one(d, 4), "base_id": one(d, 7, None)}
        fragments.append({"id": one(f, 1), "files": files, "deletion": deletion, "rows": one(f, 4), "overlays": len(f.get(11, []))})
    bases = [{"id": one(d, 1), "root": bool(one(d, 3)), "path": text(d, 4)} for d in map(protobuf, m.get(18, []))]
    data = protobuf(m[15][-1]) if 15 in m else None
    return {"fragments": fragments, "version": one(m, 3), "reader": one(m, 9), "writer": one(m, 10), "max_fragment_id": one(m, 11, None), "transaction": text(m, 12), "config": len(m.get(16, [])), "bases": bases, "data_format": text(data, 2) if data is not None else None}


class Flat:
    """A bounds-checked FlatBuffer table."""

    def __init__(self, b: bytes, at: int):
        self.b, self.at = b, at
        if not 0 <= at <= len(b) - 4:
            raise Bad("table out of bounds")

    @classmethod
    def root(cls, b: bytes) -> Flat:
        if len(b) < 4:
            raise Bad("no root")
        return cls(b, struct.unpack_from("<I", b)[0])

    def num(self, slot: int, form: str, default=0):
        at = _flat_field(self.b, self.at, slot)
        return default if at is None else struct.unpack_from(f"<{form}", self.b, at)[0]

    def _ref(self, slot: int) -> int | None:
        at = _flat_field(self.b, self.at, slot)
        return None if at is None else at + struct.unpack_from("<I", self.b, at)[0]

    def table(self, slot: int) -> Flat | None:
        at = self._ref(slot)
        return None if at is None else Flat(self.b, at)

    def string(self, slot: int) -> str | None:
        at = self._ref(slot)
        if at is None:
            return None
        n = struct.unpack_from("<I", self.b, at)[0]
        if at + 4 + n > len(self.b):
            raise Bad("string out of bounds")
        return self.b[at + 4 : at + 4 + n].decode()

    def vector(self, slot: int, size: int) -> list[int] | None:
        """Where the elements of a vector begin."""
        at = self._ref(slot)
        if at is None:
            return None
        n = struct.unpack_from("<I", self.b, at)[0]
        if at + 4 + n * size > len(self.b):
            raise Bad("vector out of bounds")
        return [at + 4 + i * size for i in range(n)]

    def tables(self, slot: int) -> list[Flat]:
        return [Flat(self.b, at + struct.unpack_from("<I", self.b, at)[0]) for at in self.vector(slot, 4) or []]


def _segment(t: Flat | None) -> dict | None:
    if t is None:
        return None
    c = t.table(3)
    return {"offset": t.num(0, "Q"), "length": t.num(1, "I"), "exponent": t.num(2, "B"), "compression": c.num(0, "B") if c else None, "encrypted": t.table(4) is not None}


def vortex(read, size: int) -> dict:
    """Envelope, postscript and, where it is plain and within the limit, footer of a Vortex file."""
    out = {"size": size, "errors": [], "start": 0, "postscript": None, "footer": None, "footer_error": None, "footer_skip": None}
    if size < 12:
        out["errors"].append("file is smaller than a Vortex container")
        return out
    head, tail = read(0, 4), read(size - 8, 8)
    version, n = struct.unpack("<HH", tail[:4])
    if head != b"VTXF":
        out["errors"].append("leading magic isn't VTXF")
    if tail[4:] != b"VTXF":
        out["errors"].append("trailing magic isn't VTXF")
    if version != 1:
        out["errors"].append(f"unsupported container version {version}")
    if n > 65_527:
        out["errors"].append(f"postscript of {n} bytes is beyond the limit")
        return out
    if n + 8 > size:
        out["errors"].append("postscript begins before the file")
        return out
    start = out["start"] = size - 8 - n
    if start < 4:
        out["errors"].append("postscript overlaps the leading magic")
        return out
    try:
        root = Flat.root(read(start, n))
        ps = {k: _segment(root.table(i)) for i, k in enumerate(("dtype", "layout", "statistics", "footer"))}
        ps["metadata"] = [{"key": t.string(0), "segment": _segment(t.table(1))} for t in root.tables(4)]
        out["postscript"] = ps
    except (struct.error, IndexError, UnicodeDecodeError, Bad) as e:
        out["errors"].append(f"postscript is no valid FlatBuffer: {e}")
        return out
    f = ps["footer"]
    if f is None:
        return out
    if f["compression"] not in (None, 0) or f["encrypted"]:
        out["footer_skip"] = "opaque"
    elif f["offset"] + f["length"] > start:
        pass
    elif f["length"] > METADATA_CAP:
        out["footer_skip"] = "size"
    else:
        try:
            b = read(f["offset"], f["length"])
            root = Flat.root(b)
            ids = lambda slot: [t.string(0) for t in root.tables(slot)]
            specs = root.vector(2, 16)
            segments = None if specs is None else [dict(zip(("offset", "length", "exponent", "compression_index", "encryption_index"), struct.unpack_from("<QIBBH", b, at))) for at in specs]
            out["footer"] = {"arrays": ids(0), "layouts": ids(1), "segments": segments, "schemes": [t.num(0, "B") for t in root.tables(3)], "encryptions": len(root.vector(4, 4) or [])}
        except (struct.error, IndexError, UnicodeDecodeError, Bad) as e:
            out["footer_error"] = str(e)
    return out
