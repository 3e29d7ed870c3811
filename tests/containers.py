"""Writers of small Lance and Vortex containers and IPC frames, made from the formats' published layouts."""

import struct


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    """A protobuf message of (tag, value): numbers, texts, or messages already written."""
    out = b""
    for tag, value in fields:
        if isinstance(value, int):
            out += varint(tag << 3) + varint(value & (1 << 64) - 1)
        else:
            raw = value.encode() if isinstance(value, str) else value
            out += varint(tag << 3 | 2) + varint(len(raw)) + raw
    return out


def lance_manifest(fragments, version=4, more=(), before=b""):
    """The message after its length, then where it begins, the layout's version and the magic."""
    body = message(*((2, f) for f in fragments), (3, version), *more, (15, message((1, "lance"), (2, "2.0"))))
    return before + struct.pack("<I", len(body)) + body + struct.pack("<qhh", len(before), 0, 1) + b"LANC"


def lance_fragment(number, path, size, rows=3_000_000, fields=(0, 1, 2), deletion=None, base=None):
    ids = b"".join(map(varint, fields))
    file = message((1, path), (2, ids), (3, bytes(range(len(fields)))), (4, 2), (5, 0), (6, size), *([(7, base)] if base is not None else []))
    return message((1, number), (2, file), *([(3, deletion)] if deletion else []), (4, rows))


class Flat:
    """Writes a FlatBuffer forwards: each table's vtable stands before it, what it refers to after it."""

    def __init__(self, root):
        self.b = bytearray(4)
        struct.pack_into("<I", self.b, 0, self.put(root))

    def put(self, spec):
        b, (kind, value) = self.b, spec
        if kind == "text":
            at = len(b)
            b += struct.pack("<I", len(value)) + value + b"\0"
            return at
        if kind == "structs":
            at = len(b)
            b += struct.pack("<I", len(value)) + b"".join(value)
            return at
        if kind == "tables":
            at = len(b)
            b += struct.pack("<I", len(value)) + bytes(4 * len(value))
            for i, x in enumerate(value):
                struct.pack_into("<I", b, at + 4 + 4 * i, self.put(x) - (at + 4 + 4 * i))
            return at
        slots, size, inline = [0] * (max(value, default=-1) + 1), 4, []
        for slot, (form, x) in sorted(value.items()):
            slots[slot] = size
            inline.append((slot, form, x))
            size += struct.calcsize("<" + ("I" if form == "ref" else form))
        begin = len(b)
        b += struct.pack(f"<HH{len(slots)}H", 4 + 2 * len(slots), size, *slots)
        table = len(b)
        b += struct.pack("<i", table - begin) + bytes(size - 4)
        for slot, form, x in inline:
            at = table + slots[slot]
            struct.pack_into("<I" if form == "ref" else f"<{form}", b, at, self.put(x) - at if form == "ref" else x)
        return table


def segment(offset, length, exponent=0, scheme=None, locked=False):
    own = {0: ("Q", offset), 1: ("I", length), 2: ("B", exponent)}
    if scheme is not None:
        own[3] = ("ref", ("table", {0: ("B", scheme)}))
    if locked:
        own[4] = ("ref", ("table", {}))
    return "table", own


def vortex(drop=(), entries=((b"origin", 4),), spans=((8, 8, 3), (16, 8, 3)), arrays=(b"vortex.alp", b"vortex.bool"), schemes=(1,), version=1, head=b"VTXF", tail=b"VTXF", footer=None, scheme=None, locked=False, dtype_at=24, post=None):
    """A whole file: data, footer, postscript, and the eight bytes at its end."""
    names = lambda xs: ("tables", [("table", {0: ("ref", ("text", x))}) for x in xs])
    raw = footer
    if raw is None:
        raw = bytes(Flat(("table", {0: ("ref", names(arrays)), 1: ("ref", names([b"vortex.flat"])), 2: ("ref", ("structs", [struct.pack("<QIBBH", o, n, e, 0, 0) for o, n, e in spans])), 3: ("ref", ("tables", [("table", {0: ("B", s)}) for s in schemes]))})).b)
    data = head + bytes(28) + raw
    parts = {"dtype": segment(dtype_at, 4), "layout": segment(28, 2), "statistics": segment(30, 2), "footer": segment(32, len(raw), scheme=scheme, locked=locked)}
    own = {i: ("ref", parts[k]) for i, k in enumerate(("dtype", "layout", "statistics", "footer")) if k not in drop}
    own[4] = ("ref", ("tables", [("table", {0: ("ref", ("text", k)), 1: ("ref", segment(at, 1))}) for k, at in entries]))
    ps = bytes(Flat(("table", own)).b) if post is None else post
    return data + ps + struct.pack("<HH", version, len(ps)) + tail
