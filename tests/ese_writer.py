"""Writes small database files for tests, from the published layout; shares no code with the decoder."""

import struct

ROOT, LEAF, PARENT, NEW = 1, 2, 4, 0x800


def page(size, flags, entries, prefix=b"", nxt=0, pgno=0):
    """entries: (key, data, compressed prefix length, deleted)."""
    head = 40 if size <= 8192 else 80
    small = size <= 8192
    body, tags = bytearray(prefix), [(len(prefix), 0, 0)]
    for key, data, shared, deleted in entries:
        item = (struct.pack("<H", shared) if shared else b"") + struct.pack("<H", len(key) - shared) + key[shared:] + data
        bits = (4 if shared else 0) | (2 if deleted else 0)
        if not small:
            item = bytearray(item)
            item[1] |= bits << 5
        tags.append((len(item), len(body), bits if small else 0))
        body += item
    out = bytearray(size)
    struct.pack_into("<qqIIIHHHHI", out, 0, 0, 0, 0, nxt, 2, 0, 0, len(body), 1 << 12 | len(tags), flags)
    out[head : head + len(body)] = body
    for i, (n, at, bits) in enumerate(tags):
        struct.pack_into("<HH", out, size - 4 * (i + 1), n, at | bits << 13)
    return bytes(out)


def header(size, magic=0x89ABCDEF, major=9):
    out = bytearray(size)
    struct.pack_into("<III", out, 0, 0, magic, 0x620)
    struct.pack_into("<I", out, 52, 3)
    struct.pack_into("<II", out, 232, major, 0 if size == 4096 else size)
    return bytes(out)


def record(fixed, variable, tagged=b"", fixed_null=()):
    """fixed: bytes of columns 1..n in order; variable: bytes or None of columns 128.. in order."""
    data = b"".join(fixed)
    bitmap = bytearray((len(fixed) + 7) // 8)
    for i in fixed_null:
        bitmap[(i - 1) // 8] |= 1 << (i - 1) % 8
    end = 4 + len(data) + len(bitmap)
    offsets, at = [], 0
    for v in variable:
        at += len(v or b"")
        offsets.append(at | (0x8000 if v is None else 0))
    return struct.pack("<BBH", len(fixed), 127 + len(variable), end) + data + bytes(bitmap) + struct.pack(f"<{len(offsets)}H", *offsets) + b"".join(v or b"" for v in variable) + tagged


def tagged(fields, small):
    """fields: (column id, flags or None, value); None with small pages writes no flags byte."""
    head, body = b"", b""
    at = 4 * len(fields)
    for number, flags, value in fields:
        extra = flags is not None or not small
        head += struct.pack("<HH", number, at | (0x4000 if extra and small else 0))
        item = (bytes([flags or 0]) if extra else b"") + value
        body += item
        at += len(item)
    return head + body


def catalog_row(table, kind, number, value, name, space=0, flags=0, page=0, keys=b"", default=b""):
    fixed = [struct.pack("<i", table), struct.pack("<h", kind), *(struct.pack("<i", v) for v in (number, value, space, flags, page))]
    return record(fixed, [name.encode(), b"", b"", default or None, keys or None])
