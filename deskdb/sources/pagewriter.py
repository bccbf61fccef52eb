"""Writes small page files, held whole in memory: fixtures for the reader, from the format's layout tables."""

import struct

from deskdb.sources.pages import HEADER_AT, HEADER_KEY, V3, V4, rc4, squeezed


class Writer:
    def __init__(self, wide=True, key=0, version=None):
        self.wide, self.at, self.key = wide, V4 if wide else V3, key
        self.version = version if version is not None else int(wide)
        self.pages = [None, bytearray(self.at.page)]
        self.pages.append(None)  # the catalog's definition

    def text(self, s):
        return squeezed(s) if self.wide else s.encode("cp1252")

    def name(self, s):
        raw = s.encode("utf-16-le") if self.wide else s.encode("cp1252")
        return (struct.pack("<H", len(raw)) if self.wide else bytes([len(raw)])) + raw

    def new_page(self):
        self.pages.append(bytearray(self.at.page))
        return len(self.pages) - 1

    def data_page(self, owner, rows):
        """rows: (bytes, flags). owner: a definition's page or b"LVAL"."""
        n = self.new_page()
        page = self.pages[n]
        page[0:2] = b"\x01\x01"
        page[4:8] = owner if isinstance(owner, bytes) else struct.pack("<I", owner)
        struct.pack_into("<H", page, self.at.rows_at, len(rows))
        end = self.at.page
        for k, (row, flags) in enumerate(rows):
            end -= len(row)
            page[end : end + len(row)] = row
            struct.pack_into("<H", page, self.at.rows_at + 2 + 2 * k, end | flags)
        return n

    def row(self, columns, values):
        """columns: (name, code, fixed, length, ...) ; values already bytes, None, or True/False for booleans."""
        fixed, var, mask, total = bytearray(), [], bytearray((len(columns) + 7) // 8), len(columns)
        for k, (c, v) in enumerate(zip(columns, values)):
            if v is not None and v is not False:
                mask[k // 8] |= 1 << k % 8
            if c["code"] == 1:
                continue
            if c["fixed"]:
                fixed += v if v is not None else bytes(c["length"])
            else:
                var.append(v or b"")
        head = (struct.pack("<H", total) if self.wide else bytes([total])) + bytes(fixed)
        if not any(not c["fixed"] for c in columns):
            return head + bytes(mask)
        offsets, at = [], len(head)
        for v in var:
            offsets.append(at)
            at += len(v)
        offsets.append(at)
        body = head + b"".join(var)
        if self.wide:
            return body + b"".join(struct.pack("<H", o) for o in reversed(offsets)) + struct.pack("<H", len(var)) + bytes(mask)
        plain = len(body) + len(offsets) + 1 + len(mask)
        jumps = 0
        while (plain + jumps - 1) // 256 != jumps:
            jumps += 1
        table = [next((k for k, o in enumerate(offsets) if o >= 256 * (j + 1)), 0xFF) for j in range(jumps)]
        return body + bytes(o & 255 for o in reversed(offsets)) + bytes(reversed(table)) + bytes([len(var)]) + bytes(mask)

    def definition(self, n, columns, n_rows, used_map, indexes=()):
        at, fixed_at, var = self.at, 0, 0
        d = bytearray(at.columns)
        d[0:2] = b"\x02\x01"
        struct.pack_into("<I", d, at.n_rows, n_rows)
        struct.pack_into("<H", d, at.n_columns, len(columns))
        struct.pack_into("<I", d, at.n_logical, len(indexes))
        struct.pack_into("<I", d, at.n_physical, len(indexes))
        struct.pack_into("<I", d, at.used_map, used_map)
        d += bytes(at.physical_size * len(indexes))
        for k, c in enumerate(columns):
            e = bytearray(at.column_size)
            e[0] = c["code"]
            struct.pack_into("<H", e, at.number, k)
            if c["fixed"] and c["code"] != 1:
                struct.pack_into("<H", e, at.fixed_at, fixed_at)
                fixed_at += c["length"]
            elif not c["fixed"]:
                struct.pack_into("<H", e, at.var_index, var)
                var += 1
            struct.pack_into("<H", e, at.length, c["length"])
            e[at.precision], e[at.precision + 1] = c.get("precision", 0), c.get("scale", 0)
            e[at.flags] = c.get("flags", 0) | (1 if c["fixed"] else 0)
            d += e
        for c in columns:
            d += self.name(c["name"])
        for x in indexes:
            e = bytearray(at.physical_info)
            base = 4 if self.wide else 0
            for k in range(10):
                number, desc = x["keys"][k] if k < len(x["keys"]) else (0xFFFF, False)
                struct.pack_into("<HB", e, base + 3 * k, number, 0 if desc else 1)
            e[base + 38] = x["flags"]
            d += e
        for k, x in enumerate(indexes):
            e = bytearray(at.logical_info)
            struct.pack_into("<II", e, 4 if self.wide else 0, k, k)
            e[27 if self.wide else 19] = x["kind"]
            d += e
        for x in indexes:
            d += self.name(x["name"])
        chunks, rest = [d[: at.page]], d[at.page :]
        while rest:
            chunks.append(rest[: at.page - 8])
            rest = rest[at.page - 8 :]
        numbers = [n] + [self.new_page() for _ in chunks[1:]]
        for k, (m, chunk) in enumerate(zip(numbers, chunks)):
            page = bytearray(at.page)
            if k == 0:
                page[: len(chunk)] = chunk
            else:
                page[0:2] = b"\x02\x01"
                page[8 : 8 + len(chunk)] = chunk
            struct.pack_into("<I", page, 4, numbers[k + 1] if k + 1 < len(numbers) else 0)
            self.pages[m] = page

    def usage(self, pages, kind=0):
        """A usage map's pointer."""
        if kind == 0:
            first = min(pages, default=0)
            bits = bytearray(64)
            for p in pages:
                bits[(p - first) // 8] |= 1 << (p - first) % 8
            row = b"\0" + struct.pack("<I", first) + bytes(bits)
        elif kind == 1:
            n = self.new_page()
            page = self.pages[n]
            page[0] = 5
            for p in pages:
                page[4 + p // 8] |= 1 << p % 8
            row = b"\1" + struct.pack("<II", n, 0)
        else:
            row = bytes([kind]) + bytes(8)
        return self.data_page(b"MAPS", [(row, 0)]) << 8

    def table(self, columns, rows, n=None, per_page=50, kind=0, indexes=(), flags=None):
        """rows: lists of values as in row(), or ready (bytes, flags)."""
        n = self.new_page() if n is None else n
        ready = [r if isinstance(r, tuple) else (self.row(columns, r), 0) for r in rows]
        pages = [self.data_page(n, ready[k : k + per_page]) for k in range(0, len(ready), per_page)]
        self.definition(n, columns, len(rows), self.usage(pages, kind), indexes)
        return n

    def bytes(self, objects):
        """objects: (id, name, type, flags, property block or None)."""
        columns = [
            {"name": "Id", "code": 4, "fixed": True, "length": 4}, {"name": "Type", "code": 3, "fixed": True, "length": 2}, {"name": "Flags", "code": 4, "fixed": True, "length": 4},
            {"name": "Name", "code": 10, "fixed": False, "length": 510}, {"name": "LvProp", "code": 11, "fixed": False, "length": 0},
        ]
        rows = [[struct.pack("<i", i), struct.pack("<h", t), struct.pack("<I", f), self.text(name), self.inline(p) if p else None] for i, name, t, f, p in objects]
        self.table(columns, rows, n=2)
        head = bytearray(self.at.page)
        head[4:19] = b"Standard Jet DB" if self.version < 2 else b"Standard ACE DB"
        head[0x14] = self.version
        plain = bytearray(126 if self.version == 0 else 128)
        struct.pack_into("<I", plain, 0x3E - HEADER_AT, self.key)
        struct.pack_into("<H", plain, 0x3C - HEADER_AT, 1252)
        head[HEADER_AT : HEADER_AT + len(plain)] = rc4(HEADER_KEY, bytes(plain))
        self.pages[0] = head
        out = [bytes(p) if n == 0 or not self.key else rc4(struct.pack("<I", self.key ^ n), bytes(p)) for n, p in enumerate(self.pages)]
        return b"".join(out)

    @staticmethod
    def inline(raw):
        return struct.pack("<III", len(raw) | 0x80000000, 0, 0) + raw

    def single(self, raw):
        return struct.pack("<III", len(raw) | 0x40000000, self.data_page(b"LVAL", [(raw, 0)]) << 8, 0)

    def chain(self, raw, size):
        pointer = 0
        for k in reversed(range(0, len(raw), size)):
            pointer = self.data_page(b"LVAL", [(struct.pack("<I", pointer) + raw[k : k + size], 0)]) << 8
        return struct.pack("<III", len(raw), pointer, 0)


def property_block(names, parts, wide=True):
    """parts: (column or "", [(name number, type code, raw value)])."""
    enc = lambda s: s.encode("utf-16-le" if wide else "cp1252")
    body = b"".join(struct.pack("<H", len(enc(n))) + enc(n) for n in names)
    out = (b"MR2\0" if wide else b"KKD\0") + struct.pack("<IH", 6 + len(body), 0x80) + body
    for column, values in parts:
        head = struct.pack("<IH", 6 + len(enc(column)), len(enc(column))) + enc(column)
        vals = b"".join(struct.pack("<HBBHH", 8 + len(v), 1, code, which, len(v)) + v for which, code, v in values)
        out += struct.pack("<IH", 6 + len(head) + len(vals), 1 if column else 0) + head + vals
    return out
