"""The page format: tables, rows and long values from bytes. Plain Python, so that readers on executors can use it.

``PageFile`` reads pages through a function from (offset, length) to bytes: a file, a store's object, or a buffer in memory.
Layouts are those of the file format's public notes: 2 KiB pages (version 3) or 4 KiB pages (4 and later).
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from decimal import Decimal

from deskdb import types as K


class PageError(ValueError):
    """Bytes that are not of the format."""


@dataclass(frozen=True)
class Layout:
    """Where things stand in pages of one version. Positions within a table definition count from its page's start."""

    page: int
    rows_at: int
    n_rows: int
    n_columns: int
    n_logical: int
    n_physical: int
    used_map: int
    columns: int
    physical_size: int
    column_size: int
    number: int
    var_index: int
    row_number: int
    precision: int
    flags: int
    fixed_at: int
    length: int
    physical_info: int
    logical_info: int


# Positions and sizes of the file format.
V3 = Layout(2048, 8, 12, 25, 27, 31, 35, 43, 8, 18, 1, 3, 5, 9, 13, 14, 16, 39, 20)
V4 = Layout(4096, 12, 16, 45, 47, 51, 55, 63, 12, 25, 5, 7, 9, 11, 15, 21, 23, 52, 28)
VERSIONS = {0: "JET3", 1: "JET4", 2: "ACE12", 3: "ACE14", 4: "ACE15", 5: "ACE16", 6: "ACE17"}
HEADER_KEY = bytes([0xC7, 0xDA, 0x39, 0x6B])
HEADER_AT, KEY_AT, CODE_PAGE_AT = 0x18, 0x3E, 0x3C
CATALOG_PAGE = 2
#: Pages that are read at once.
RUN_PAGES = 256
DAY_ZERO = datetime(1899, 12, 30)
FIXED_SIZE = {K.BYTE.code: 1, K.INTEGER.code: 2, K.LONG.code: 4, K.CURRENCY.code: 8, K.SINGLE.code: 4, K.DOUBLE.code: 8, K.DATETIME.code: 8, K.REPID.code: 16, K.NUMERIC.code: 17, K.COMPLEX.code: 4}


def rc4(key: bytes, data: bytes) -> bytes:
    """RC4: the same call encrypts and decrypts."""
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(), 0, 0
    for b in data:
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out.append(b ^ box[(box[i] + box[j]) & 255])
    return bytes(out)


def wide_text(raw: bytes) -> str:
    """UTF-16 text; after FF FE, runs of one byte a character and of two bytes take turns at zero bytes."""
    if raw[:2] != b"\xff\xfe":
        return raw[: len(raw) & ~1].decode("utf-16-le", "replace")
    out, at, narrow = [], 2, True
    while at < len(raw):
        if raw[at] == 0:
            narrow, at = not narrow, at + 1
        elif narrow:
            out.append(raw[at : at + 1] + b"\0")
            at += 1
        else:
            out.append(raw[at : at + 2])
            at += 2
    return b"".join(out).decode("utf-16-le", "replace")


def squeezed(text: str) -> bytes:
    """``text`` as stored: one byte a character where all are below 256 and none is zero, else UTF-16."""
    wide = text.encode("utf-16-le")
    if len(text) >= 2 and all(0 < ord(c) < 256 for c in text):
        return b"\xff\xfe" + text.encode("latin-1")
    return wide


@dataclass(frozen=True)
class Column:
    name: str
    code: int
    number: int
    var_index: int
    fixed_at: int
    length: int
    precision: int
    scale: int
    flags: int

    @property
    def fixed(self) -> bool:
        return bool(self.flags & 1)

    @property
    def auto(self) -> bool:
        return bool(self.flags & 4)


@dataclass(frozen=True)
class Index:
    name: str
    kind: int
    flags: int
    keys: tuple[tuple[int, bool], ...]


@dataclass
class Table:
    page: int
    said_rows: int
    columns: list[Column] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    used_map: int = 0


class PageFile:
    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        self.read, self.size = read, size
        head = read(0, 0x80)
        if len(head) < 0x80 or head[4:19] not in (b"Standard Jet DB", b"Standard ACE DB"):
            raise PageError("not a database of this format")
        version = head[0x14]
        if version not in VERSIONS:
            raise PageError(f"unknown version {version}")
        self.version, self.at = VERSIONS[version], V3 if version == 0 else V4
        plain = rc4(HEADER_KEY, head[HEADER_AT : HEADER_AT + (126 if version == 0 else 128)])
        pick = lambda at, n: plain[at - HEADER_AT : at - HEADER_AT + n]
        self.key = struct.unpack("<I", pick(KEY_AT, 4))[0]
        page = struct.unpack("<H", pick(CODE_PAGE_AT, 2))[0]
        self.charset = self._charset(page)
        self._tables: dict[int, Table] = {}

    @staticmethod
    def _charset(page: int) -> str:
        import codecs

        for name in (f"cp{page}", "cp1252"):
            try:
                return codecs.lookup(name).name
            except LookupError:
                continue
        return "latin-1"

    @classmethod
    def of_bytes(cls, data: bytes) -> "PageFile":
        return cls(lambda at, n: data[at : at + n], len(data))

    @property
    def pages(self) -> int:
        return self.size // self.at.page

    def page(self, n: int) -> bytes:
        return self._plain_page(n, self.read(n * self.at.page, self.at.page))

    def _plain_page(self, n: int, data: bytes) -> bytes:
        if len(data) < self.at.page:
            raise PageError(f"page {n} is not there")
        return rc4(struct.pack("<I", self.key ^ n), data) if self.key and n else data

    def runs(self, numbers: Iterable[int]) -> Iterator[tuple[int, bytes]]:
        """(number, page) of each page; neighbours are read at once, up to RUN_PAGES of them."""
        held: list[int] = []
        for n in [*numbers, -1]:
            if held and (n != held[-1] + 1 or len(held) == RUN_PAGES):
                data = self.read(held[0] * self.at.page, len(held) * self.at.page)
                yield from ((m, self._plain_page(m, data[k * self.at.page : (k + 1) * self.at.page])) for k, m in enumerate(held))
                held = []
            held.append(n)

    def bounds(self, page: bytes, row: int) -> tuple[int, int, int]:
        """(start, end, flags) of a page's row."""
        at = self.at.rows_at
        (n,) = struct.unpack_from("<H", page, at)
        if row >= n or at + 2 + 2 * n > len(page):
            raise PageError(f"no row {row}")
        (raw,) = struct.unpack_from("<H", page, at + 2 + 2 * row)
        end = struct.unpack_from("<H", page, at + 2 * row)[0] & 0x1FFF if row else len(page)
        if not raw & 0x1FFF <= end <= len(page):
            raise PageError(f"row {row} out of its page")
        return raw & 0x1FFF, end, raw & 0xE000

    def pointed(self, pointer: int) -> bytes:
        """The row that a pointer (page << 8 | row) says."""
        page = self.page(pointer >> 8)
        start, end, _ = self.bounds(page, pointer & 255)
        return page[start:end]

    def text(self, raw: bytes) -> str:
        return raw.decode(self.charset, "replace") if self.at is V3 else wide_text(raw)

    def _definition(self, n: int) -> bytes:
        """A table definition, whose later pages follow the first without their heads."""
        data, seen = b"", set()
        while n:
            if n in seen:
                raise PageError("definition runs in a circle")
            seen.add(n)
            page = self.page(n)
            if page[0] != 2:
                raise PageError(f"page {n} defines no table")
            data += page if not data else page[8:]
            n = struct.unpack_from("<I", page, 4)[0]
        return data

    def table(self, n: int) -> Table:
        if n in self._tables:
            return self._tables[n]
        d, at = self._definition(n), self.at
        u16 = lambda p: struct.unpack_from("<H", d, p)[0]
        u32 = lambda p: struct.unpack_from("<I", d, p)[0]
        try:
            made = Table(n, u32(at.n_rows), used_map=u32(at.used_map))
            n_columns, n_logical, n_physical = u16(at.n_columns), u32(at.n_logical), u32(at.n_physical)
            p = at.columns + n_physical * at.physical_size
            names = p + n_columns * at.column_size
            wide = at is V4
            parts = [(p + k * at.column_size) for k in range(n_columns)]
            for c in parts:
                size = u16(names) if wide else d[names]
                names += 2 if wide else 1
                name = d[names : names + size].decode("utf-16-le", "replace") if wide else d[names : names + size].decode(self.charset, "replace")
                names += size
                made.columns.append(Column(name, d[c], u16(c + at.number), u16(c + at.var_index), u16(c + at.fixed_at), u16(c + at.length), d[c + at.precision], d[c + at.precision + 1], d[c + at.flags]))
            made.columns.sort(key=lambda c: c.number)
            made.indexes = self._indexes(d, names, n_physical, n_logical, wide)
        except (struct.error, IndexError) as e:
            raise PageError(f"table definition {n} is cut short") from e
        self._tables[n] = made
        return made

    def _indexes(self, d: bytes, p: int, n_physical: int, n_logical: int, wide: bool) -> list[Index]:
        physical = []
        for _ in range(n_physical):
            q = p + (4 if wide else 0)
            keys = []
            for k in range(10):
                number, order = struct.unpack_from("<HB", d, q + 3 * k)
                if number != 0xFFFF:
                    keys.append((number, order != 1))
            physical.append((tuple(keys), d[q + 38]))
            p += self.at.physical_info
        logical = []
        for _ in range(n_logical):
            q = p + (4 if wide else 0)
            _, which = struct.unpack_from("<II", d, q)
            logical.append((which, d[q + 23] if wide else d[q + 19]))
            p += self.at.logical_info
        out = []
        for which, kind in logical:
            size = struct.unpack_from("<H", d, p)[0] if wide else d[p]
            p += 2 if wide else 1
            raw = d[p : p + size]
            p += size
            keys, flags = physical[which] if which < len(physical) else ((), 0)
            out.append(Index(raw.decode("utf-16-le", "replace") if wide else raw.decode(self.charset, "replace"), kind, flags, keys))
        return out

    def data_pages(self, table: Table) -> Iterator[int]:
        """The table's pages by its usage map; where the map is of an unknown kind, every page that says it is the table's."""
        row = self.pointed(table.used_map)
        if row[0] == 0:
            (first,) = struct.unpack_from("<I", row, 1)
            yield from (first + n for n in _bits(row[5:]))
        elif row[0] == 1:
            per = (self.at.page - 4) * 8
            for k in range((len(row) - 1) // 4):
                (n,) = struct.unpack_from("<I", row, 1 + 4 * k)
                if n:
                    yield from (k * per + x for x in _bits(self.page(n)[4:]))
        else:
            yield from range(1, self.pages)

    def rows(self, table: Table, pages: list[int] | None = None) -> Iterator[dict[str, object]]:
        """Rows in storage order, by column name; of all the table's pages, or of some."""
        for n, page in self.runs(n for n in (self.data_pages(table) if pages is None else pages) if n < self.pages):
            if page[0] != 1 or struct.unpack_from("<I", page, 4)[0] != table.page:
                continue
            for k in range(struct.unpack_from("<H", page, self.at.rows_at)[0]):
                start, end, flags = self.bounds(page, k)
                if flags & 0x8000:  # deleted
                    continue
                row = page[start:end]
                if flags & 0x4000:  # moved: the row's place holds a pointer
                    row = self.pointed(struct.unpack_from("<I", row)[0])
                yield self.cells(table, row)

    def cells(self, table: Table, row: bytes) -> dict[str, object]:
        wide = self.at is V4
        try:
            stored = struct.unpack_from("<H", row)[0] if wide else row[0]
            head = 2 if wide else 1
            mask = row[len(row) - (stored + 7) // 8 :]
            offsets = self._offsets(table, row, len(mask), wide)
            out = {}
            for c in table.columns:
                there = c.number < stored and bool(mask[c.number // 8] >> (c.number % 8) & 1)
                if c.code == K.BOOLEAN.code:
                    out[c.name] = there
                elif not there:
                    out[c.name] = None
                elif c.fixed:
                    at = head + c.fixed_at
                    out[c.name] = self.value(c, row[at : at + FIXED_SIZE.get(c.code, c.length)])
                elif c.var_index + 1 < len(offsets):
                    out[c.name] = self.value(c, row[offsets[c.var_index] : offsets[c.var_index + 1]])
                else:
                    out[c.name] = None
            return out
        except (struct.error, IndexError) as e:
            raise PageError("row is cut short") from e

    @staticmethod
    def _offsets(table: Table, row: bytes, mask: int, wide: bool) -> list[int]:
        """Where each variable column begins, and the last one ends."""
        if not any(not c.fixed for c in table.columns):
            return []
        end = len(row) - mask
        if wide:
            (n,) = struct.unpack_from("<H", row, end - 2)
            return [struct.unpack_from("<H", row, end - 4 - 2 * k)[0] for k in range(n + 1)]
        n, jumps = row[end - 1], (len(row) - 1) // 256
        raised = [j for j in row[end - 1 - jumps : end - 1] if j != 0xFF]
        return [row[end - 2 - jumps - k] + 256 * sum(j <= k for j in raised) for k in range(n + 1)]

    def value(self, c: Column, raw: bytes) -> object:
        code = c.code
        if code == K.BYTE.code:
            return raw[0]
        if code in (K.INTEGER.code, K.LONG.code, K.COMPLEX.code):
            return int.from_bytes(raw, "little", signed=True)
        if code == K.CURRENCY.code:
            return Decimal(int.from_bytes(raw, "little", signed=True)).scaleb(-4)
        if code == K.SINGLE.code:
            return struct.unpack("<f", raw)[0]
        if code == K.DOUBLE.code:
            return struct.unpack("<d", raw)[0]
        if code == K.DATETIME.code:
            (days,) = struct.unpack("<d", raw)
            return DAY_ZERO + timedelta(seconds=round(days * 86400)) if 0 <= days <= 1_000_000 else None
        if code == K.NUMERIC.code:
            whole = sum(int.from_bytes(raw[1 + 4 * k : 5 + 4 * k], "little") << 32 * (3 - k) for k in range(4))
            return Decimal(-whole if raw[0] & 0x80 else whole).scaleb(-c.scale)
        if code == K.REPID.code:
            return str(uuid.UUID(bytes_le=raw))
        if code == K.TEXT.code:
            return self.text(raw)
        if code == K.MEMO.code:
            return self.text(self.long_value(raw))
        if code == K.OLE.code:
            return self.long_value(raw)
        return raw

    def long_value(self, raw: bytes) -> bytes:
        """A long value: behind its head, in one row of another page, or in a chain of rows."""
        if len(raw) < 12:
            return b""
        size, pointer = struct.unpack_from("<II", raw)
        kind, size = size >> 24 & 0xC0, size & 0x3FFFFFFF
        if kind & 0x80:
            return raw[12 : 12 + size]
        if kind & 0x40:
            return self.pointed(pointer)[:size]
        out, seen = b"", set()
        while pointer and len(out) < size:
            if pointer in seen:
                raise PageError("long value runs in a circle")
            seen.add(pointer)
            part = self.pointed(pointer)
            (pointer,) = struct.unpack_from("<I", part)
            out += part[4:]
        return out[:size]

    def objects(self) -> list[dict[str, object]]:
        """Rows of the catalog: id, name, type, flags, and props (the raw property block)."""
        out = []
        for r in self.rows(self.table(CATALOG_PAGE)):
            low = {k.lower(): v for k, v in r.items()}
            out.append({"id": low.get("id") or 0, "name": low.get("name") or "", "type": (low.get("type") or 0) & 0x7F, "flags": (low.get("flags") or 0) & 0xFFFFFFFF, "props": low.get("lvprop")})
        return out

    def find(self, name: str) -> Table:
        return self.described(name)[0]

    def described(self, name: str) -> tuple[Table, dict[str, dict[str, str]]]:
        """A table by name, and its properties; capitals don't matter, an exact match goes first."""
        tables = [o for o in self.objects() if o["type"] == 1]
        found = [o for o in tables if o["name"] == name] or [o for o in tables if str(o["name"]).lower() == name.lower()]
        if not found:
            raise PageError(f"no table {name}")
        return self.table(int(found[0]["id"]) & 0xFFFFFF), self.properties(found[0]["props"])

    def properties(self, block: bytes | None) -> dict[str, dict[str, str]]:
        """Property blocks: the table's (under "") and each column's, name to text."""
        out: dict[str, dict[str, str]] = {}
        if not block or block[:4] not in (b"MR2\0", b"KKD\0"):
            return out
        names: list[str] = []
        at = 4
        while at + 6 <= len(block):
            size, kind = struct.unpack_from("<IH", block, at)
            part = block[at + 6 : at + max(6, size)]
            if kind == 0x80:
                p = 0
                while p + 2 <= len(part):
                    (n,) = struct.unpack_from("<H", part, p)
                    names.append(self._plain(part[p + 2 : p + 2 + n]))
                    p += 2 + n
            elif len(part) >= 6:
                length, n = struct.unpack_from("<IH", part)
                own = out.setdefault(self._plain(part[6 : 6 + n]) if kind else "", {})
                p = length
                while p + 8 <= len(part):
                    whole, _, code, which, n = struct.unpack_from("<HBBHH", part, p)
                    raw = part[p + 8 : p + 8 + n]
                    if which < len(names) and whole >= 8:
                        own[names[which]] = ("yes" if raw[:1] not in (b"", b"\0") else "no") if code == K.BOOLEAN.code else str(int.from_bytes(raw, "little", signed=True)) if code in (2, 3, 4) else self._plain(raw)
                    p += max(8, whole)
            at += max(6, size)
        return out

    def _plain(self, raw: bytes) -> str:
        return raw.decode("utf-16-le", "replace") if self.at is V4 else raw.decode(self.charset, "replace")


def _bits(data: bytes) -> Iterator[int]:
    for k, b in enumerate(data):
        if b:
            yield from (8 * k + j for j in range(8) if b >> j & 1)
