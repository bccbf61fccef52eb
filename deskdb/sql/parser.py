"""From text to syntax trees."""

from __future__ import annotations

import re
from datetime import datetime

from deskdb.errors import ParseError
from deskdb.sql import nodes as N
from deskdb.sql.tokens import Token, tokens

COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")
MIRROR = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}


def truncated(value: object) -> int:
    """A number's leading whole part."""
    return int(value) if isinstance(value, (int, float)) else 0


def fold(op: str, a: object, b: object) -> bool:
    """A comparison of two constants: texts by code points, numbers by their whole parts."""
    if isinstance(a, datetime) and isinstance(b, datetime):
        pass
    elif isinstance(a, str) and isinstance(b, str):
        if op in ("LIKE", "ILIKE"):
            if op == "ILIKE":  # by lower case, as for columns
                a, b = a.lower(), b.lower()
            pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in b)
            return re.fullmatch(pattern, a, re.S) is not None
    elif isinstance(a, (int, float)) and isinstance(b, (int, float)) and op in COMPARISONS:
        a, b = truncated(a), truncated(b)
    else:
        raise ParseError(f"can't compare {a!r} {op} {b!r}")
    if op not in COMPARISONS:
        raise ParseError(f"{op} takes texts")
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def parse_strptime(text: str, pattern: str) -> datetime:
    """strptime() of literals. Without a date in the pattern the time is of the day 1899-12-30."""
    try:
        found = datetime.strptime(text, pattern)
    except ValueError as e:
        raise ParseError(f"strptime: {e}") from e
    if not re.search(r"%[aAbBcdDeFgGhjmuUVwWxyY]", pattern.replace("%%", "")):
        found = found.replace(year=1899, month=12, day=30)
    return found


class Parser:
    def __init__(self, sql: str) -> None:
        self.tokens, self.at = tokens(sql), 0

    @property
    def token(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str):
        raise ParseError(f"expected {wanted}, found {self.token.text or 'the end'!r} at {self.token.at}")

    def take(self, kind: str, *values: object) -> Token | None:
        if self.token.kind == kind and (not values or self.token.value in values):
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def need(self, kind: str, *values: object) -> Token:
        return self.take(kind, *values) or self.fail(" or ".join(map(str, values)) or kind)

    def name(self) -> str:
        """An identifier; keywords that can't begin a clause here may serve as names."""
        t = self.take("name") or self.take("keyword", "count", "tables", "table", "list", "to", "percent", "top", "strptime")
        return str(t.text if t.kind == "keyword" else t.value) if t else self.fail("a name")

    def statement(self):
        if self.take("keyword", "select"):
            made = self.select()
        elif self.take("keyword", "list"):
            self.need("keyword", "tables")
            made = N.ListTables()
        elif self.take("keyword", "describe"):
            self.need("keyword", "table")
            made = N.Describe(self.name())
        elif self.take("keyword", "connect"):
            self.need("keyword", "to")
            rest = self.tokens[self.at]
            made = N.Connect(self.path(rest))
        elif self.take("keyword", "disconnect"):
            made = N.Disconnect()
        else:
            self.fail("a statement")
        self.take("op", ";")
        if self.token.kind != "end":
            self.fail("the end")
        return made

    def path(self, first: Token) -> str:
        t = self.take("string") or self.take("name") or self.fail("a path")
        return str(t.value)

    def select(self) -> N.Select:
        limit, percent = None, False
        if self.token.kind == "keyword" and self.token.value == "top" and self.tokens[self.at + 1].kind in ("int", "float"):
            self.at += 1
            limit = self.need("int", *([self.token.value] if self.token.kind == "int" else ["a whole number"])).value
            if self.take("keyword", "percent"):
                percent = True
                if not 0 <= limit <= 100:
                    raise ParseError("TOP n PERCENT takes 0 to 100")
        columns = self.columns()
        self.need("keyword", "from")
        table, where = self.name(), None
        if self.take("keyword", "where"):
            where = self.either()
        if self.take("keyword", "limit"):
            if limit is not None:
                raise ParseError("TOP and LIMIT can't stand together")
            limit = self.need("int").value
        return N.Select(columns, table, where, limit, percent)

    def columns(self) -> tuple[str, ...] | None:
        if self.take("op", "*"):
            return ("*",)
        ahead = self.tokens[self.at : self.at + 4]
        if len(ahead) == 4 and ahead[0].kind == "keyword" and [t.value for t in ahead] == ["count", "(", "*", ")"]:
            self.at += 4
            return None
        found = [self.name()]
        while self.take("op", ","):
            found.append(self.name())
        return tuple(found)

    def either(self):
        node = self.both()
        while self.take("keyword", "or"):
            node = N.Or(node, self.both())
        return node

    def both(self):
        node = self.unary()
        while self.take("keyword", "and"):
            node = N.And(node, self.unary())
        return node

    def unary(self):
        if self.take("keyword", "not"):
            return N.Not(self.unary())
        if self.take("op", "("):
            node = self.either()
            self.need("op", ")")
            return node
        return self.comparison()

    def operand(self):
        t = self.take("int") or self.take("float") or self.take("string")
        if t:
            return N.Literal(t.value, t.text)
        if self.token.kind == "keyword" and self.token.value == "strptime" and self.tokens[self.at + 1].value == "(":
            self.at += 2
            data = self.need("string")
            self.need("op", ",")
            pattern = self.need("string")
            self.need("op", ")")
            return N.Literal(parse_strptime(str(data.value), str(pattern.value)), data.text)
        return N.Name(self.name())

    def comparison(self):
        left = self.operand()
        if self.take("keyword", "is"):
            negated = bool(self.take("keyword", "not"))
            self.need("keyword", "null")
            if isinstance(left, N.Literal):
                raise ParseError("IS NULL takes a column")
            return N.IsNull(left, negated)
        word = self.take("keyword", "like", "ilike")
        op = str(word.value).upper() if word else str(self.need("op", *COMPARISONS).value)
        right = self.operand()
        if isinstance(left, N.Name) and isinstance(right, N.Name):
            raise ParseError("two columns can't be compared")
        if isinstance(left, N.Literal) and isinstance(right, N.Literal):
            return N.Literal(fold(op, left.value, right.value), f"{left.text} {op} {right.text}")
        if isinstance(left, N.Literal):
            if word:
                raise ParseError(f"{op} takes a column at its left")
            left, right, op = right, left, MIRROR.get(op, op)
        return N.Compare(op, left, right)


def parse(sql: str):
    return Parser(sql).statement()
