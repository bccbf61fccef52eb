"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from deskdb.errors import ParseError

KEYWORDS = frozenset("select from where and or not like ilike is null top percent limit count strptime connect disconnect to list tables describe table".split())

_TOKEN = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<number>[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<string>'(?:[^']|'')*')
  | (?P<quoted>"(?:[^"]|"")*")
  | (?P<bracket>\[[^\]]*\])
  | (?P<word>[A-Za-z_\xa0-\U0010ffff][\w\#@$\xa0-\U0010ffff]*)
  | (?P<op><=|>=|<>|=|<|>|\(|\)|,|\*|;)
    """,
    re.X,
)


@dataclass(frozen=True)
class Token:
    """kind: keyword, name, int, float, string, op or end."""

    kind: str
    value: object
    at: int
    text: str = ""


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParseError(f"can't read {sql[at:at + 20]!r} at {at}")
        kind, text = m.lastgroup, m[0]
        if kind == "number":
            whole = re.fullmatch(r"[+-]?\d+", text)
            out.append(Token("int" if whole else "float", int(text) if whole else float(text), at, text))
        elif kind == "string":
            out.append(Token("string", text[1:-1].replace("''", "'"), at, text))
        elif kind == "quoted":
            out.append(Token("name", text[1:-1].replace('""', '"'), at, text))
        elif kind == "bracket":
            out.append(Token("name", text[1:-1], at, text))
        elif kind == "word":
            low = text.lower()
            out.append(Token("keyword", low, at, text) if low in KEYWORDS else Token("name", text, at, text))
        elif kind == "op":
            out.append(Token("op", text, at, text))
        at = m.end()
    return [*out, Token("end", None, len(sql))]


def statements(script: str) -> list[str]:
    """A script's statements, ended by ``;`` or a line that says only ``go``. Quotes and brackets may hold either."""
    out, start, at = [], 0, 0
    hidden = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\[[^\]]*\]")
    ends = re.compile(r";|(?im:^[ \t]*go[ \t]*$)")
    while at < len(script):
        h, e = hidden.search(script, at), ends.search(script, at)
        if e and (not h or e.start() < h.start()):
            out.append(script[start : e.start()])
            start = at = e.end()
        elif h:
            at = h.end()
        else:
            break
    return [s for s in (x.strip() for x in [*out, script[start:]]) if s]


def strip_escapes(sql: str) -> str:
    """``{d '2020-01-01'}`` and its like, outside of quotes and brackets, to what stands in the braces."""
    parts = re.split(r"('(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\[[^\]]*\])", sql)
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"\{\s*(?:[A-Za-z]+\b)?|\}", "", parts[k])
    return "".join(parts)
