"""Syntax trees."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Name:
    text: str


@dataclass(frozen=True)
class Literal:
    """value: int, float, str, or a datetime from strptime(). text: as it was written."""

    value: object
    text: str = ""


@dataclass(frozen=True)
class Compare:
    """op: = <> < <= > >= LIKE ILIKE; left is a Name, right a Literal, once the parser has put them in order."""

    op: str
    left: object
    right: object


@dataclass(frozen=True)
class IsNull:
    name: Name
    negated: bool = False


@dataclass(frozen=True)
class And:
    left: object
    right: object


@dataclass(frozen=True)
class Or:
    left: object
    right: object


@dataclass(frozen=True)
class Not:
    of: object


@dataclass(frozen=True)
class Select:
    """columns: names as typed; ["*"] for all, None for COUNT(*). limit: rows or, if percent, hundredths of the table's rows."""

    columns: tuple[str, ...] | None
    table: str
    where: object | None = None
    limit: int | None = None
    percent: bool = False


@dataclass(frozen=True)
class ListTables:
    pass


@dataclass(frozen=True)
class Describe:
    table: str


@dataclass(frozen=True)
class Connect:
    path: str


@dataclass(frozen=True)
class Disconnect:
    pass


def walk(node: object):
    """Every node of a predicate, parents first."""
    yield node
    for part in ("left", "right", "of", "name"):
        child = getattr(node, part, None)
        if child is not None:
            yield from walk(child)
