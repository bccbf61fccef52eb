"""CREATE scripts: tables, indexes and relationships of a database in a dialect. Metadata only; no rows are read."""

from __future__ import annotations

from pyspark.sql import Row, types as T

from deskdb import types as K
from deskdb.catalog import Database
from deskdb.render import dialects as D

#: What is written unless told otherwise.
USUAL = frozenset({D.NOT_NULL, D.COMMENTS, D.INDEXES, D.RELATIONS})
UNIQUE = 0x01
PRIMARY, REFERENCE = 1, 2
# Bits of a relationship.
NOT_ENFORCED, UPDATE_CASCADES, DELETE_CASCADES = 0x2, 0x100, 0x1000


def _text(value: str) -> str:
    return D.quoted(value, "'")


def column_type(f: T.StructField, d: D.Dialect) -> str:
    kind, size = K.kind_of(f), K.size_of(f)
    auto = kind == K.LONG and str((f.metadata or {}).get("autonumber", "")).lower() in ("true", "1", "yes")
    name = d.type_of(kind, kind == K.DATETIME and K.is_short_date(f), auto)
    if not name.takes:
        return name.name
    precision, scale = K.precision_of(f)
    if size == 0:
        return f"{name.name} (255)"
    if name.takes == "PS" and precision:
        return f"{name.name} ({precision}, {scale})"
    return f"{name.name} ({size // 2 if name.takes == 'C' else size})"


def default_value(said: str, short: bool, d: D.Dialect) -> str:
    """A DefaultValue property as SQL."""
    if len(said) >= 2 and said[0] == said[-1] == '"':
        return _text(said[1:-1])
    if said in ("Yes", "No"):
        return "TRUE" if said == "Yes" else "FALSE"
    if said.lower() == "date()":
        return d.short_now if short else d.long_now
    return said


def column_line(f: T.StructField, d: D.Dialect, options: frozenset[str]) -> str:
    props, kind = f.metadata or {}, K.kind_of(f)
    line = f"\t{d.identifier(f.name)}\t\t\t{column_type(f, d)}"
    if D.NOT_NULL in options and (kind == K.BOOLEAN or str(props.get("Required", "")).startswith("y")):
        line += " NOT NULL"
    if D.DEFAULTS in options:
        if "DefaultValue" in props:
            line += f" DEFAULT {default_value(str(props['DefaultValue']), K.is_short_date(f), d)}"
        elif kind == K.BOOLEAN:
            line += " DEFAULT FALSE"
    return line


def index_name(d: D.Dialect, table: str, index: Row) -> str:
    if d.name == "mysql":
        return "_pkey" if index["index_type"] == PRIMARY else index["name"]
    return f"{table}_pkey" if index["index_type"] == PRIMARY else f"{table}_{index['name']}_idx"


def index_lines(d: D.Dialect, table: str, found: list[Row], namespace: str | None) -> list[str]:
    if D.INDEXES not in d.can:
        return [f"-- Indexes are not implemented for {d.name}", ""]
    out, on = ["-- CREATE INDEXES ..."], d.identifier(table, namespace)
    for x in found:
        primary = x["index_type"] == PRIMARY
        if x["index_type"] == REFERENCE or primary and d.name == "sqlite":
            continue
        name = d.identifier(index_name(d, table, x), namespace if d.namespaced_keys else None)
        if not x["keys"]:
            out.append(f"-- WARNING: found no keys for index {name} - ignored")
            continue
        keys = ", ".join(d.identifier(k["col"]) + " DESC" * bool(k["desc"] and not primary) for k in x["keys"])
        unique = " UNIQUE" * bool((x["flags"] or 0) & UNIQUE)
        if primary:
            out.append(f"ALTER TABLE {on} ADD PRIMARY KEY ({keys});" if d.name == "mysql" else f"ALTER TABLE {on} ADD CONSTRAINT {name} PRIMARY KEY ({keys});")
        elif d.name == "mysql":
            out.append(f"ALTER TABLE {on} ADD{unique} INDEX {name} ({keys});")
        else:
            out.append(f"CREATE{unique} INDEX {name} ON {on} ({keys});")
    return [*out, ""]


def relation_line(d: D.Dialect, r: Row, namespace: str | None) -> str:
    own = namespace if d.namespaced_keys else None
    one, two = d.quote(namespace, r["szObject"]), d.quote(namespace, r["szReferencedObject"])
    one, two = (x.lower() if d.lower else x for x in (one, two))
    here, there = d.identifier(r["szColumn"], own), d.identifier(r["szReferencedColumn"], own)
    bits = r["grbit"] or 0
    if bits & NOT_ENFORCED:
        return f"-- Relationship from {one} ({here}) to {two}({there}) does not enforce integrity."
    line = f"ALTER TABLE {one} ADD CONSTRAINT {d.identifier(r['szObject'] + '_' + r['szColumn'] + '_fk', own)} FOREIGN KEY ({here}) REFERENCES {two}({there})"
    if bits & UPDATE_CASCADES and d.name != "oracle":
        line += " ON UPDATE CASCADE"
    if bits & DELETE_CASCADES:
        line += " ON DELETE CASCADE"
    return line + " DEFERRABLE INITIALLY IMMEDIATE" * (d.name == "postgres") + ";"


def table_lines(db: Database, table: str, d: D.Dialect, options: frozenset[str], namespace: str | None = None) -> list[str]:
    own, schema = db.find(table), db.schema(table)
    name, out = d.identifier(own, namespace), []
    found = sorted(db.side("indexes").filter(f"table = '{own.replace(chr(39), chr(39) * 2)}'").collect(), key=lambda r: r["name"]) if D.INDEXES in options else []
    if D.DROP in options:
        out.append(d.drop.format(name))
    out += (d.create.format(name) + " (").split("\n")
    columns = [column_line(f, d, options) for f in schema]
    out += [c + ", " for c in columns[:-1]] + columns[-1:]
    if d.name == "sqlite":
        out += [f"\t, PRIMARY KEY ({', '.join(d.identifier(k['col']) for k in x['keys'])})" for x in found if x["index_type"] == PRIMARY and x["keys"]]
    out.append(");")
    for f in schema:
        props = f.metadata or {}
        if D.NOT_EMPTY in options and d.check and str(props.get("AllowZeroLength", "")).startswith("n"):
            out.append(d.check.format(name, d.identifier(f.name)))
        if D.COMMENTS in options and d.column_comment and props.get("Description"):
            out.append(d.column_comment.format(name, d.identifier(f.name), _text(str(props["Description"]))))
    about = db.table_properties(own).get("Description") if D.COMMENTS in options and d.table_comment else None
    if about:
        out.append(d.table_comment.format(name, _text(about)))
    out.append("")
    if D.INDEXES in options:
        out += index_lines(d, own, found, namespace)
    return out


def schema_lines(db: Database, dialect: str, table: str | None = None, namespace: str | None = None, options: frozenset[str] | set[str] = USUAL, charset: str | None = "UTF-8") -> list[str]:
    """The script's lines. ``options`` that the dialect lacks are passed over."""
    d = D.dialect(dialect)
    options = frozenset(options) & d.can
    out = ["-- Schema written by deskdb", ""]
    if charset:
        out += [d.charset.format(charset), ""]
    if table is not None:
        names = [db.find(table)]
    elif db.has_side("objects"):
        names = [r["name"] for r in db.objects().filter("type = 1 and not is_system").orderBy("id").collect()]
    else:
        names = db.names()
    for n in names:
        out += table_lines(db, n, d, options, namespace)
    out.append("")
    if D.RELATIONS in options:
        out.append("-- CREATE Relationships ...")
        found = db.side("relationships").collect()  # one row a relationship
        found = [r for r in found if table is None or r["szObject"] == db.find(table)]
        out += [relation_line(d, r, namespace) for r in found]
    return out


def schema_text(db: Database, dialect: str, **how) -> str:
    return "\n".join(schema_lines(db, dialect, **how)) + "\n"
