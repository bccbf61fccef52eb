"""Sharding by a hierarchical weighted hash tree: regions, racks, shards.

At each level a document draws ln(u) / weight for every child, u in (0, 1) hashed from its key and the child's path, and
goes to the child with the largest draw. A child is so taken in proportion to its weight, and a draw changes only with the
child's own weight: a heavier child only gains documents, a lighter one only loses them, and below a node whose
weights stay nothing moves among its children.

Regions are laid out whole and never rebuilt; the slots of the last one that have no shard yet are vacant, and weigh as much as a shard. A document
that comes to a vacant slot draws again, up to ATTEMPTS times. Where it then comes to a whole region, or has no attempt left, it takes
what it would have without the last region. So one more shard, which fills a vacant slot or opens the next region, takes documents
only into itself, for every number of shards; and as the repeated draws make up for the vacant slots, each shard takes its share.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from deskdb.llm.common import documents, numbered, saved, text_of

#: Bits of a draw: 13 hex digits of an MD5 digest, exact in a double.
DRAW_DIGITS = 13
ATTEMPTS = 6


@dataclass(frozen=True)
class Node:
    """A region or rack with children, or a slot with its shard's number, -1 if it is vacant."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight

    @property
    def slots(self) -> list["Node"]:
        return [s for c in self.children for s in c.slots] if self.children else [self]

    @property
    def shards(self) -> list[int]:
        return [s.shard for s in self.slots if s.shard >= 0]

    @property
    def whole(self) -> bool:
        return all(s.shard >= 0 for s in self.slots)


def tree(n_shards: int, region_size: int = 8, rack_size: int = 4, weights: dict[int, float] | None = None) -> Node:
    """Shards 0 to ``n_shards`` - 1 in regions of racks, the last region filled as far as they go. ``weights`` overrides the weight 1 of some shards."""
    weights = weights or {}
    leaf = lambda s: Node(f"s{s}", (), s if s < n_shards else -1, float(weights.get(s, 1)) if s < n_shards else 1.0)
    regions = []
    for lo in range(0, n_shards, region_size):
        racks = [range(k, min(k + rack_size, lo + region_size)) for k in range(lo, lo + region_size, rack_size)]
        regions.append(Node(f"g{lo // region_size}", tuple(Node(f"k{k}", tuple(map(leaf, r))) for k, r in enumerate(racks))))
    return Node("root", tuple(regions))


def grow(root: Node, weight: float = 1.0) -> Node:
    """One more shard: in the first vacant slot, else in the first slot of a new region of the first one's shape."""
    new = max(root.shards, default=-1) + 1
    if root.whole:
        at = len(root.slots)

        def vacant(node: Node) -> Node:
            nonlocal at
            if node.children:
                return replace(node, children=tuple(map(vacant, node.children)))
            at += 1
            return Node(f"s{at - 1}")

        root = replace(root, children=(*root.children, replace(vacant(root.children[0]), name=f"g{len(root.children)}")))
    slot = next(s.name for s in root.slots if s.shard < 0)

    def filled(node: Node) -> Node:
        if node.children:
            return replace(node, children=tuple(map(filled, node.children)))
        return replace(node, shard=new, own_weight=float(weight)) if node.name == slot else node

    return filled(root)


#: What a walk may end with besides a shard (which is -3 - shard): a region that is whole, at a later attempt; a vacant slot.
WHOLE, VACANT = -1, -2


def _bound(value: str, use: Callable[[str], str], name: str) -> str:
    """SQL of ``use(name)``, with ``name`` the value, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {use(name)}), 1)"


def _walk(key: str, root: Node, prefix: str, cut: Callable[[Node], int | None] = lambda node: None) -> str:
    """SQL of what a key comes to below ``root``, a level at a time; ``cut`` may end walks at a node. Children of weight 0 are never drawn."""
    table: list[str] = []
    depth = 0

    def number(node: Node, path: str, level: int) -> int:
        nonlocal depth
        if (end := cut(node)) is not None:
            return end
        if not node.children:
            return -3 - node.shard if node.shard >= 0 else VACANT
        depth, own = max(depth, level + 1), len(table)
        table.append("")
        rows = [(f"{path}/{c.name}", c.weight, number(c, f"{path}/{c.name}", level + 1)) for c in node.children if c.weight > 0]
        if not rows:
            raise ValueError(f"no child of {node.name} has weight")
        table[own] = f"array({', '.join(f"struct('{p}' AS path, {float(w)!r}D AS weight, {n} AS node)" for p, w, n in rows)})"
        return own

    number(root, prefix, 0)
    children = f"array({', '.join(table)})"  # a constant
    digits = f"substring(md5(cast(concat({key}, c.path) AS binary)), 1, {DRAW_DIGITS})"
    draw = f"ln((cast(conv({digits}, 16, 10) AS double) + 0.5D) / {float(16**DRAW_DIGITS)!r}D) / c.weight"
    step = lambda node: f"array_max(transform(element_at({children}, {node} + 1), (c, k) -> struct({draw} AS d, -k AS k, c.node AS node))).node"
    at = step("0")
    for level in range(1, depth):
        at = _bound(at, lambda node: f"CASE WHEN {node} >= 0 THEN {step(node)} ELSE {node} END", f"n{level}")
    return at


def place(key: str, root: Node) -> Column:
    """The shard of a string key, an SQL expression. The whole placement is one parsed text over constant tables."""
    if not sum(s.weight for s in root.slots if s.shard >= 0):
        raise ValueError(f"no shard of {root.name} has weight")
    found = _walk(key, root, "")
    if not root.whole:
        later = lambda node: WHOLE if node in root.children and node.whole else None
        or_else = lambda end, other, name: _bound(end, lambda x: f"CASE WHEN {x} = {VACANT} THEN {other} ELSE {x} END", name)
        beyond = str(VACANT)
        for attempt in range(ATTEMPTS - 1, 0, -1):
            beyond = or_else(_walk(key, root, f"#{attempt}", later), beyond, f"x{attempt}")
        without = replace(root, children=tuple(c for c in root.children if c.whole and c.weight > 0))
        rest = _walk(key, without, "") if without.children else str(-3 - min(s.shard for s in root.slots if s.shard >= 0 and s.weight > 0))
        found = _bound(or_else(found, beyond, "x0"), lambda x: f"CASE WHEN {x} > -3 THEN {rest} ELSE {x} END", "y")
    return F.expr(f"-3 - {found}")


def shard_documents(docs: DataFrame, root: Node, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``.

    The law is ``key``: doc_id and the tree alone decide. size is the text's UTF-8 bytes plus 8, of a text of any length. Null texts count as empty (CRC 0);
    a null doc_id is a key of its own. Rows with one doc_id share a shard and get slots of their own. Slots number a shard's
    rows without gaps by doc_id, size and CRC; a hot shard or doc_id is cut over tasks (see ``numbered``). An empty table gives an empty result. Other columns are ignored.
    """
    key = "coalesce(cast(doc_id AS string), 'null')"
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_of(text)) + 8).cast("long").alias("size"),
        F.crc32(text_of(text).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, root).cast("int").alias("shard"),
        place(key, grow(root)).cast("int").alias("grown_shard"),
    )
    rows = numbered(saved(rows, "sharded"), "shard", ["doc_id", "size", "text_crc32"], "slot")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir), tree(24))


def _sql() -> str:
    """The same draws in SQL: for each level the largest draw among the children of what was drawn above; b0, b1, ... are the attempts in the grown tree."""
    old, new = tree(24), grow(tree(24))
    nodes = []  # (walk, level, parent path, path, weight, what it comes to, rank)

    def walk(name: str, node: Node, path: str, level: int, later: bool) -> None:
        for k, c in enumerate(node.children):
            ends = WHOLE if later and level == 0 and c.whole else None if c.children else -3 - c.shard if c.shard >= 0 else VACANT
            nodes.append(f"('{name}', {level}, '{path}', '{path}/{c.name}', {c.weight!r}, {'NULL' if ends is None else ends}, {k})")
            if ends is None:
                walk(name, c, f"{path}/{c.name}", level + 1, later)

    tops = {"a": (old, ""), **{f"b{k}": (new, f"#{k}" if k else "") for k in range(ATTEMPTS)}}
    for name, (root, prefix) in tops.items():
        walk(name, root, prefix, 0, name not in ("a", "b0"))
    step = lambda level, above: f"""
  l{level} AS (
    SELECT rid, walk, arg_max(path, (draw, -k)) AS path, arg_max(ends, (draw, -k)) AS ends FROM (
      SELECT u.rid, n.walk, n.path, n.k, coalesce(n.ends, -99) AS ends, ln((('0x' || substr(md5(u.key || n.path), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / n.weight AS draw
      FROM {above} p JOIN t u USING (rid) JOIN n ON n.level = {level} AND n.parent = p.path AND n.walk = p.walk {'WHERE p.ends = -99' if level else ''}
    ) GROUP BY rid, walk
  )"""  # noqa: E731
    later = " ".join(f"WHEN b{k} <> {VACANT} THEN b{k}" for k in range(ATTEMPTS))
    return f"""
WITH RECURSIVE n(walk, level, parent, path, weight, ends, k) AS (VALUES {', '.join(nodes)}),
  t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, 'null') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
  top AS (SELECT rid, walk, path FROM t, (VALUES {', '.join(f"('{name}', '{prefix}')" for name, (_, prefix) in tops.items())}) x(walk, path)),{step(0, 'top')},{step(1, 'l0')},{step(2, 'l1')},
  ends AS (SELECT rid, walk, ends FROM l0 WHERE ends <> -99 UNION ALL SELECT rid, walk, ends FROM l1 WHERE ends <> -99 UNION ALL SELECT rid, walk, ends FROM l2),
  wide AS (SELECT rid, {', '.join(f"max(ends) FILTER (WHERE walk = '{name}') AS {name}" for name in tops)} FROM ends GROUP BY rid),
  bits(b, step, c) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8),
  crc AS (SELECT list(c ORDER BY b) AS tab FROM bits WHERE step = 8),
  sums AS (
    SELECT rid, doc_id, length(h) // 2 + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda x, y: xor(x >> 8, tab[(xor(x, y) & 255) + 1])), 4294967295) AS text_crc32
    FROM t, crc
  ),
  put AS (SELECT rid, -3 - a AS shard, CASE {later} ELSE {VACANT} END AS g, a FROM wide)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, -3 - CASE WHEN g > -3 THEN a ELSE g END AS grown_shard
FROM sums JOIN put USING (rid)
"""


QUERIES = {"op1_sharding": op1_sharding}
ORACLE = {"op1_sharding": _sql()}
