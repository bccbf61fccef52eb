"""The queries of this subpackage, and their SQL where it can express them."""

from importlib import import_module

MODULES = ["shard_tree", "mixing", "media_png", "sstable", "exact_dedup", "packing", "simhash", "quality", "substring_dedup", "warc"]

QUERIES: dict = {}
ORACLE: dict = {}
for _name in MODULES:
    _module = import_module(f"deskdb.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
