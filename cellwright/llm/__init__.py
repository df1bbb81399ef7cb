"""Operators for training-data pipelines. Nothing outside this package imports it but the entry module."""

from importlib import import_module

_MODULES = ("line_dedup", "fingerprints", "sharding", "bpe", "packing", "toxicity", "jaccard", "neighbours", "langid", "substring_dedup", "licenses", "lexical", "conversations")
_loaded = [import_module(f"cellwright.llm.{name}") for name in _MODULES]
QUERIES = {name: query for module in _loaded for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _loaded for name, sql in module.ORACLE.items()}
