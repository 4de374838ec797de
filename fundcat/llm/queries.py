"""Queries of this subpackage for ``__spark_entry__.py``."""

from fundcat.llm import ann, fim, licenses, mixing, packing, pieces, quality, repair, runs, sharding, simhash, token_counts, toxicity

_MODULES = (simhash, sharding, repair, pieces, toxicity, token_counts, licenses, mixing, ann, quality, packing, fim, runs)


def queries() -> dict:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
