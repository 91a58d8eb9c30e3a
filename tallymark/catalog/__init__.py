"""Every registered query with the SQL that states the same result."""

from __future__ import annotations

from tallymark.catalog import evidence, features, files, proofs, rows, text

MODULES = (files, rows, evidence, text, features, proofs)


def all_queries() -> dict:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
