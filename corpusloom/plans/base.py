"""Where queries are entered: name -> (callable(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

REGISTRY: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = (f, sql)
        return f

    return add
