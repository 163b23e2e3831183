"""Rows of a Spark query and of its SQL in DuckDB, in a form that can be compared."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(columns: list[str], rows: list[tuple]) -> list[str]:
    """Rows as sorted strings, columns by name, doubles to nine digits."""
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def cell(value) -> str:
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "null"
        return f"{value:.9g}" if isinstance(value, float) else str(value)

    return sorted("|".join(cell(row[k]) for k in order) for row in rows)
