"""Finds the queries of the modules here: q_name(spark, sf_dir), with SQL_NAME beside it where SQL can say it."""

from __future__ import annotations

from . import animation_queries, chunk_queries, file_queries, pixel_queries

MODULES = (pixel_queries, chunk_queries, animation_queries, file_queries)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in vars(m).items() if name.startswith("q_")}


def oracle_sql() -> dict[str, str]:
    return {name: vars(m)[f"SQL_{name[2:].upper()}"] for m in MODULES for name in vars(m) if name.startswith("q_") and f"SQL_{name[2:].upper()}" in vars(m)}
