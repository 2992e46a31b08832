"""SQL that states each registered query a second time, for DuckDB."""

import importlib

ORACLE_MODULES = ["filings", "quality", "prices", "scores", "research", "sources", "workspace", "automation", "delivery", "pages", "stored"]


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in ORACLE_MODULES:
        out.update(importlib.import_module(f"oracles.{name}").build())
    return out
