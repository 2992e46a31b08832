"""Jobs built from the operators, and the queries registered for the driver."""

import importlib

# Modules that define QUERIES, in the order they are listed.
QUERY_MODULES = ["filing_queries", "quality_queries", "price_queries", "score_queries", "research_queries", "source_queries", "workspace_queries", "automation_queries", "delivery_queries", "page_queries", "stored_queries"]


def all_queries() -> dict:
    out: dict = {}
    for name in QUERY_MODULES:
        found = importlib.import_module(f"tidemark.plans.{name}").QUERIES
        clash = out.keys() & found.keys()
        if clash:
            raise ValueError(f"query names defined twice: {sorted(clash)}")
        out.update(found)
    return out
