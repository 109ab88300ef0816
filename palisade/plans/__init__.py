"""All queries of the draft domain, by name, with the SQL of those that SQL can express."""

from importlib import import_module

QUERIES: dict = {}
SQL: dict = {}
for _name in ("scalars", "profiles", "drafts", "evaluation", "training", "ranker", "retrieval", "ingest", "state"):
    _module = import_module(f"{__name__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
