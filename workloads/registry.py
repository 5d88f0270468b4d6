"""All queries by name."""

from __future__ import annotations

from workloads import checking, conversion, drift, journal, metadata, moving, scripts, text_rules, typing_rules
from workloads.base import Query

QUERIES: dict[str, Query] = {}
for _module in (conversion, typing_rules, text_rules, drift, moving, checking, scripts, metadata, journal):
    for _name, _query in _module.QUERIES.items():
        if _name in QUERIES:
            raise ValueError(f"two queries are named {_name}")
        QUERIES[_name] = _query
