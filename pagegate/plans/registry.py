"""All registered queries and their SQL checks."""

from __future__ import annotations

from pagegate.plans import graph, histories, migration, misc, page_rules, site_audit, stores, streams, visuals

MODULES = (page_rules, site_audit, graph, migration, histories, visuals, misc, streams, stores)


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(m.queries())
    return out


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out.update(m.oracles())
    return out
