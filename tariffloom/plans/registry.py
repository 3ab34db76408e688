"""All queries of the plan modules and their SQL."""

from __future__ import annotations

from . import amendments, calls, containment, decisions, drafts, duty, extras, feeds, joins, layout, lookups, machines, masters, matching, merged, parsing, scalars, schedule, stores, workflow

MODULES = (duty, joins, amendments, calls, containment, layout, lookups, schedule, scalars, matching, merged, machines, workflow, parsing, stores, drafts, feeds, masters, decisions, extras)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
