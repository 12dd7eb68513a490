"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from leadloom.queries import leads, more, processing, shops, streams, texts

MODULES = (processing, leads, shops, texts, streams, more)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
