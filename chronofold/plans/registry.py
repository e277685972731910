"""Every query of the engine by name, with the DuckDB text it is checked against."""

from __future__ import annotations

from . import contexts, domains, encoding, features, graphs, scoring

GROUPS = (features, domains, encoding, graphs, contexts, scoring)
FLAGSHIP = "pit_customer_churn_features"
QUERIES = {name: query for group in GROUPS for name, (query, _) in group.QUERIES.items()}
ORACLES = {name: sql for group in GROUPS for name, (_, sql) in group.QUERIES.items() if sql}
