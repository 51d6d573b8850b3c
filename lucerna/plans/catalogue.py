"""Every registered query of the evidence engine, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

from lucerna.plans import cached, captures, contracts, evidence, relational, reports, runs, search, state, transforms

QUERIES: dict = {**evidence.QUERIES, **contracts.QUERIES, **search.QUERIES, **state.QUERIES, **relational.QUERIES, **runs.QUERIES, **transforms.QUERIES, **cached.QUERIES, **captures.QUERIES, **reports.QUERIES}
ORACLE_SQL: dict = {**evidence.ORACLE_SQL, **contracts.ORACLE_SQL, **search.ORACLE_SQL, **state.ORACLE_SQL, **relational.ORACLE_SQL, **runs.ORACLE_SQL, **transforms.ORACLE_SQL, **cached.ORACLE_SQL, **captures.ORACLE_SQL, **reports.ORACLE_SQL}
