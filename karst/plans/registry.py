"""Registered queries: a function of (spark, sf_dir), and the SQL that must give the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from karst.sources.tables import CHUNKS, DOCUMENTS, EDGES, GRANTS, LOGS, MESSAGES, RUNS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: What a derived table's SQL needs before it.
_TABLES = {"kb_documents": (DOCUMENTS,), "kb_chunks": (CHUNKS,), "kb_grants": (DOCUMENTS, GRANTS), "kb_edges": (EDGES,), "kb_logs": (LOGS,), "kb_messages": (LOGS, MESSAGES), "kb_runs": (DOCUMENTS, RUNS)}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query. Its SQL may use the derived tables by name; `WITH` is added, so it begins with SELECT or with
    further tables (`t AS (...)`)."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            parts = list(dict.fromkeys(p for t, ps in _TABLES.items() if t in sql for p in ps))
            body = sql.strip()
            if body.upper().startswith(("SELECT", "(")):
                SQL[name] = (f"WITH {', '.join(parts)} " if parts else "") + body
            else:
                recursive = body.upper().startswith("RECURSIVE ")
                body = body[10:] if recursive else body
                SQL[name] = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([*parts, body])}"
        return f

    return put
