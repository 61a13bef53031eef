"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.plans.views import VIEWS_SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "per_clinic_table"


def query(sql: str | None = None) -> Callable:
    """Registers a function of Views under its name; sql may read the canonical views' names."""

    def register(f: Callable[[Views], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            used = [f"{name} as ({text})" for name, text in VIEWS_SQL.items() if name in sql or any(name in VIEWS_SQL[x] and x in sql for x in VIEWS_SQL)]
            body = sql.strip()
            head = "with recursive " if body.lower().startswith("with recursive") else "with "
            body = body[len("with recursive") :] if body.lower().startswith("with recursive") else body[len("with") :] if body.lower().startswith("with ") else None
            ORACLE_SQL[f.__name__] = f"{head}{', '.join(used)}{', ' if used else ''}{body}" if body is not None else f"{'with ' + ', '.join(used) if used else ''} {sql}"
        return f

    return register


from assayer.plans import catalogue, designs, extensions, imaging, streams, studies  # noqa: E402, F401  fills the tables above
