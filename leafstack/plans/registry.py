"""Named queries with their DuckDB counterparts."""

from functools import wraps

from ..runtime import ship

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with the SQL that must give the same rows."""

    def wrap(fn):
        if name in QUERIES:
            raise KeyError(name)

        @wraps(fn)
        def run(spark, sf):
            ship(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
