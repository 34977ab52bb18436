"""The registered queries `opN_<name>(spark, sf_dir)` and their DuckDB SQL."""

from functools import wraps

from ..runtime import ship

QUERIES, ORACLES = {}, {}


def prepare(spark) -> None:
    """Let the Python workers import this package, and bound their batches by bytes unless the session does."""
    ship(spark)


def query(name: str, sql: str | None = None):
    """Register a query under `name`; its Python workers can import this package."""

    def wrap(fn):
        @wraps(fn)
        def run(spark, sf):
            prepare(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
