"""Where queries and their SQL are registered."""

from collections.abc import Callable

from plumbline.sources.tables import table
from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers f(t), where t(name) reads a table, under a key of the operator inventory."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(lambda table_name: table(spark, sf_dir, table_name))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add
