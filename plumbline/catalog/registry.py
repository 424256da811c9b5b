"""Registered queries: a Spark job over the given tables and, where SQL can say it, the SQL for the same rows."""

from pyspark.sql import DataFrame, SparkSession

from plumbline.sources import views

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register ``fn(tables)``; ``uses`` names the views its SQL reads."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(views.Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = views.with_views(uses.split(), sql)
        return fn

    return register
