"""All queries of the core and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from itinera.plans import found, found_sql, graph_queries, io_queries, prep_queries, route_queries, stream_queries

QUERIES = {**found.QUERIES, **graph_queries.QUERIES, **prep_queries.QUERIES, **route_queries.QUERIES, **stream_queries.QUERIES, **io_queries.QUERIES}
SQL = {**found_sql.SQL, **graph_queries.SQL, **prep_queries.SQL, **route_queries.SQL, **stream_queries.SQL, **io_queries.SQL}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return graph_queries.aon_fan_out(spark, d)
