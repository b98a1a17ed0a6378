"""All core queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import data_oracles, data_queries, lineage_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "p1_found": data_queries.p1_found,
        "p2_found": data_queries.p2_found,
        "p2_descendants": data_queries.p2_descendants,
        "p3_found": data_queries.p3_found,
        "p5_found": data_queries.p5_found,
        "p1_values": data_queries.p1_values,
        "p3_tables": data_queries.p3_tables,
        "p3_columns": data_queries.p3_columns,
        "p5_history": data_queries.p5_history,
    }
    return found | lineage_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return data_oracles.ORACLES | lineage_queries.ORACLES | {
        "p3_found": lineage_queries.P3_FOUND,
        "p3_tables": lineage_queries.P3_TABLES,
        "p3_columns": lineage_queries.P3_COLUMNS,
    }
