"""All queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import queries as q


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p4_found": q.p4_found, "p4_ledger": q.p4_ledger, "p6_sequences": q.p6_sequences, "p6_fill": q.p6_fill, "p6_budgeted": q.p6_budgeted, "p6_constraints": q.p6_constraints, "p7_found": q.p7_found, "p7_scores": q.p7_scores,
        "p8_found": q.p8_found, "p8_segments": q.p8_segments, "p8_documents": q.p8_documents, "p8_calibration": q.p8_calibration,
    }


def oracle_sql() -> dict[str, str]:
    return {}
