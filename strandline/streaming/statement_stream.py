"""Analysing statements as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.analysis import analyze
from strandline.sources.statements import statements


def analyze_stream(requests: DataFrame, columns_by_name: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write the result of every arriving statement under ``out``, one folder per micro-batch.

    The analysis keeps no state between statements, so each micro-batch goes through the batch operators.
    A batch that is run again after a failure overwrites its own folder: results come out exactly once.
    The catalog is read anew for every batch.  ``once`` ends after what is there already.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        analyze(statements(batch), columns_by_name).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (query.trigger(availableNow=True) if once else query).start()
