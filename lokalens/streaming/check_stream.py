"""An extension: the check of pairs as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.findings import string_findings


def stream_findings(pairs: DataFrame, path: str, checkpoint: str, glossary: list[str] | None = None) -> StreamingQuery:
    """Write the string findings of a stream of pairs (lang, key, ord, src, tgt) as Parquet. Each micro-batch has its own folder, so one that runs again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        string_findings(batch, glossary).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
