"""Genotype calling on a stream of calls (an extension): each micro-batch holds whole samples and is called against a fixed scheme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import allowed_bases, call_genotypes


def stream_genotypes(calls: DataFrame, rules: DataFrame, out: str, checkpoint: str, max_dist: float = 0.0, once: bool = False) -> StreamingQuery:
    """Calls every micro-batch's samples and appends sample_id, genotypes and dist to a Parquet folder."""
    allowed = allowed_bases(rules)

    def batch(df: DataFrame, number: int) -> None:
        found = call_genotypes(df.join(rules.select("pos").distinct(), "pos", "left_semi"), allowed, df.select("sample_id").distinct(), max_dist)
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")  # a repeated batch overwrites itself

    writer = calls.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
