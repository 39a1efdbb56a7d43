"""Score a live table as it arrives."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabscore.models.score import score


def score_stream(
    model: PipelineModel,
    stream: DataFrame,
    sink: str,
    checkpoint: str,
    key: str = "t_id",
    out: str = "probability",
    available_now: bool = True,
) -> StreamingQuery:
    """Start a query that appends ``key, out`` parquet files to ``sink``.

    Scoring keeps no state, so the checkpoint holds source offsets only. A
    restart continues where the last run stopped.
    """
    writer = (
        score(model, stream, key, out)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(sink)
