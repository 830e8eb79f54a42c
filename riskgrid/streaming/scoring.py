"""Row-wise scoring of a stream of loans; the same expressions as on tables, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.scorecard import Model, probability, score


def scored_stream(loans: DataFrame, model: Model, scale: float = 1000.0) -> DataFrame:
    """A streaming DataFrame of loans with points, total and default probability."""
    return probability(score(loans, model, scale), model)


def write_scores(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows as Parquet as far as the source has them now; both folders must be shared by all executors."""
    return scored.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
