"""Point-wise quality from criterion replies to the leaderboard."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gradeloom.operators import scores as S
from gradeloom.session import cut


def quality_board(criteria: DataFrame, replies: DataFrame, raw_weights: DataFrame) -> DataFrame:
    """Leaderboard with mean total, entry count and mean of the query-specific dimensions."""
    # three summaries read the dimension scores, and the totals divide the weights' scale out again
    dims = cut(S.complete_dimension_score(criteria, replies))
    totals = cut(S.total_score(dims, raw_weights.withColumnRenamed("raw_weight", "weight")))
    board = S.leaderboard_quality(S.quality_means(totals))
    return board.join(S.meta_average(S.dimension_means(totals, dims)), "model", "left")
