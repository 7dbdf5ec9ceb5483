"""Join helpers whose strategy depends on a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochlens.session import cut_lineage

BROADCAST_ROWS = 200_000


def join_measured(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
    max_rows: int = BROADCAST_ROWS, ready: bool = False,
) -> DataFrame:
    """Join with a side that is expected to be small. It is materialised (unless ``ready``) and counted first; only
    below ``max_rows`` is it broadcast, otherwise Spark plans an ordinary shuffle join."""
    small = small if ready else cut_lineage(small)
    if small.limit(max_rows + 1).count() <= max_rows:
        small = F.broadcast(small)
    return big.join(small, on, how)
