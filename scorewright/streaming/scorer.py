"""Apply a fitted recode to a stream of rows; a projection, so it needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.config import Roles
from ..plans.recode import Recoded


def score_stream(rows: DataFrame, made: Recoded, roles: Roles) -> DataFrame:
    return made.apply(rows, roles)


def start(rows: DataFrame, made: Recoded, roles: Roles, path: str, checkpoint: str) -> StreamingQuery:
    """Write scored rows as Parquet, all that is there now."""
    return score_stream(rows, made, roles).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
