"""Time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(raw: Column) -> Column:
    """Timestamp of an ISO text or of epoch seconds written as text; null for anything else."""
    epoch = F.timestamp_seconds(raw.try_cast("double"))
    return F.coalesce(F.try_to_timestamp(raw), epoch)
