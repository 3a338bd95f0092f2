"""Times as numbers, independent of the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without zone is taken as it reads."""
    at = F.col(name)
    if not isinstance(df.schema[name].dataType, T.TimestampNTZType):
        return F.unix_micros(at)
    days = F.date_diff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(at)) * 60 + F.minute(at)
    seconds = F.extract(F.lit("SECOND"), at)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")
