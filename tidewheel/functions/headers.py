"""Message headers: array<struct<key string, value binary>> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.schemas import CORRELATION_HEADER, INSTANCE_HEADER


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def header_encode(text: str | Column) -> Column:
    return F.encode(_column(text), "UTF-8")


def header_decode(headers: str | Column) -> Column:
    """Header values as text, whatever their bytes; a missing value stays NULL."""
    return F.transform(
        _column(headers),
        lambda h: F.struct(
            h["key"].alias("key"), h["value"].cast("string").alias("value")
        ),
    )


def header_lookup(headers: str | Column, key: str) -> Column:
    """Bytes of the named header; of a repeated header the last one."""
    named = F.filter(_column(headers), lambda h: h["key"] == key)
    return F.try_element_at(F.transform(named, lambda h: h["value"]), F.lit(-1))


def header(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), value.cast("binary").alias("value"))


def correlation_headers(correlation_id: Column, instance_id: Column) -> Column:
    """Correlation header, then instance header, each only if there is a value."""
    return F.array_compact(
        F.array(
            F.when(
                correlation_id.isNotNull(), header(CORRELATION_HEADER, correlation_id)
            ),
            F.when(instance_id.isNotNull(), header(INSTANCE_HEADER, instance_id)),
        )
    )


def header_forward(headers: str | Column) -> Column:
    """Headers of the outbound message: the two above, all others left out."""
    return correlation_headers(
        header_lookup(headers, CORRELATION_HEADER),
        header_lookup(headers, INSTANCE_HEADER),
    )
