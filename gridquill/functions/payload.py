"""Chunk payloads: ``offset:value`` pairs as UTF-8 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MAXT, MINT, PAYLOAD, SERIES

#: A reading's pair: a non-negative whole offset, then a plain or scientific decimal number.
PAIR = r"^([0-9]+):([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)$"


def pairs(payload: Column) -> Column:
    """The payload's pairs as text; null payloads have none."""
    return F.split(F.coalesce(payload.cast("string"), F.lit("")), ",")


def value_text(value: Column, decimals: int | None = None) -> Column:
    """A value as plain decimal text: rounded to ``decimals``, or with as many as it takes to read the same double, three at least."""
    v = value.cast("double")
    text = F.format_string(f"%.{3 if decimals is None else decimals}f", v)
    if decimals is not None:
        return text
    # no double needs more than 345 decimals; the format pads the shortest exact digits with zeros
    return F.when(text.try_cast("double").eqNullSafe(v), text).otherwise(F.regexp_replace(F.format_string("%.345f", v), "0+$", ""))


def readings(chunks: DataFrame, *keep: str) -> DataFrame:
    """Usable readings ``(series, t, v)`` and the ``keep`` columns of their chunk.

    Chunks with a null bound or reversed bounds are left out.  A reading is
    usable if its pair has a non-negative integer offset and a finite decimal
    value and lies no later than ``__maxt``.  Damaged pairs vanish one by one,
    the rest of their payload stays.
    """
    sound = chunks.where(F.col(MINT).isNotNull() & F.col(MAXT).isNotNull() & (F.col(MINT) <= F.col(MAXT)))
    exploded = sound.select(SERIES, MINT, MAXT, *keep, F.explode(pairs(F.col(PAYLOAD))).alias("pair"))
    split = exploded.where(F.col("pair").rlike(PAIR)).select(
        SERIES, MINT, MAXT, *keep,
        F.substring_index("pair", ":", 1).try_cast("long").alias("offset"),
        F.substring_index("pair", ":", -1).try_cast("double").alias("v"))
    # offsets beyond the chunk are compared by difference: a sum might overflow
    usable = F.col("offset").isNotNull() & (F.col("offset") <= F.col(MAXT) - F.col(MINT)) & \
        (F.abs("v") < F.lit(float("inf")))
    return split.where(usable).select(F.col(SERIES), (F.col(MINT) + F.col("offset")).alias("t"), "v", *keep)
