"""Samples to chunk rows: the conversion path of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import value_text
from ..operators.series import assign_series_ids
from ..schema import MAXT, MINT, PAYLOAD, SERIES


def samples_to_chunks(samples: DataFrame, labels: Sequence[str], ts: str = "ts_ms", value: str = "value",
                      slice_ms: int = 7_200_000, decimals: int | None = None) -> DataFrame:
    """Chunk rows from ``(labels..., ts, value)`` rows.

    Each series and time slice gives one row; the payload is UTF-8 text of
    ``offset:value`` pairs in time order, offsets in ms after ``__mint``.  A
    group is bounded by the slice, never by the length of a series.  Samples
    with a null time or value are left out.  Values are written exactly unless
    a number of ``decimals`` is asked for.
    """
    keys = [F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in labels]
    usable = samples.where(F.col(ts).isNotNull() & F.col(value).isNotNull())
    text = value_text(F.col(value), decimals)
    cells = usable.select(*keys, F.col(ts).cast("long").alias("t"), text.alias("v"),
                          F.floor(F.col(ts) / slice_ms).alias("slice"))
    grouped = cells.groupBy(*labels, "slice").agg(
        F.min("t").alias(MINT), F.max("t").alias(MAXT), F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))
    pairs = F.transform("s", lambda x: F.concat((x["t"] - F.col(MINT)).cast("string"), F.lit(":"), x["v"]))
    rows = grouped.select(*labels, MINT, MAXT, F.encode(F.concat_ws(",", pairs), "UTF-8").alias(PAYLOAD))
    return assign_series_ids(rows, labels).select(SERIES, MINT, MAXT, PAYLOAD, *sorted(labels))
