"""Streaming ingest: samples to chunk rows under a watermark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import value_text
from ..schema import MAXT, MINT, PAYLOAD


def stream_chunks(samples: DataFrame, labels: Sequence[str], ts: str = "ts", value: str = "value",
                  slice_length: str = "2 hours", lateness: str = "10 minutes", decimals: int | None = None) -> DataFrame:
    """Chunk rows of a stream of samples, one per series and time slice.

    A slice is emitted once, when the watermark has passed it; samples later
    than ``lateness`` are dropped by the engine.  State holds the open slices
    only.  ``ts`` must be a timestamp.  Values are written exactly unless a
    number of ``decimals`` is asked for.
    """
    keys = [F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in labels]
    ms = F.unix_millis(F.col(ts))
    text = value_text(F.col(value), decimals)
    cells = samples.where(F.col(ts).isNotNull() & F.col(value).isNotNull()).withWatermark(ts, lateness).select(
        *keys, F.col(ts), ms.alias("t"), text.alias("v"))
    grouped = cells.groupBy(F.window(ts, slice_length), *labels).agg(
        F.min("t").alias(MINT), F.max("t").alias(MAXT), F.sort_array(F.collect_list(F.struct("t", "v"))).alias("s"))
    pairs = F.transform("s", lambda x: F.concat((x["t"] - F.col(MINT)).cast("string"), F.lit(":"), x["v"]))
    return grouped.select(MINT, MAXT, F.encode(F.concat_ws(",", pairs), "UTF-8").alias(PAYLOAD), *sorted(labels))
