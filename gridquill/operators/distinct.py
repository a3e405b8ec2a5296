"""First row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import clustering_key


def unique_by(df: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    """The first row of each value of ``key``, by ``order`` (clustering order by default).

    An aggregate, not a window: each map task keeps one candidate per key, so a
    hot key costs no more than any other.  Ties in ``order`` are broken by the
    remaining columns.  A null key is a key of its own.
    """
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    lead = [c for c in (clustering_key(df.columns) if order is None else order) if c in rest]
    fields = lead + [c for c in rest if c not in lead]
    best = F.min(F.struct(*[F.col(f"`{c}`") for c in fields])).alias("best")
    picked = df.groupBy(F.col(f"`{key}`")).agg(best)
    return picked.select(*[F.col(f"`{key}`") if c == key else F.col(f"best.`{c}`").alias(c) for c in df.columns])
