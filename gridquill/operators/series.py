"""Series selection over a chunk table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MAXT, MINT, SERIES, clustering_key, label, label_columns, text_labels
from ..session import cut_lineage
from .scan import Predicate, scan


class ChunkEngine:
    """Queries over one chunk table, bound to a time range.

    ``mode="containment"`` keeps chunks that lie wholly inside the range;
    ``"overlap"`` also keeps those that straddle an edge.
    """

    def __init__(self, chunks: DataFrame, mint: int | None = None, maxt: int | None = None,
                 mode: str = "containment", on_missing: str = "ignore") -> None:
        if mode not in ("containment", "overlap"):
            raise ValueError(f"unknown mode {mode!r}")
        self.chunks, self.mint, self.maxt, self.mode, self.on_missing = chunks, mint, maxt, mode, on_missing

    def between(self, mint: int, maxt: int) -> ChunkEngine:
        return ChunkEngine(self.chunks, mint, maxt, self.mode, self.on_missing)

    def select(self, matchers: Iterable[Predicate] = ()) -> DataFrame:
        """Chunk rows in the time range that meet the matchers; labels come out as text, however stored."""
        low, high = (MINT, MAXT) if self.mode == "containment" else (MAXT, MINT)
        bounds = [Predicate(low, ">=", self.mint)] if self.mint is not None else []
        bounds += [Predicate(high, "<=", self.maxt)] if self.maxt is not None else []
        return text_labels(scan(self.chunks, [*matchers, *bounds], self.on_missing))

    def select_series(self, matchers: Iterable[Predicate] = (), grouping: Sequence[str] = ()) -> DataFrame:
        """One row per series: its id as text and the grouping labels it has.

        Unknown grouping labels are left out by name.  Only the id and those
        labels are read; labels depend on the id, so a plain distinct would do
        for clean tables and the aggregate also settles contradicting rows.
        """
        names = [g for g in dict.fromkeys(grouping) if g in self.chunks.columns]
        rows = self.select(matchers)
        picked = rows.groupBy(SERIES).agg(*[F.min(label(n)).alias(n) for n in names]) if names else \
            rows.select(SERIES).distinct()
        return picked.select(F.col(SERIES).cast("string").alias(SERIES), *names)

    def select_series_ordered(self, matchers: Iterable[Predicate] = (), grouping: Sequence[str] = ()) -> DataFrame:
        """``select_series`` with a ``position``, in the order in which a sorted table first meets each series.

        The order is that of the clustering key of a series' first chunk, then
        of its id, a missing label counting as ``''``.  Rows come out sorted.
        """
        known = {*label_columns(self.chunks)}
        names = [g for g in dict.fromkeys(grouping) if g in self.chunks.columns]
        first = [label(c).alias(c) if c in known else F.col(f"`{c}`") for c in clustering_key(self.chunks.columns)]
        met = self.select(matchers).groupBy(SERIES).agg(F.min(F.struct(*first)).alias("_first"), *[F.min(label(n)).alias(n) for n in names])
        placed = number_rows(met, ["_first", SERIES], "position")
        return placed.select("position", F.col(SERIES).cast("string").alias(SERIES), *names).orderBy("position")

    def label_values(self, name: str, matchers: Iterable[Predicate] = ()) -> DataFrame:
        """Distinct non-empty values of a label."""
        rows = self.select(matchers)
        return rows.where(F.col(f"`{name}`") != "").select(F.col(f"`{name}`").alias("label_value")).distinct()

    def label_names(self, matchers: Iterable[Predicate] = ()) -> DataFrame:
        """Label columns with at least one non-empty value, in one pass without a shuffle of rows."""
        names = label_columns(self.chunks)
        flags = [F.max(label(n) != "").alias(f"f{i}") for i, n in enumerate(names)]
        seen = F.array(*[F.when(F.col(f"f{i}"), F.lit(n)) for i, n in enumerate(names)])
        return self.select(matchers).agg(*flags).select(F.explode(F.array_compact(seen)).alias("label_name"))


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with 0-based positions in the order of ``order``, which should tell all rows apart.

    Rows are range-partitioned and numbered within partitions, and each
    partition is shifted by the sizes of those before it: no task sees more
    than its own range, and what is broadcast is one row per partition.
    """
    ranged = df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    placed = cut_lineage(ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.min("_i").alias("_first"))
    # a window over as many rows as there are partitions
    before = Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(F.col("_p").alias("_q"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    joined = placed.join(F.broadcast(shifts), F.col("_p") == F.col("_q"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_i") + F.col("_shift")).alias(name))


def assign_series_ids(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Add 0-based series ids in label order; only the distinct label sets are ranked."""
    keys = [label(n).alias(n) for n in labels]
    ids = number_rows(df.select(*keys).distinct(), list(labels), SERIES)
    filled = df.select(*[label(c).alias(c) if c in labels else F.col(f"`{c}`") for c in df.columns if c != SERIES])
    return filled.join(ids, list(labels))
