"""Heavy keys: detection, lookups and per-key results that do not lean on a few tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from ..session import cut_lineage

#: A key is heavy from this share of the rows; at most 1/share keys can be.
HEAVY_SHARE = 0.01
#: A key of this many rows is heavy whatever its share; it bounds the groups of the others.
HEAVY_ROWS = 2_000_000
#: Heavy keys up to this many are broadcast (checked by counting); beyond it all keys are treated as heavy.
LIST_ROWS = 200_000
#: Rows drawn, at least, to detect heavy keys, and a heavy key's least rows among those drawn.
DETECTION_ROWS = 200_000
LEAST_DRAWN = 20
#: Lookup tables up to this many rows are broadcast (checked by counting).
BROADCAST_ROWS = 200_000
#: Time slices of heavy keys, in ms.
SLICE_MS = 3_600_000


def heavy_keys(df: DataFrame, keys: Sequence[str], share: float = HEAVY_SHARE, rows: int = DETECTION_ROWS,
               seed: int = 17, stack: Sequence[Column] = (), most_rows: int | None = HEAVY_ROWS) -> DataFrame:
    """Keys that seem to hold ``share`` of ``df`` or ``most_rows`` rows, found in a random sample.

    The sample steers the plan only; results are the same whatever it says.
    ``stack`` turns each drawn row into several ``(kind, key)`` rows, as
    structs.  Without ``most_rows`` the list has about ``1 / share`` keys per
    kind at most, whatever the data, and may be broadcast; with it the list
    grows with the rows, and callers check its size.  Null keys can be heavy
    too.  The list is written to the shared folder, being used more than once.
    """
    total = df.count()
    least = max(1.0, share * total if most_rows is None else min(share * total, most_rows))
    fraction = min(1.0, max(rows / max(total, 1), LEAST_DRAWN / least))
    drawn = df if fraction >= 1.0 else df.sample(fraction=fraction, seed=seed)
    drawn = drawn.select(F.inline(F.array(*stack))) if stack else drawn.select(*keys)
    counted = drawn.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return cut_lineage(counted.where(F.col("_n") >= max(LEAST_DRAWN, least * fraction)).select(*keys))


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str], names: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k, n in zip(keys, names):
        condition = condition & left[k].eqNullSafe(right[n])
    return condition


def mark_heavy(df: DataFrame, keys: Sequence[str], heavy: DataFrame | None, flag: str = "_heavy") -> DataFrame:
    """``df`` with a boolean column: whether the row's key is in the heavy list, which must be of a checked size.

    No list means that all keys are to be treated as heavy.
    """
    if heavy is None:
        return df.withColumn(flag, F.lit(True))
    names = [f"_h{i}" for i in range(len(keys))]
    listed = F.broadcast(heavy.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.lit(True).alias("_in")))
    joined = df.join(listed, _same(df, listed, keys, names), "left")
    return joined.select(*[df[c] for c in df.columns], F.col("_in").isNotNull().alias(flag))


def lookup(fact: DataFrame, dim: DataFrame, key: str, values: Sequence[str], bound: int = BROADCAST_ROWS,
           share: float = HEAVY_SHARE, dim_key: str | None = None) -> DataFrame:
    """Left join of a large table with one row per key of ``dim``.

    Up to ``bound`` rows (counted) ``dim`` is broadcast.  Beyond it the rows of
    heavy keys meet a broadcast of just those keys' rows and the others are
    joined by an ordinary shuffle.  There ``fact`` is written to the shared
    folder first, since detection and both branches start from it.
    """
    small = dim.select(F.col(dim_key or key).alias("_k"), *values)
    if small.limit(bound + 1).count() <= bound:
        return fact.join(F.broadcast(small), fact[key] == F.col("_k"), "left").drop("_k")
    fact = cut_lineage(fact)
    heavy = heavy_keys(fact, [key], share, most_rows=None)
    marked = mark_heavy(fact, [key], heavy)
    of_heavy = small.join(F.broadcast(heavy.select(F.col(key).alias("_hk"))), F.col("_k") == F.col("_hk"), "left_semi")
    hot = marked.where("_heavy").join(F.broadcast(of_heavy), F.col(key) == F.col("_k"), "left")
    cold = marked.where("not _heavy").join(small, F.col(key) == F.col("_k"), "left")
    return hot.unionByName(cold).drop("_k", "_heavy")


def _merge(starts: str, ends: str) -> list[Column]:
    return [I.period_starts(F.col(starts), F.col(ends)).alias("ss"), I.period_ends(F.col(starts), F.col(ends)).alias("es")]


def span_summary(df: DataFrame, entity: str, labels: Sequence[str], start: str, end: str,
                 share: float = HEAVY_SHARE, slice_ms: int = SLICE_MS, detection_rows: int = DETECTION_ROWS,
                 list_rows: int = LIST_ROWS) -> DataFrame:
    """Rows, first start, last end and covered time per entity and per label value.

    Result: ``key_kind`` (the entity's column name or the label's), ``key_value``
    (text), ``n_rows``, ``first_start``, ``last_end``, ``covered_ms`` (length of
    the union of ``[start, end]``).

    Rows with a null bound or ``start > end`` count as rows and in first and
    last where the bound is there, but cover nothing.  Null labels count as
    ``''``; a null entity is a key of its own.  An empty table gives no rows.
    Columns of other names, whatever they are, are not read.

    Two rounds, the same in both: heavy keys (sampled) are cut by the time
    slice that intervals start in, so that their rows spread over tasks and are
    merged before they meet; the others are merged whole after an ordinary
    shuffle; the two are put together.  The first round merges per entity, since most of a key's
    rows repeat its entities; the second per key.

    No group is larger than a task's input: intervals of heavy keys are merged
    per map task (and slice) before those of several tasks meet, and a light
    key has some ``HEAVY_ROWS`` rows at most.  Should there be more heavy keys
    than ``list_rows``, too many to broadcast, every key is treated as heavy.
    """
    names = [f"l{i}" for i in range(len(labels))]
    rows = df.select(
        F.col(f"`{entity}`").alias("k"),
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in zip(labels, names)],
        F.col(f"`{start}`").cast("long").alias("a"), F.col(f"`{end}`").cast("long").alias("b"))
    # The key of each kind that a row belongs to.
    kinds = [F.struct(F.lit(entity).alias("kind"), F.col("k").cast("string").alias("key"))]
    kinds += [F.struct(F.lit(c).alias("kind"), F.col(n).alias("key")) for c, n in zip(labels, names)]
    heavy: DataFrame | None = heavy_keys(rows, ["kind", "key"], share, detection_rows, stack=kinds)
    if heavy.limit(list_rows + 1).count() > list_rows:
        heavy = None
    kept = ["k", *names]
    sound = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") <= F.col("b"))
    marked = mark_heavy(rows, ["k"], None if heavy is None else heavy.where(F.col("kind") == entity).select(
        F.col("key").cast(rows.schema["k"].dataType).alias("k")))
    # A heavy entity's rows are grouped by map task and by the slice they start in; the others' share one group.
    sliced = marked.withColumns({"slot": F.when(F.col("_heavy"), F.floor(F.coalesce("a", "b") / slice_ms)),
                                 "task": F.when(F.col("_heavy"), F.spark_partition_id())})
    pieces = sliced.groupBy(*kept, "slot", "task").agg(
        F.count(F.lit(1)).alias("n"), F.min("a").alias("lo"), F.max("b").alias("hi"),
        I.sorted_bounds(F.when(sound, F.col("a"))).alias("s0"), I.sorted_bounds(F.when(sound, F.col("b"))).alias("e0"))
    pieces = pieces.select(*kept, "n", "lo", "hi", *_merge("s0", "e0"))

    stacked = mark_heavy(pieces.select(F.inline(F.array(*kinds)), "n", "lo", "hi", "ss", "es"), ["kind", "key"], heavy)
    sums = [F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    gathered = lambda c: F.sort_array(F.flatten(F.collect_list(c)))
    light = stacked.where("not _heavy").groupBy("kind", "key").agg(*sums, gathered("ss").alias("s0"), gathered("es").alias("e0"))
    light = light.select("kind", "key", "n", "lo", "hi", I.covered_length(F.col("s0"), F.col("e0")).alias("covered"))

    # A heavy key's piece is a row per interval, in the slice it starts in; its totals go with the first, or with none.
    none = F.lit(None).cast("long")
    intervals = F.transform("ss", lambda x, i: F.struct(
        F.floor(x / slice_ms).alias("slice"), F.when(i == 0, F.col("n")).otherwise(F.lit(0)).alias("n"), F.when(i == 0, F.col("lo")).alias("lo"),
        F.when(i == 0, F.col("hi")).alias("hi"), x.alias("s"), F.get("es", i).alias("e")))
    bare = F.array(F.struct(none.alias("slice"), "n", "lo", "hi", none.alias("s"), none.alias("e")))
    parts = stacked.where("_heavy").select("kind", "key", F.inline(F.when(F.size("ss") > 0, intervals).otherwise(bare))).withColumn("task", F.spark_partition_id())
    by_task = parts.groupBy("kind", "key", "slice", "task").agg(*sums, I.sorted_bounds(F.col("s")).alias("s0"), I.sorted_bounds(F.col("e")).alias("e0"))
    by_slice = by_task.select("kind", "key", "slice", "n", "lo", "hi", *_merge("s0", "e0")).groupBy("kind", "key", "slice").agg(
        *sums, gathered("ss").alias("s0"), gathered("es").alias("e0"))
    periods = by_slice.select("kind", "key", "slice", "n", "lo", "hi", *_merge("s0", "e0"))
    # a slice's periods cover what they have beyond the latest end of earlier slices; a few rows per heavy key
    before = Window.partitionBy("kind", "key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.get("es", F.size("es") - 1)).over(before)
    beyond = F.aggregate(F.arrays_zip(F.col("ss").alias("s"), F.col("es").alias("e")), F.lit(0).cast("long"),
                         lambda total, x: total + F.greatest(x["e"] - F.greatest(x["s"], F.col("reach")), F.lit(0).cast("long")))
    hot = periods.withColumn("reach", reach).withColumn("c", beyond).groupBy("kind", "key").agg(*sums, F.sum("c").alias("covered"))
    return light.unionByName(hot).select(
        F.col("kind").alias("key_kind"), F.col("key").alias("key_value"), F.col("n").alias("n_rows"), F.col("lo").alias("first_start"),
        F.col("hi").alias("last_end"), F.col("covered").alias("covered_ms"))
