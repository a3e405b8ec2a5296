"""Continuous periods and gaps of overlapping intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as I
from .skew import lookup

#: Length of the time blocks that an entity's intervals are cut into, in ms.
BLOCK_MS = 3_600_000


def periods_and_gaps(df: DataFrame, entity: str, start: str, end: str, slack: DataFrame | None = None,
                     slack_column: str = "slack_ms", block_ms: int = BLOCK_MS) -> DataFrame:
    """Merge each entity's intervals into periods and list the gaps between them.

    Result: ``entity`` (as given), ``span_kind`` (``period`` or ``gap``),
    ``start_ms``, ``end_ms``.  An interval continues the period before it if it
    starts no later than the latest end so far plus the entity's slack.

    Rows with a null bound or ``start > end`` are left out; an entity with no
    other rows has no result.  Repeated rows change nothing.  Entities missing
    from ``slack``, or with a null or negative one, have slack 0; ``slack``
    must have one row per entity.  A null entity is an entity of its own.
    Equal bounds (an instant) form a period of length 0.

    Starts and ends are sorted independently and paired by rank (see
    ``functions.intervals``), first within time blocks, so that a hot entity's
    rows spread over tasks: a block holds at most ``block_ms`` distinct starts
    whatever the data.  What blocks need of each other is settled in windows
    over block summaries: two numbers per block, then the one period and the one
    gap that may cross a block's end.
    """
    # a struct around the entity makes null a key like any other, also in joins
    key = F.struct(F.col(f"`{entity}`").alias("id"))
    raw = df.select(key.alias("k"), F.col(f"`{start}`").cast("long").alias("s"), F.col(f"`{end}`").cast("long").alias("e"))
    sound = raw.where(F.col("s").isNotNull() & F.col("e").isNotNull() & (F.col("s") <= F.col("e")))
    single = sound.groupBy("k", "s").agg(F.max("e").alias("e"))
    blocks = single.withColumn("block", F.col("s") - F.pmod("s", F.lit(block_ms)))
    # the join below would tell one branch only that no block is null, and the branches would no longer share the shuffle
    blocks = blocks.where("block is not null").repartition("k", "block")

    # What a block must know of the others: the latest end before it and the first start after it.
    by_block = Window.partitionBy("k").orderBy("block")
    before = by_block.rowsBetween(Window.unboundedPreceding, -1)
    extents = blocks.groupBy("k", "block").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    if slack is None:
        extents = extents.withColumn("slack", F.lit(0).cast("long"))
    else:
        dim = slack.where(F.col(f"`{entity}`").isNotNull()).select(
            F.struct(F.col(f"`{entity}`").cast(df.schema[entity].dataType).alias("id")).alias("sk"),
            F.greatest(F.col(f"`{slack_column}`").cast("long"), F.lit(0)).alias("slack"))
        extents = lookup(extents, dim, "k", ["slack"], dim_key="sk").withColumn("slack", F.coalesce("slack", F.lit(0).cast("long")))
    around = extents.select(F.col("k").alias("ak"), F.col("block").alias("ab"), "slack", F.max("hi").over(before).alias("reach"),
                            F.lead("lo").over(by_block).alias("next_lo"))
    bounds = blocks.groupBy("k", "block").agg(I.sorted_bounds(F.col("s")).alias("s0"), I.sorted_bounds(F.col("e")).alias("e0"))
    met = bounds.join(around.hint("merge"), (F.col("k") == F.col("ak")) & (F.col("block") == F.col("ab")))
    merged = met.select("k", "slack", "reach", "next_lo", I.period_starts(F.col("s0"), F.col("e0"), F.col("slack")).alias("ss"),
                        I.period_ends(F.col("s0"), F.col("e0"), F.col("slack")).alias("es"))
    reach = F.col("reach")

    def closing(x, i):
        following = F.coalesce(F.get("ss", i + 1), F.col("next_lo"))
        return following.isNull() | (following > F.greatest(reach, x) + F.col("slack"))

    cut = merged.select(
        "k",
        F.filter("ss", lambda x: reach.isNull() | (x > reach + F.col("slack"))).alias("opens"),
        F.transform(F.filter("es", closing), lambda x: F.greatest(reach, x)).alias("closes"),
        # 1 if a period is open where the block begins
        (reach.isNotNull() & (F.get("ss", F.lit(0)) <= reach + F.col("slack"))).cast("int").alias("carry"))

    # Opens and closes alternate; those of a block pair by rank, shifted by one where a period is open already.
    n_open, n_close, carry = F.size("opens"), F.size("closes"), F.col("carry")
    span = lambda kind, a, b: F.struct(F.lit(kind).alias("span_kind"), a.alias("start_ms"), b.alias("end_ms"))
    inside = F.filter(F.concat(
        F.transform("opens", lambda x, i: span("period", x, F.get("closes", i + carry))),
        F.transform("closes", lambda x, i: span("gap", x, F.get("opens", i + 1 - carry)))), lambda x: x["end_ms"].isNotNull())
    local = cut.select("k", F.inline(inside))
    # What is left of a block: the first of its bounds, unless it opens the block's pairs, and the last one.
    first = F.when(carry == 1, F.get("closes", F.lit(0))).otherwise(F.get("opens", F.lit(0)))
    open_at_end = n_open + carry > n_close
    last = F.when(open_at_end, F.get("opens", n_open - 1)).otherwise(F.get("closes", n_close - 1))
    edges = F.array(F.struct(first.alias("at"), F.lit(True).alias("enters"), (carry == 1).alias("closes")),
                    F.struct(last.alias("at"), F.lit(False).alias("enters"), (~open_at_end).alias("closes")))
    met_edges = cut.select("k", F.inline(edges)).where(F.col("at").isNotNull())
    # the edge that leaves a block is followed by the one that enters the next block with any
    order = Window.partitionBy("k").orderBy("at", F.col("enters").desc())
    crossing = met_edges.select("k", "at", "enters", "closes", F.lead("at").over(order).alias("until"), F.lead("enters").over(order).alias("follows"))
    crossed = crossing.where("not enters and follows").select(
        "k", F.when(F.col("closes"), "gap").otherwise("period").alias("span_kind"), F.col("at").alias("start_ms"), F.col("until").alias("end_ms"))
    out = local.unionByName(crossed)
    return out.select(F.col("k.id").alias(entity), "span_kind", "start_ms", "end_ms")
