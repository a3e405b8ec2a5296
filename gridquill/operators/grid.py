"""Irregular readings onto a regular grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payload import readings
from ..schema import SERIES
from .skew import lookup

#: Length of a grid cell, in ms.
SLOT_MS = 60_000
#: A reading holds for this many nominal distances between readings, unless the next one comes earlier.
HOLD = 3.0
#: Cells of a time block; readings of a series and block meet in one task.
BLOCK_SLOTS = 60
#: Empty cells that are written out of one row at a time.
_FAN = 1_440


def regular_grid(chunks: DataFrame, series: DataFrame | None = None, slot_ms: int = SLOT_MS, hold: float = HOLD) -> DataFrame:
    """One row per series and grid cell, from its first to its last usable reading.

    Result: ``series_id``, ``slot_ms`` (start of the cell), ``n_readings``,
    ``value`` (time-weighted average over the covered part, null if nothing
    covers the cell), ``coverage`` (covered fraction), ``status``: ``observed``
    (has readings), ``filled`` (covered by an earlier reading only) or
    ``missing``.

    Readings become validity intervals of a step function: from their time to
    the next reading's, at most ``hold * scrape_ms`` (``hold * slot_ms`` for a
    series that ``series`` lacks).  The intervals are cut at cell bounds.  What
    counts as usable is said in ``functions.payload``; of several readings at
    one instant the one received last decides, then the larger value.  A series
    with no usable reading has no rows; a null id is a series of its own.

    Readings are grouped by series and time block of ``BLOCK_SLOTS`` cells, so
    a hot series spreads over tasks and a group holds at most a block's
    distinct instants.  What blocks need of each other, the last reading before
    and the first one after, is settled in windows over block summaries, one
    row per block.  Empty cells are written out in steps, so that a reading far
    off from the others makes no array longer than ``_FAN`` or as its distance has days.
    """
    keep = ["received_at"] if "received_at" in chunks.columns else []
    # the null id is a key of its own, marked by u, so that plain equality will do in joins
    raw = readings(chunks, *keep).withColumns({"k": F.coalesce(SERIES, F.lit(0).cast("long")), "u": F.col(SERIES).isNull()})
    rank = F.struct(*[F.col(c) for c in keep], F.col("v"))
    instants = raw.groupBy("k", "t", "u").agg(F.max(rank).alias("r")).select("k", "u", "t", F.col("r.v").alias("v"))
    block_ms = slot_ms * BLOCK_SLOTS
    placed = instants.withColumn("block", F.col("t") - F.pmod("t", F.lit(block_ms)))
    # the joins below would tell one branch only that no block is null, and the branches would no longer share the shuffle
    placed = placed.where("block is not null").repartition("k", "u", "block")
    cell = (F.col("t") - F.pmod("t", F.lit(slot_ms))).alias("slot")
    cells = placed.groupBy("k", "u", "block", cell).agg(F.sort_array(F.collect_list(F.struct("t", "v"))).alias("p"))

    blocks = placed.groupBy("k", "u", "block").agg(F.max("t").alias("t1"), F.max_by("v", "t").alias("v1"), F.min("t").alias("first"))
    blocks = blocks.where(F.col("v1") > float("-inf"))  # always so; a query that drops the value still shares the shuffle with the cells
    if series is None:
        blocks = blocks.withColumn("scrape", F.lit(None).cast("long"))
    else:
        dim = series.select(F.col(SERIES).cast("long").alias("sk"), F.col("scrape_ms").cast("long").alias("scrape"))
        blocks = lookup(blocks, dim.where("sk is not null"), "k", ["scrape"], dim_key="sk").withColumn("scrape", F.when(~F.col("u"), F.col("scrape")))
    by_block = Window.partitionBy("k", "u").orderBy("block")
    after = F.lead("first").over(by_block)
    age = F.ceil(F.lit(float(hold)) * F.coalesce("scrape", F.lit(slot_ms))).cast("long").alias("age")
    around = blocks.select(F.col("k").alias("ak"), F.col("u").alias("au"), F.col("block").alias("ab"), age,
                           F.lag(F.struct(F.col("t1").alias("t"), F.col("v1").alias("v"))).over(by_block).alias("before"),
                           (after - F.pmod(after, F.lit(slot_ms))).alias("after"))
    ordered = Window.partitionBy("k", "u", "block").orderBy("slot")
    last = F.get("p", F.size("p") - 1)
    met = cells.select("k", "u", "block", "slot", "p", last.alias("last"), F.lag(last).over(ordered).alias("prior"), F.lead("slot").over(ordered).alias("next"))
    met = met.join(around.hint("merge"), (F.col("k") == F.col("ak")) & (F.col("u") == F.col("au")) & (F.col("block") == F.col("ab"))).select(
        F.when(~F.col("u"), F.col("k")).alias("series_id"), "slot", "p", "age", "last", F.coalesce("prior", "before").alias("prior"), F.coalesce("next", "after").alias("next"))

    # A cell with readings: what an earlier one covers up to its first, then each until the next or the cell's end.
    stop = F.col("slot") + slot_ms
    until = lambda x, bound: F.least(x["t"] + F.col("age"), bound)
    prior, zero = F.col("prior"), F.lit(0).cast("long")
    lead_in = F.greatest(F.least(prior["t"] + F.col("age"), F.get("p", F.lit(0))["t"]) - F.col("slot"), zero)
    lead_ms = F.when(prior.isNotNull(), lead_in).otherwise(zero)  # least() skips nulls
    lengths = F.transform("p", lambda x, i: until(x, F.coalesce(F.get("p", i + 1)["t"], stop)) - x["t"])
    own_ms = F.aggregate(lengths, zero, lambda a, x: a + x)
    area = F.aggregate(F.zip_with("p", lengths, lambda x, d: x["v"] * d), F.lit(0.0), lambda a, x: a + x)
    whole = met.select("series_id", "slot", "next", "age", "last", F.size("p").alias("n"), lead_ms.alias("lead_ms"), own_ms.alias("own_ms"),
                       area.alias("area"), prior["v"].alias("prior_v"))
    covered = F.col("lead_ms") + F.col("own_ms")
    total = F.col("area") + F.when(F.col("lead_ms") > 0, F.col("prior_v") * F.col("lead_ms")).otherwise(F.lit(0.0))
    own = whole.select("series_id", "slot", "next", "age", "last", "n", covered.alias("covered"), total.alias("total"))

    # The cell itself and the empty ones up to the next: first the days, then the cells of a day.
    beyond = F.coalesce((F.col("next") - F.col("slot")) / slot_ms, F.lit(1)).cast("long")  # cells to write
    far = own.withColumn("m", beyond).select("*", F.explode(F.sequence(zero, F.col("m") - 1, F.lit(_FAN).cast("long"))).alias("i0"))
    each = far.select("*", F.explode(F.sequence("i0", F.least(F.col("i0") + (_FAN - 1), F.col("m") - 1))).alias("i"))
    g = F.col("slot") + F.col("i") * slot_ms
    first = F.col("i") == 0
    held = F.greatest(F.least(F.col("last.t") + F.col("age"), g + slot_ms) - g, zero)
    full = each.select("series_id", g.alias("slot_ms"), F.when(first, F.col("n")).otherwise(F.lit(0)).alias("n_readings"),
                       F.when(first, F.col("covered")).otherwise(held).alias("covered"), F.when(first, F.col("total")).otherwise(F.col("last.v") * held).alias("total"))
    return full.select(
        "series_id", "slot_ms", "n_readings", F.when(F.col("covered") > 0, F.col("total") / F.col("covered")).alias("value"),
        (F.col("covered") / F.lit(float(slot_ms))).alias("coverage"),
        F.when(F.col("n_readings") > 0, "observed").when(F.col("covered") > 0, "filled").otherwise("missing").alias("status"))
