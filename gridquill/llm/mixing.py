"""Mixing sources to target shares of tokens."""

from __future__ import annotations

import os
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread

#: A public tokenizer in the format of the ``tokenizers`` library.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
SEED = 20_240_229
#: Sources up to which the plan is broadcast; its length is known.
PLAN_ROWS = 200_000
#: Bits of a record's place in its source's seeded order, and how many of them each round of the search for a cut settles.
ORDER_BITS, ROUND_BITS = 52, 13


@dataclass(frozen=True)
class Share:
    """What a source is to give: ``repeats`` uses of each record on average.

    Every record is used ``whole`` times, and those whose seeded place is at
    most ``(cut, cut_id)`` once more; no cut, no record more.
    """

    source: str
    target: float
    tokens: int
    planned: float
    repeats: float
    capped: bool
    cut: int | None = None
    cut_id: int | None = None

    @property
    def whole(self) -> int:
        return int(self.repeats)

    @property
    def rest(self) -> float:
        """Tokens that the whole repeats leave to be had."""
        return max(self.planned - self.whole * self.tokens, 0.0)


def water_fill(tokens: Mapping[str, int], targets: Sequence[tuple[str, float, int]], total: float | None = None) -> list[Share]:
    """Split ``total`` tokens by target share, no source beyond its maximum.

    Sources over their maximum (``tokens * max_repeats``) are clamped to it and
    what they leave is shared by the others in proportion, until none is over.
    If all are clamped the mixture is smaller than ``total``.  ``total`` is by
    default all tokens of the targeted sources.  Sources without tokens, with a
    share or maximum that is null or not positive, give nothing.
    """
    wanted = {s: (max(float(w or 0), 0.0), max(int(m or 0), 0)) for s, w, m in targets}
    have = {s: int(tokens.get(s) or 0) for s in wanted}
    budget = float(sum(have.values()) if total is None else total)
    limit = {s: float(have[s] * wanted[s][1]) for s in wanted}
    planned = {s: 0.0 for s in wanted}
    free = {s for s in wanted if wanted[s][0] > 0 and limit[s] > 0}
    clamped: set[str] = {s for s in wanted if wanted[s][0] > 0 and limit[s] <= 0}
    left = budget
    while free:
        weight = sum(wanted[s][0] for s in sorted(free))
        over = {s for s in free if left * wanted[s][0] / weight > limit[s]}
        if not over:
            for s in free:
                planned[s] = left * wanted[s][0] / weight
            break
        for s in sorted(over):
            planned[s] = limit[s]
            left -= limit[s]
        free -= over
        clamped |= over
    return [Share(s, wanted[s][0], have[s], planned[s], min(planned[s] / have[s], wanted[s][1]) if have[s] else 0.0, s in clamped)
            for s in wanted]


def source_key(source: Column) -> Column:
    """Spellings of a source that differ in case and outer spaces are one; blank is null."""
    key = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))
    return F.when(key != "", key)


def _count_tokens(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(SparkFiles.get(name))
        tokenizer.encode_special_tokens = True
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            counts: list[int] = []
            for i in range(0, len(texts), 256):
                counts += [len(e.ids) for e in tokenizer.encode_batch_fast(texts[i:i + 256], add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["doc_id", "source", "n_tokens"])
    return run


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, source, n_tokens)`` with the source's common spelling; null text has no tokens.

    The tokenizer's file is given to the executors, which need not have it.
    """
    documents.sparkSession.sparkContext.addFile(tokenizer)
    rows = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text"))
    return rows.mapInArrow(_count_tokens(os.path.basename(tokenizer)), "doc_id bigint, source string, n_tokens bigint")


def character_counts(documents: DataFrame) -> DataFrame:
    """``token_counts`` with characters for tokens."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"),
                            F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_tokens"))


def read_targets(targets: DataFrame) -> list[tuple[str, float, int]]:
    """``(source, share, max_repeats)`` rows, one per source (the first by share)."""
    rows = targets.select(source_key(F.col("source")).alias("s"), "target_share", "max_repeats").distinct().collect()
    out: dict[str, tuple[str, float, int]] = {}
    for s, w, m in sorted((tuple(r) for r in rows if r[0] is not None), key=lambda r: (r[0], -(r[1] or 0), r[2] or 0)):
        out.setdefault(s, (s, w, m))
    return list(out.values())


def plan_mixture(counts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> list[Share]:
    """The shares of each targeted source, from token totals per source, and where its extra records end.

    ``counts`` is read more than once; it is written to the shared folder by the
    caller where it is costly.  What comes to the driver is one row per target.
    """
    wanted = read_targets(targets)
    named = counts.sparkSession.createDataFrame([(s,) for s, _, _ in wanted], "t string")
    held = counts.join(_small(named, len(wanted)), F.col("source") == F.col("t"), "left_semi")
    totals = held.groupBy("source").agg(F.sum("n_tokens").alias("n"))
    plan = water_fill({r[0]: r[1] for r in totals.collect()}, wanted, total)
    cuts = _cuts(held, plan, seed)
    return [replace(s, cut=cuts[s.source][0], cut_id=cuts[s.source][1]) if s.source in cuts else s for s in plan]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= PLAN_ROWS else df


def place(seed: int, source: Column, doc_id: Column) -> Column:
    """A record's place in the seeded order of its source, ``ORDER_BITS`` bits that other engines can compute too."""
    text = F.concat_ws("/", F.lit(str(seed)), source, doc_id.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, ORDER_BITS // 4), 16, 10).cast("long")


def _cuts(counts: DataFrame, plan: Sequence[Share], seed: int) -> dict[str, tuple[int, int]]:
    """The place and id of the last record of each source that is used once more.

    Records are taken in seeded order as long as their middle lies within the
    tokens still to be had, so what is reached is at most half a record off.
    The place is found a few bits at a time, by sums over ranges of the order:
    no task sorts a source, only the records that share a cut's last range.
    Each round is one pass over the counts and gives one row per source.
    """
    spark = counts.sparkSession
    placed = counts.select("source", "doc_id", "n_tokens", place(seed, F.col("source"), F.col("doc_id")).alias("h"))
    bits, state = ORDER_BITS, {s.source: (0, float(s.rest)) for s in plan if s.rest > 0}

    def within(bits: int) -> DataFrame:
        """The records of the range that each source's cut is known to lie in."""
        known = spark.createDataFrame([(s, *x) for s, x in state.items()], "s string, range bigint, left double")
        return placed.join(_small(known, len(state)), (F.col("source") == F.col("s")) & (F.shiftright("h", bits) == F.col("range")))

    for _ in range(2):  # two rounds leave one record in 2 ** 26 of a source to be sorted
        rows, bits = within(bits), bits - ROUND_BITS
        ranges = rows.groupBy("source", "left", F.shiftright("h", bits).alias("r")).agg(F.sum("n_tokens").alias("n"))
        before = (F.sum("n").over(Window.partitionBy("source").orderBy("r")) - F.col("n")).alias("before")  # at most 2 ** ROUND_BITS rows
        # the last range that begins within the rest has the cut, or the cut is right before it
        last = ranges.select("source", "left", "r", before).where("before <= left").groupBy("source", "left").agg(F.max(F.struct("r", "before")).alias("m"))
        state = {source: (m.r, left - m.before) for source, left, m in last.collect()}
    order = Window.partitionBy("source").orderBy("h", "doc_id")
    ended = within(bits).withColumn("middle", F.sum("n_tokens").over(order) - F.col("n_tokens") / 2)
    used = ended.where("middle <= left").groupBy("source").agg(F.max(F.struct("h", "doc_id")).alias("c"))
    cuts = {source: ((place_ << bits) - 1, (1 << 63) - 1) for source, (place_, _) in state.items()}
    return cuts | {source: (c.h, c.doc_id) for source, c in used.collect()}


def with_copies(df: DataFrame, plan: Sequence[Share], seed: int = SEED) -> DataFrame:
    """``df`` (with ``source`` and ``doc_id``) and how often each record is used, as ``_uses``.

    Decided from the record and the plan alone, so any task gives the same answer again.
    """
    lines = df.sparkSession.createDataFrame([(s.source, s.whole, s.cut, s.cut_id) for s in plan], "_s string, _whole int, _cut bigint, _cut_id bigint")
    id_ = F.col("doc_id").cast("long")
    h = place(seed, F.col("source"), id_)
    more = (h < F.col("_cut")) | (h == F.col("_cut")) & (id_ <= F.col("_cut_id"))
    joined = df.join(_small(lines, len(plan)), F.col("source") == F.col("_s"), "left")
    uses = F.coalesce(F.col("_whole") + F.coalesce(more, F.lit(False)).cast("int"), F.lit(0))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], uses.alias("_uses"))


def mix(documents: DataFrame, plan: Sequence[Share], seed: int = SEED) -> DataFrame:
    """The mixture: each record as often as the plan says, with ``copy_no`` from 1 up.

    Columns of ``documents`` stay as they are, ``source`` in its common
    spelling; records without a source or of an untargeted one are left out.
    A ``copy_no`` that is there already is replaced; columns called ``_uses``,
    ``_s``, ``_whole``, ``_cut`` and ``_cut_id`` are dropped.
    No shuffle: a source that holds most rows costs nothing extra.
    """
    keyed = documents.drop("_uses", "_s", "_whole", "_cut", "_cut_id").withColumn("source", source_key(F.col("source")))
    rest = [F.col(f"`{c}`") for c in keyed.columns if c != "copy_no"]
    keyed, times = with_copies(keyed, plan, seed), F.col("_uses")
    # no copies, no row: the sequence of a record that is not used is empty
    numbers = F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))
    return keyed.select(*rest, F.explode(numbers).alias("copy_no"))


def reached_shares(counts: DataFrame, plan: Sequence[Share], seed: int = SEED) -> DataFrame:
    """Per targeted source: target and planned share, tokens used and the share really reached."""
    spark = counts.sparkSession
    mixture = sum(s.planned for s in plan)
    rows = [(s.source, s.target, s.tokens, s.planned / mixture if mixture else 0.0, s.repeats, s.capped) for s in plan]
    planned = spark.createDataFrame(rows, "source string, target_share double, source_tokens bigint, planned_share double, repeats double, capped boolean")
    used = with_copies(counts.select("doc_id", "source", "n_tokens"), plan, seed).withColumnRenamed("_uses", "t").groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("t")).alias("tokens"), F.sum("t").cast("long").alias("records"), F.max("t").alias("most"))
    joined = planned.join(used.withColumnRenamed("source", "s"), F.col("source") == F.col("s"), "left").drop("s")
    whole = joined.select(
        *planned.columns, F.coalesce("tokens", F.lit(0)).cast("long").alias("used_tokens"),
        F.coalesce("records", F.lit(0)).cast("long").alias("used_records"), F.coalesce("most", F.lit(0)).alias("most_repeats"))
    # one row per target: a window without keys is a handful of rows
    every = F.sum("used_tokens").over(Window.partitionBy(F.lit(1)))
    return whole.withColumn("reached_share", F.when(every > 0, F.col("used_tokens") / every).otherwise(F.lit(0.0)))
