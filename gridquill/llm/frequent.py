"""Most frequent values of columns with very many distinct values."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, ship

#: Share of all rows from which a value counts as frequent.
MIN_SHARE = 0.005
#: Rows that a map task holds before it writes them out as one sorted run.
RUN_ROWS = 262_144
#: Bytes after which it does so too, however few the rows.
RUN_BYTES = 64 << 20

_RUN = "label_name string, label_value string, n bigint"


def _runs(names: Sequence[str], run_rows: int):
    """Cut a partition into sorted runs with combined counts, a column at a time.

    Each run begins with the number of its rows, under no label.
    """
    schema = pa.schema([("label_name", pa.string()), ("label_value", pa.string()), ("n", pa.int64())])

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([None], pa.string()), pa.array([table.num_rows], pa.int64())], schema=schema)
        for i, name in enumerate(names):
            column = table.column(i)
            column = column.filter(pc.fill_null(pc.not_equal(column, ""), False))
            counted = pa.table({"v": column}).group_by("v").aggregate([([], "count_all")]).sort_by("v")
            if counted.num_rows:
                label = pa.repeat(pa.scalar(name), counted.num_rows)
                out = pa.table([label, counted["v"], counted["count_all"].cast(pa.int64())], schema=schema)
                yield from out.to_batches(max_chunksize=65_536)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size = [], 0, 0
        for b in batches:
            held.append(b)
            rows, size = rows + b.num_rows, size + b.nbytes
            if rows >= run_rows or size >= RUN_BYTES:
                yield from flush(held)
                held, rows, size = [], 0, 0
        if rows:
            yield from flush(held)

    return run


def _merge(keep: int):
    """Add up equal neighbours of a sorted partition and keep a heap of the largest counts per label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list[tuple[int, str]]] = {}
        carry: tuple[str, str, int] | None = None

        def offer(label: str, value: str, n: int) -> None:
            heap = heaps.setdefault(label, [])
            if len(heap) < keep:
                heapq.heappush(heap, (n, value))
            elif (n, value) > heap[0]:
                heapq.heapreplace(heap, (n, value))

        for b in batches:
            if not b.num_rows:
                continue
            labels, values, counts = b.column(0), b.column(1), b.column(2).to_numpy(zero_copy_only=False)
            changed = np.ones(b.num_rows, dtype=bool)
            if b.num_rows > 1:
                other = pc.or_(pc.not_equal(values[1:], values[:-1]), pc.not_equal(labels[1:], labels[:-1]))
                changed[1:] = other.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(changed)
            sums = np.add.reduceat(counts, starts)
            first = (labels[0].as_py(), values[0].as_py())
            if carry is not None:
                if carry[:2] == first:
                    sums[0] += carry[2]
                else:
                    offer(*carry)
            # the batch's last run may go on in the next batch
            carry = (labels[int(starts[-1])].as_py(), values[int(starts[-1])].as_py(), int(sums[-1]))
            body, counts_of = starts[:-1], sums[:-1]
            if len(body):
                named = labels.take(pa.array(body)).to_numpy(zero_copy_only=False)
                for label in dict.fromkeys(named):
                    here = np.flatnonzero(named == label)
                    heap = heaps.get(label, [])
                    least = heap[0][0] if len(heap) >= keep else 0
                    able = here[counts_of[here] >= least]
                    if len(able) > keep:  # the others cannot be among the largest
                        able = able[np.argpartition(counts_of[able], len(able) - keep)[len(able) - keep:]] \
                            if _no_tie(counts_of[able], keep) else able
                    for j in able:
                        offer(label, values[int(body[j])].as_py(), int(counts_of[j]))
        if carry is not None:
            offer(*carry)
        rows = [(label, v, n) for label, heap in heaps.items() for n, v in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                                          pa.array([r[2] for r in rows], pa.int64())], names=["label_name", "label_value", "n"])

    return run


def _no_tie(counts: np.ndarray, keep: int) -> bool:
    """Whether the ``keep`` largest counts are a definite set."""
    part = np.partition(counts, len(counts) - keep)
    edge = part[len(counts) - keep]
    return int((counts >= edge).sum()) == keep


def frequent_values(df: DataFrame, columns: Sequence[str], min_share: float = MIN_SHARE, run_rows: int = RUN_ROWS) -> DataFrame:
    """Values that at least ``min_share`` of all rows hold, per column, with exact counts.

    Result: ``label_name``, ``label_value``, ``n_rows``, ``share`` (of all
    rows, repeated ones and ones that miss the label too).  Null and ``''``
    are no values; values are compared byte by byte.  An empty table has no
    frequent values.  Columns other than ``columns`` are not read.

    External sort: map tasks write sorted runs with combined counts, the runs
    are range-partitioned by value, each range is merged in sort order and
    equal neighbours are added up.  Memory is bounded by a run and, per range,
    by a heap of ``1 / min_share`` values per column: no more can be frequent,
    so the heap loses none.  A hot value reaches its range once per run.  The
    runs are written to the shared folder, where ranges are sampled from and
    read; they also tell the number of rows, so ``df`` is read once.
    """
    ship(df.sparkSession)
    keep = math.ceil(1 / Fraction(str(min_share)))
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    written = cut_lineage(texts.mapInArrow(_runs(list(columns), run_rows), _RUN))
    total = written.where("label_name is null").agg(F.sum("n")).first()[0] or 0
    runs = written.where("label_name is not null")
    ranged = runs.repartitionByRange("label_name", "label_value").sortWithinPartitions("label_name", "label_value")
    tops = ranged.mapInArrow(_merge(keep), _RUN)
    least = math.ceil(Fraction(str(min_share)) * total)  # whole rows, so that no rounding moves the edge
    return tops.where(F.col("n") >= max(least, 1)).select(
        "label_name", "label_value", F.col("n").alias("n_rows"), (F.col("n") / F.lit(float(max(total, 1)))).alias("share"))
