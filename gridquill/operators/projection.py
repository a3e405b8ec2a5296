"""Column projection and bounded batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

_BATCH = pa.schema([("n_rows", pa.int64()), ("batch", pa.binary())])


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns in the given order; unknown names are left out.

    Raises ``ValueError`` if none is known, since an empty projection has no rows to give.
    """
    known = [c for c in columns if c in df.columns]
    if not known:
        raise ValueError(f"none of {list(columns)} is a column")
    return df.select(*[F.col(f"`{c}`") for c in known])


def arrow_batches(df: DataFrame, batch_size: int = 32_768) -> DataFrame:
    """``(n_rows, batch)``: the rows as Arrow streams of at most ``batch_size`` rows, cut by the executors.

    No batch crosses a partition; an empty partition has none.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    ship(df.sparkSession)

    def cut(incoming: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def packed(n: int) -> pa.RecordBatch:
            nonlocal held, rows
            table = pa.Table.from_batches(held)
            whole, rest = table.slice(0, n).combine_chunks(), table.slice(n)
            held, rows = rest.to_batches(), rest.num_rows
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema) as writer:
                writer.write_table(whole)
            return pa.RecordBatch.from_pydict({"n_rows": [n], "batch": [sink.getvalue().to_pybytes()]}, schema=_BATCH)

        for b in incoming:
            held.append(b)
            rows += b.num_rows
            while rows >= batch_size:
                yield packed(batch_size)
        if rows:
            yield packed(rows)

    return df.mapInArrow(cut, "n_rows bigint, batch binary")


def batches(df: DataFrame, batch_size: int = 32_768) -> Iterator[pa.RecordBatch]:
    """Column batches of at most ``batch_size`` rows, one partition's batches in driver memory at a time."""
    for row in arrow_batches(df, batch_size).toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(row.batch).read_all().to_batches()
