"""The chunk table: one row per time slice of one labelled series."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES, MINT, MAXT, PAYLOAD, NAME = "__series__id", "__mint", "__maxt", "__chunk_bytes", "__name__"
#: The four columns every chunk table starts with, in this order.
FIXED = (SERIES, MINT, MAXT, PAYLOAD)
#: Columns a table may carry that are neither fixed nor labels.
BOOKKEEPING = ("received_at",)


def chunk_schema(label_names: Iterable[str]) -> T.StructType:
    """Fixed columns, then one string column per label name in ascending order."""
    fixed = [T.StructField(c, T.LongType(), False) for c in FIXED[:3]]
    fixed.append(T.StructField(PAYLOAD, T.BinaryType(), False))
    return T.StructType(fixed + [T.StructField(c, T.StringType(), False) for c in sorted(set(label_names))])


def label_columns(df: DataFrame) -> list[str]:
    """The label columns of a chunk table, ascending: text, or bytes where a writer gave no text annotation."""
    taken = {*FIXED, *BOOKKEEPING}
    return sorted(f.name for f in df.schema if f.name not in taken and isinstance(f.dataType, (T.StringType, T.BinaryType)))


def text_labels(df: DataFrame) -> DataFrame:
    """``df`` with labels that are stored as bytes read as text; all other columns stay."""
    stored = {f.name for f in df.schema if isinstance(f.dataType, T.BinaryType)} & {*label_columns(df)}
    if not stored:
        return df
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in stored else F.col(f"`{c}`") for c in df.columns])


def clustering_key(columns: Iterable[str]) -> list[str]:
    """Order in which rows lie on disk: name, time bounds, then the other labels ascending."""
    first = [NAME, MINT, MAXT]
    present = set(columns)
    return [c for c in first if c in present] + sorted(present - {*first, SERIES, PAYLOAD, *BOOKKEEPING})


def label(name: str) -> Column:
    """A label's value; a missing label is the empty string."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def make_chunk_rows(df: DataFrame, labels: str, label_names: Iterable[str]) -> DataFrame:
    """Flatten a ``map<string,string>`` column into label columns.

    Labels outside ``label_names`` are left out; missing ones become ``''``.
    """
    fixed = [F.col(c) for c in FIXED if c in df.columns]
    flat = [F.coalesce(F.col(labels)[n], F.lit("")).alias(n) for n in sorted(set(label_names))]
    return df.select(*fixed, *flat)
