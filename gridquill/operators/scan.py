"""Predicates over chunk tables and row-range selection.

Everything is a conjunction of plain column comparisons, so filters reach the
Parquet reader (statistics, dictionaries, bloom filters, page index).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import clustering_key


class MissingColumn(ValueError):
    """A predicate names a column the table lacks."""


@dataclass(frozen=True)
class Predicate:
    """``column op value``; ``op`` is one of ``= != >= <= =~ !~``."""

    column: str
    op: str
    value: Any

    def condition(self, kind: T.DataType = T.StringType()) -> Column:
        """The comparison with a column of type ``kind``.

        In a text column, and in one of bytes (labels stored without a text
        annotation), ``''`` and null both mean a missing label, which compares
        as ``''``; other types have no missing value, and null meets nothing.
        """
        c = F.col(f"`{self.column}`")
        if self.op in ("=~", "!~"):
            hit = F.coalesce(c.cast("string"), F.lit("")).rlike(f"^(?:{self.value})$")
            return hit if self.op == "=~" else ~hit
        text, value = isinstance(kind, (T.StringType, T.BinaryType)), self.value
        if isinstance(kind, T.BinaryType) and isinstance(value, str):
            value = value.encode()  # bytes are compared with bytes, so that the filter still reaches the reader
        hit = {"=": c.__eq__, "!=": c.__eq__, ">=": c.__ge__, "<=": c.__le__}.get(self.op, self._unknown)(value)
        if text and self.on_absent() == (self.op != "!="):
            hit = hit | c.isNull()
        return ~F.coalesce(hit, F.lit(False)) if self.op == "!=" else hit

    def _unknown(self, value: Any) -> Column:
        raise ValueError(f"unknown operator {self.op!r}")

    def on_absent(self) -> bool:
        """What the predicate says when the column is taken as ``''`` everywhere."""
        verdict = {
            "=": self.value == "",
            "!=": self.value != "",
            ">=": "" >= str(self.value),
            "<=": "" <= str(self.value),
        }
        if self.op in verdict:
            return verdict[self.op]
        return (re.fullmatch(str(self.value), "") is not None) == (self.op == "=~")


def equals(column: str, value: Any) -> Predicate:
    return Predicate(column, "=", value)


def gte(column: str, value: Any) -> Predicate:
    return Predicate(column, ">=", value)


def lte(column: str, value: Any) -> Predicate:
    return Predicate(column, "<=", value)


def scan(df: DataFrame, predicates: Iterable[Predicate] = (), on_missing: str = "ignore") -> DataFrame:
    """Rows that meet every predicate.

    ``on_missing`` rules predicates on columns the table lacks: ``"ignore"``
    drops them, ``"error"`` raises, ``"empty_string"`` takes the label as ``''``.
    Conjuncts are written in clustering order, cheapest to prune first.
    """
    wanted = list(predicates)
    order = {c: i for i, c in enumerate(clustering_key(df.columns))}
    conditions: list[Column] = []
    for p in sorted(wanted, key=lambda p: (order.get(p.column, len(order)), p.column)):
        if p.column in df.columns:
            conditions.append(p.condition(df.schema[p.column].dataType))
        elif on_missing == "error":
            raise MissingColumn(p.column)
        elif on_missing == "empty_string":
            conditions.append(F.lit(p.on_absent()))
        elif on_missing != "ignore":
            raise ValueError(f"unknown policy {on_missing!r}")
    return df.where(reduce(Column.__and__, conditions)) if conditions else df


def in_ranges(index: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether ``index`` lies in one of the half-open ranges; none selects nothing."""
    parts = [(index >= a) & (index < b) for a, b in ranges if b > a]
    return reduce(Column.__or__, parts) if parts else F.lit(False)


def pick_ranges(df: DataFrame, index: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows whose ``index`` lies in the half-open ranges."""
    return df.where(in_ranges(F.col(index), ranges))


def skip_ranges(df: DataFrame, index: str, ranges: Sequence[tuple[int, int]]) -> DataFrame:
    """Rows whose ``index`` lies in none of the half-open ranges (all rows if there are none)."""
    return df.where(~in_ranges(F.col(index), ranges))


def num_rows(df: DataFrame) -> DataFrame:
    """One row with the number of rows selected."""
    return df.agg(F.count(F.lit(1)).alias("num_rows"))
