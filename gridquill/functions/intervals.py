"""Interval sets held as two independently sorted arrays, starts and ends.

With starts ``s`` and ends ``e`` sorted on their own, the union has a gap after
rank ``i`` exactly where ``s[i+1] > e[i] + slack``: the ``i`` smallest ends then
all belong to the ``i`` smallest starts.  Merging is associative, so partial
unions may be merged again in any order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_bounds(values: Column) -> Column:
    return F.sort_array(F.collect_list(values))


def period_starts(starts: Column, ends: Column, slack: Column | int = 0) -> Column:
    """Starts of the merged periods."""
    slack = F.lit(slack) if isinstance(slack, int) else slack
    return F.filter(starts, lambda x, i: (i == 0) | (x > F.get(ends, i - 1) + slack))


def period_ends(starts: Column, ends: Column, slack: Column | int = 0) -> Column:
    """Ends of the merged periods."""
    slack = F.lit(slack) if isinstance(slack, int) else slack
    return F.filter(ends, lambda x, i: (i == F.size(ends) - 1) | (F.get(starts, i + 1) > x + slack))


def covered_length(starts: Column, ends: Column) -> Column:
    """Length of the union: its extent less the gaps between ranks; 0 for no interval."""
    gaps = F.aggregate(
        F.sequence(F.lit(1), F.size(starts) - 1), F.lit(0).cast("long"),
        lambda acc, i: acc + F.greatest(F.get(starts, i) - F.get(ends, i - 1), F.lit(0).cast("long")))
    extent = F.get(ends, F.size(ends) - 1) - F.get(starts, F.lit(0))
    return F.when(F.size(starts) == 0, F.lit(0).cast("long")).when(F.size(starts) == 1, extent).otherwise(extent - gaps)
