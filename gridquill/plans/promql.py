"""A small time-series query language, compiled to one DataFrame plan.

``agg [by|without (labels)] (metric{label="v", ...})`` or the bare selector,
evaluated on the inclusive grid ``start, start+step, ... <= end`` (ms).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import readings
from ..operators.scan import Predicate
from ..operators.series import ChunkEngine
from ..schema import MAXT, MINT, NAME, SERIES, label, label_columns

AGGREGATIONS = ("sum", "count", "min", "max", "avg", "group")
#: How far back a step looks for a sample, in ms.
LOOKBACK_MS = 300_000

_TOKEN = re.compile(r'\s*(?:(?P<name>[A-Za-z_:][\w:]*)|(?P<string>"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\')'
                    r"|(?P<op>!=|=~|!~|[={}(),]))")


class QueryError(ValueError):
    """The query text is not in the language."""


@dataclass
class Query:
    matchers: list[Predicate] = field(default_factory=list)
    aggregation: str | None = None
    labels: list[str] = field(default_factory=list)
    without: bool = False


def parse(text: str) -> Query:
    """Parse a query; raises ``QueryError``."""
    tokens: list[tuple[str, str]] = []
    at = 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise QueryError(f"unexpected {text[at:at + 10]!r}")
        tokens.append((m.lastgroup or "", m.group(m.lastgroup or 0)))
        at = m.end()
    pos = 0

    def peek(k: int = 0) -> tuple[str, str]:
        return tokens[pos + k] if pos + k < len(tokens) else ("end", "")

    def take(kind: str | None = None, value: str | None = None) -> str:
        nonlocal pos
        k, v = peek()
        if (kind and k != kind) or (value and v != value) or k == "end":
            raise QueryError(f"expected {value or kind}, got {v or 'the end'!r}")
        pos += 1
        return v

    def names() -> list[str]:
        out = []
        take("op", "(")
        while peek()[1] != ")":
            out.append(take("name"))
            if peek()[1] == ",":
                take("op", ",")
        take("op", ")")
        return out

    def selector(q: Query) -> None:
        if peek()[0] == "name":
            q.matchers.append(Predicate(NAME, "=", take("name")))
        if peek()[1] == "{":
            take("op", "{")
            while peek()[1] != "}":
                column, op = take("name"), take("op")
                if op not in ("=", "!=", "=~", "!~"):
                    raise QueryError(f"unknown matcher {op!r}")
                raw = take("string")
                q.matchers.append(Predicate(column, op, re.sub(r"\\(.)", r"\1", raw[1:-1])))
                if peek()[1] == ",":
                    take("op", ",")
            take("op", "}")
        if not q.matchers:
            raise QueryError("a selector needs a name or a matcher")

    q = Query()
    if peek()[0] == "name" and peek()[1] in AGGREGATIONS and peek(1)[1] in ("(", "by", "without"):
        q.aggregation = take("name")
        clause = peek()[1] if peek()[1] in ("by", "without") else None
        if clause:
            take("name")
            q.labels, q.without = names(), clause == "without"
        take("op", "(")
        selector(q)
        take("op", ")")
        if clause is None and peek()[1] in ("by", "without"):
            q.without = take("name") == "without"
            q.labels = names()
    else:
        selector(q)
    if peek()[0] != "end":
        raise QueryError(f"unexpected {peek()[1]!r}")
    return q


def range_query(chunks: DataFrame, text: str, start: int, end: int, step: int, samples: str = "const",
                lookback: int = LOOKBACK_MS, mode: str = "containment", on_missing: str = "ignore") -> DataFrame:
    """Evaluate ``text`` at every step; rows ``(labels..., t, value)``.

    ``samples="const"`` gives each selected series the value 1 at every step;
    ``"decoded"`` takes the latest usable reading no older than ``lookback``.
    The grid is generated per row (``sequence``), so nothing is cross-joined;
    constant samples are the same at every step and are aggregated before it.
    """
    if step <= 0 or end < start:
        raise QueryError("the grid needs a positive step and start <= end")
    q = parse(text)
    known = label_columns(chunks)
    if q.without:
        out = [c for c in known if c not in q.labels and c != NAME]
    else:
        out = [c for c in dict.fromkeys(q.labels) if c in known] if q.aggregation else known
    engine = ChunkEngine(chunks, start - lookback, end, mode, on_missing)
    rows = engine.select(q.matchers)
    grid = F.sequence(F.lit(start).cast("long"), F.lit(end).cast("long"), F.lit(step).cast("long"))
    measure = {
        "sum": F.sum("v"), "count": F.count("v").cast("double"), "min": F.min("v"), "max": F.max("v"),
        "avg": F.avg("v"), "group": F.max(F.lit(1.0)), None: None,
    }[q.aggregation]
    if samples == "const":
        series = engine.select_series(q.matchers, out)
        if q.aggregation is not None:
            once = series.withColumn("v", F.lit(1.0)).groupBy(*out).agg(measure.alias("value"), F.count("v").alias("_n"))
            return once.where("_n > 0").select(*out, F.explode(grid).alias("t"), "value")
        values = series.select(SERIES, *out, F.explode(grid).alias("t"), F.lit(1.0).alias("v"))
    elif samples == "decoded":
        values = _decoded(rows, out, start, end, step, lookback)
    else:
        raise ValueError(f"unknown samples {samples!r}")
    if q.aggregation is None:
        return values.select(F.col(SERIES).cast("string").alias(SERIES), *out, "t", F.col("v").alias("value"))
    return values.groupBy(*out, "t").agg(measure.alias("value"))


def _decoded(rows: DataFrame, out: list[str], start: int, end: int, step: int, lookback: int) -> DataFrame:
    """Each reading offers itself to the steps it may serve; the latest wins."""
    kept = rows.select(SERIES, MINT, MAXT, *[label(c).alias(c) for c in out], "__chunk_bytes")
    samples = readings(kept, *out)
    first = F.greatest(F.lit(start), F.lit(start) + F.ceil((F.col("t") - start) / step) * step)
    last = F.least(F.lit(start) + F.floor((F.col("t") + lookback - 1 - start) / step) * step,
                   F.lit(start + (end - start) // step * step))
    offered = samples.withColumn("first", first.cast("long")).withColumn("last", last.cast("long")).where("first <= last")
    steps = offered.select(SERIES, *out, "t", "v", F.explode(F.sequence("first", "last", F.lit(step).cast("long"))).alias("at"))
    best = steps.groupBy(SERIES, *out, "at").agg(F.max(F.struct("t", "v")).alias("m"))
    return best.select(SERIES, *out, F.col("at").alias("t"), F.col("m.v").alias("v"))
