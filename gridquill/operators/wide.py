"""Attribute-value rows into one typed row per entity."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parse
from ..session import ship

#: Rows per reduce task.
ROWS_PER_TASK = 250_000
#: Column of the wide table for labels outside the catalogue.
OTHER = "other_labels"

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
          "timestamp": T.TimestampNTZType()}
_EPOCH = datetime(1970, 1, 1)
_OLDEST = -(1 << 63)


def name_key(name: Column) -> Column:
    """Letters and digits of a label name in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def _encoders() -> dict:
    """Typed encoders: from a register's text to the column's value."""
    return {"string": str, "bigint": int, "double": float, "boolean": lambda x: x == "true",
            "timestamp": lambda x: _EPOCH + timedelta(milliseconds=int(x))}


def read_catalog(catalog: DataFrame) -> list[tuple[str, str, str]]:
    """``(key, name, type)`` per catalogue entry, one per key (the smallest name).

    Every entry is a column of the wide table, so this is as large as its schema.
    """
    rows = catalog.where(F.col("label_name").isNotNull()).select(name_key(F.col("label_name")).alias("k"), "label_name", "label_type").distinct().collect()
    out: dict[str, tuple[str, str, str]] = {}
    for k, name, kind in sorted(tuple(r) for r in rows):
        if kind not in _TYPES:
            raise ValueError(f"unknown type {kind!r} of {name!r}")
        out.setdefault(k, (k, name, kind))
    return sorted(out.values(), key=lambda x: x[1])


def wide_table(rows: DataFrame, catalog: DataFrame, entity: str = "series_id", row_id: str = "row_id",
               name: str = "label_name", value: str = "label_value", seen: str = "seen_at") -> DataFrame:
    """One row per entity: a typed column per catalogue label and a map of the others.

    A name belongs to the catalogue entry with the same letters and digits;
    other names are text under their own spelling, in the map ``other_labels``
    (their number is not bounded, a table's columns are).  For each cell the
    row seen last decides (null is oldest, ties: larger ``row_id``, a null one
    smallest); a null, blank or unreadable value empties the cell.

    Rows without a name (null or ``''``) fill no cell but their entity still
    has its row; a null entity is one of its own.  An empty table gives none.

    ``combineByKey`` over slot registers: each map task keeps one register per
    entity and label, mergers are associative, so only settled registers are
    shuffled and a hot entity costs each task one register set.  Text is parsed
    before that, in the JVM; there are as many reduce tasks as the rows, counted, need.
    """
    entries = read_catalog(catalog)
    spark = rows.sparkSession
    # catalogue slots are numbered; other labels go by their spelling after a mark
    slots = spark.createDataFrame([(k, f"c{i}", t) for i, (k, _, t) in enumerate(entries)], "_key string, _slot string, _kind string")
    given = rows.select(F.col(f"`{entity}`").alias("e"), F.col(f"`{row_id}`").cast("long").alias("row"), F.col(f"`{name}`").alias("name"),
                        F.col(f"`{value}`").alias("text"), F.col(f"`{seen}`").alias("seen"))
    # broadcast: the catalogue is as small as the wide table's schema
    matched = given.join(F.broadcast(slots), name_key(F.col("name")) == F.col("_key"), "left")
    slot = F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.lit(None)).otherwise(F.coalesce("_slot", F.concat(F.lit("o"), F.col("name"))))
    kind, text = F.coalesce("_kind", F.lit("string")), F.col("text")
    cell = (F.when(kind == "string", parse.stripped(text))
            .when(kind == "bigint", parse.to_bigint(text).cast("string"))
            .when(kind == "double", parse.to_double(text).cast("string"))
            .when(kind == "boolean", parse.to_boolean(text).cast("string"))
            .when(kind == "timestamp", parse.to_epoch_ms(text).cast("string")))
    order = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', seen)")
    cells = matched.select("e", slot.alias("slot"), F.coalesce(order, F.lit(_OLDEST)).alias("at"),
                           F.coalesce("row", F.lit(_OLDEST)).alias("row"), kind.alias("kind"), cell.alias("cell"))
    # instants of no year that can be written are unreadable
    odd = (F.col("kind") == "timestamp") & ~F.col("cell").try_cast("bigint").between(parse.FIRST_MS, parse.LAST_MS)
    cells = cells.select("e", "slot", "at", "row", F.when(~F.coalesce(odd, F.lit(False)), F.col("cell")).alias("cell"))

    def create(c: tuple) -> dict:
        return {c[0]: c[1:]} if c[0] is not None else {}

    def later(a: tuple, b: tuple) -> bool:
        return (a[0], a[1], a[2] or "") > (b[0], b[1], b[2] or "")

    def merge_cell(register: dict, c: tuple) -> dict:
        if c[0] is not None:
            held = register.get(c[0])
            if held is None or later(c[1:], held):
                register[c[0]] = c[1:]
        return register

    def merge_registers(a: dict, b: dict) -> dict:
        if len(a) < len(b):
            a, b = b, a
        for s, c in b.items():
            held = a.get(s)
            if held is None or later(c, held):
                a[s] = c
        return a

    ship(spark)
    fewest = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    partitions = max(fewest, -(-rows.count() // ROWS_PER_TASK))
    registers = cells.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4]))).combineByKey(
        create, merge_cell, merge_registers, numPartitions=partitions)
    kinds = [t for _, _, t in entries]

    def emit(entity_register: tuple) -> tuple:
        e, register = entity_register
        encode = _encoders()
        out = [e]
        for i, t in enumerate(kinds):
            text = register.get(f"c{i}", (None, None, None))[2]
            out.append(None if text is None else encode[t](text))
        out.append({s[1:]: c[2] for s, c in register.items() if s[0] == "o" and c[2] is not None})
        return tuple(out)

    schema = T.StructType([T.StructField(entity, rows.schema[entity].dataType)]
                          + [T.StructField(n, _TYPES[t]) for _, n, t in entries]
                          + [T.StructField(OTHER, T.MapType(T.StringType(), T.StringType()))])
    return spark.createDataFrame(registers.map(emit), schema, verifySchema=False)


def filled_cells(wide: DataFrame, entity: str = "series_id") -> DataFrame:
    """The filled cells of a wide table as ``(entity, label_name, cell_text)``.

    Text by type: plain digits, three decimals, ``true``/``false``, epoch milliseconds.
    """
    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            return F.when(c.isNotNull(), F.format_string("%.3f", c))
        if isinstance(f.dataType, T.TimestampNTZType):
            return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{f.name}`)").cast("string")
        return c.cast("string")

    typed = [f for f in wide.schema if f.name not in (entity, OTHER)]
    known = F.map_from_arrays(F.array(*[F.lit(f.name) for f in typed]), F.array(*[text(f) for f in typed])) if typed else None
    every = F.map_entries(OTHER) if known is None else F.concat(F.map_entries(known), F.map_entries(OTHER))
    cells = wide.select(F.col(entity), F.inline(every)).toDF(entity, "label_name", "cell_text")
    return cells.where(F.col("cell_text").isNotNull())
