"""Schemas that drift between part files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, ship, spread

#: Keys of a record that are no label columns.
FIXED_KEYS = ("__series__id", "__mint", "__maxt", "__name__")
#: Share of comparable series whose value must agree for a rename.
RENAME_SHARE = 0.75
#: Files up to which their routes are broadcast (checked by counting); beyond it records are joined by file.
ROUTE_FILES = 20_000
_TYPES = ("string", "decimal", "boolean", "integer")


def _writer_key(writer: Column) -> Column:
    """A writer as text that is never null, so that plain equality will do in joins; the null writer is ``''``."""
    return F.coalesce(F.concat(F.lit("w"), writer.cast("string")), F.lit(""))


def _writer(key: Column, kind: T.DataType) -> Column:
    return F.when(key != "", F.substring(key, 2, 1 << 30)).cast(kind)


def _kind(t: Column, value: Column) -> Column:
    """The JSON type of a variant's schema; null where the value is missing (null or ``''``)."""
    return (F.when(t == "VOID", F.lit(None)).when(t == "BIGINT", "integer").when(t.startswith("DECIMAL") | (t == "DOUBLE"), "decimal")
            .when(t == "BOOLEAN", "boolean").when(value == "", F.lit(None)).otherwise("string"))


def canonical(value: Column) -> Column:
    """A value's text however typed: numbers by value, words in lower case."""
    # words are told by their first letter, since a cast that fails costs an exception
    number = F.when(value.rlike(r"^\s*[+-]?[0-9.nNiI]"), value.try_cast("double"))
    return F.coalesce(number.cast("string"), F.lower(F.trim(value)))


def label_votes(rows: DataFrame) -> DataFrame:
    """``(w, part_no, label, sid, kind, value, n)``: how often a series has a value in a part.

    Everything a comparison of parts needs, in one pass over the records; it is
    written to the shared folder, since several stages start from it.  ``w`` is
    the writer as text, ``kind`` the JSON type (null: the value is missing);
    objects and arrays count as strings.
    """
    parsed = spread(rows).select(_writer_key(F.col("writer_id")).alias("w"), "part_no", F.from_json("record", "map<string,variant>").alias("m"))
    sid = F.expr(f"try_variant_get(m['{FIXED_KEYS[0]}'], '$', 'bigint')")
    cells = parsed.where("part_no is not null").select("w", "part_no", sid.alias("sid"), F.explode("m").alias("label", "v"))
    cells = cells.where(~F.col("label").isin(*FIXED_KEYS)).select(
        "w", "part_no", "sid", "label", F.schema_of_variant("v").alias("t"), F.expr("try_variant_get(v, '$', 'string')").alias("text"))
    cells = cells.select("w", "part_no", "label", "sid", _kind(F.col("t"), F.col("text")).alias("kind"), canonical(F.col("text")).alias("value"))
    return cut_lineage(cells.groupBy("w", "part_no", "label", "sid", "kind", "value").agg(F.count(F.lit(1)).alias("n")))


def part_columns(votes: DataFrame) -> DataFrame:
    """``(w, part_no, label, kind)``: the label columns of each part with their type.

    The commonest type decides, so single stray values do not; ties go to the
    first of string, decimal, boolean, integer.  A column without any value has a null type.
    """
    counts = [F.sum(F.when(F.col("kind") == t, F.col("n")).otherwise(0)).alias(t) for t in _TYPES]
    counted = votes.groupBy("w", "part_no", "label").agg(*counts)
    best = F.greatest(*[F.col(t) for t in _TYPES])
    kind = F.when(best == 0, F.lit(None))
    for t in _TYPES:
        kind = kind.when(F.col(t) == best, t)
    return counted.select("w", "part_no", "label", kind.alias("kind"))


def fingerprinted_parts(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """One row per part: ``(w, part_no, previous, columns, before, fingerprint, changed, version, since)``.

    ``columns`` is the sorted list of ``(label, kind)``, ``before`` that of the
    writer's previous part; the fingerprint is a hash of the list, ``changed``
    whether it differs from the one before (true for a first part); ``version``
    counts the writer's changes from 1 up and ``since`` is the version's first
    part.  One small row per file meets in the window, never the records.
    """
    listed = part_columns(votes).groupBy("w", "part_no").agg(F.sort_array(F.collect_list(F.struct("label", "kind"))).alias("columns"))
    parts = rows.where("part_no is not null").select(_writer_key(F.col("writer_id")).alias("w"), "part_no").distinct()
    every = parts.join(listed, ["w", "part_no"], "left")  # a part may have no readable record
    columns = F.coalesce("columns", F.array().cast("array<struct<label:string,kind:string>>"))
    entries = F.transform("columns", lambda c: F.concat(c["label"], F.lit(":"), F.coalesce(c["kind"], F.lit("?"))))
    every = every.select("w", "part_no", columns.alias("columns")).withColumn("fingerprint", F.sha2(F.concat_ws(",", F.sort_array(entries)), 256))
    order = Window.partitionBy("w").orderBy("part_no")
    linked = every.select("*", F.lag("part_no").over(order).alias("previous"), F.lag("columns").over(order).alias("before"),
                          (~F.lag("fingerprint").over(order).eqNullSafe(F.col("fingerprint"))).alias("changed"))
    return linked.select(
        "w", "part_no", "previous", "columns", "before", "fingerprint", "changed", F.sum(F.col("changed").cast("int")).over(order).cast("int").alias("version"),
        F.max(F.when(F.col("changed"), F.col("part_no"))).over(order).alias("since"))


def schema_fingerprints(rows: DataFrame) -> DataFrame:
    """``(writer_id, part_no, n_labels, fingerprint, version)``.

    The fingerprint is a hash of the part's sorted ``label:type`` list; the
    version counts a writer's changes of fingerprint from 1 up.
    """
    parts = fingerprinted_parts(rows, label_votes(rows))
    return parts.select(_writer(F.col("w"), rows.schema["writer_id"].dataType).alias("writer_id"), "part_no", F.size("columns").alias("n_labels"),
                        "fingerprint", "version")


def schema_changes(rows: DataFrame, rename_share: float = RENAME_SHARE) -> DataFrame:
    """Every change of a writer's label columns from part to part.

    Result: ``writer_id, part_no, change_kind, old_label, new_label``; kinds
    are ``added``, ``removed``, ``renamed`` and ``retyped``.  Parts with the
    fingerprint of the one before have no changes and go no further.  A column
    that goes and one that comes are a rename if, over the series that have a
    value and occur in both parts, at least ``rename_share`` of the values
    agree, and each is the other's best match.

    Records that are no JSON object are skipped (their part still counts);
    repeated and late rows change nothing; rows without a part number are left
    out; a null writer is a writer of its own.  A first part has no changes,
    an empty table none at all.
    """
    steps = migration_steps(rows, rename_share)
    changes = steps.where("change_kind <> ''").select("writer_id", "part_no", "change_kind", "old_label", "new_label")
    return changes


def migration_steps(rows: DataFrame, rename_share: float = RENAME_SHARE) -> DataFrame:
    """The explicit steps that lead from each version of a writer's schema to the next.

    Result: ``writer_id, part_no`` (the first part of the new version),
    ``version, step, change_kind, old_label, new_label, old_type, new_type``.
    Steps are ``rename``, ``cast`` (``change_kind`` ``retyped``) and ``default``:
    a label that was added is null in records before, one that was removed is
    null in records after.
    """
    votes = label_votes(rows)
    parts = cut_lineage(fingerprinted_parts(rows, votes))
    return _steps(parts, votes, rename_share).select(
        _writer(F.col("w"), rows.schema["writer_id"].dataType).alias("writer_id"), "part_no", "version", "step", "change_kind", "old_label", "new_label",
        "old_type", "new_type")


def _steps(parts: DataFrame, votes: DataFrame, rename_share: float) -> DataFrame:
    changed = _with_sides(parts)
    pairs = _renames(changed, votes, rename_share)
    both = changed.join(pairs, ["w", "part_no"], "left")
    none = F.array().cast("array<struct<o:string,n:string>>")
    both = both.withColumn("pairs", F.coalesce("pairs", none))

    def step(name, change, old, new, old_type, new_type):
        return F.struct(F.lit(name).alias("step"), F.lit(change).alias("change_kind"), old.alias("old_label"), new.alias("new_label"),
                        old_type.cast("string").alias("old_type"), new_type.cast("string").alias("new_type"))

    def kind_in(columns: str, label: Column) -> Column:
        return F.get(F.filter(F.col(columns), lambda c: c["label"] == label), F.lit(0))["kind"]

    empty, null = F.lit(""), F.lit(None)
    untouched_new = F.filter("came", lambda c: ~F.exists("pairs", lambda p: p["n"] == c["label"]))
    untouched_old = F.filter("gone", lambda c: ~F.exists("pairs", lambda p: p["o"] == c["label"]))
    recast = F.filter("pairs", lambda p: kind_in("before", p["o"]) != kind_in("columns", p["n"]))
    steps = F.concat(
        F.transform("pairs", lambda p: step("rename", "renamed", p["o"], p["n"], kind_in("before", p["o"]), kind_in("columns", p["n"]))),
        F.transform(recast, lambda p: step("cast", "retyped", p["o"], p["n"], kind_in("before", p["o"]), kind_in("columns", p["n"]))),
        F.transform("retyped", lambda c: step("cast", "retyped", c["label"], c["label"], kind_in("before", c["label"]), c["kind"])),
        F.transform(untouched_new, lambda c: step("default", "added", empty, c["label"], null, c["kind"])),
        F.transform(untouched_old, lambda c: step("default", "removed", c["label"], empty, c["kind"], null)))
    return both.select("w", "part_no", "version", F.inline(steps))


def _with_sides(parts: DataFrame) -> DataFrame:
    """Parts whose fingerprint differs from the one before, with the columns that came, went or changed type."""
    changed = parts.where("changed and previous is not null")

    def missing_in(columns: str, others: str) -> Column:
        return F.filter(columns, lambda c: ~F.exists(others, lambda x: x["label"] == c["label"]))

    retyped = F.filter("columns", lambda c: F.exists("before", lambda x: (x["label"] == c["label"]) & (x["kind"] != c["kind"])))
    return changed.select("w", "part_no", "previous", "version", "columns", "before", missing_in("columns", "before").alias("came"),
                          missing_in("before", "columns").alias("gone"), retyped.alias("retyped"))


def _renames(changed: DataFrame, votes: DataFrame, rename_share: float) -> DataFrame:
    """``(w, part_no, pairs)``: the columns ``(o, n)`` of each part that are a rename."""
    able = changed.where((F.size("came") > 0) & (F.size("gone") > 0))
    # each part concerned, as the newer or the older side of a comparison, with the labels looked at there
    sides = able.select("w", "part_no", F.inline(F.array(
        F.struct(F.col("part_no").alias("own"), F.lit("n").alias("side"), F.transform("came", lambda c: c["label"]).alias("looked")),
        F.struct(F.col("previous").alias("own"), F.lit("o").alias("side"), F.transform("gone", lambda c: c["label"]).alias("looked")))))
    sides = sides.select(F.col("w").alias("lw"), F.col("part_no").alias("link"), "own", "side", "looked")
    held = votes.where("sid is not null").join(sides, (F.col("w") == F.col("lw")) & (F.col("part_no") == F.col("own")))
    # the other labels of a series only say that it occurs in the part
    told = F.col("kind").isNotNull() & F.array_contains("looked", F.col("label"))
    met = held.select("w", "link", "sid", "side", F.when(told, F.col("label")).alias("label"), F.when(told, F.col("value")).alias("value"), "n")
    counted = met.groupBy("w", "link", "sid", "side", "label", "value").agg(F.sum("n").alias("n"))
    # one value per label and series: the commonest, so strays do not count
    mode = counted.groupBy("w", "link", "sid", "side", "label").agg(F.max(F.struct("n", "value"))["value"].alias("value"))
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.struct("label", "value")))
    series = mode.groupBy("w", "link", "sid").agg(of("o").alias("old"), of("n").alias("new"))
    both = series.where((F.size("old") > 0) & (F.size("new") > 0)).select(
        "w", "link", F.filter("old", lambda x: x["label"].isNotNull()).alias("old"), F.filter("new", lambda x: x["label"].isNotNull()).alias("new"))
    # per series: the old labels, the new ones, and those of equal value; a schema's width bounds the lists
    absent = F.lit(None).cast("string")
    pair = lambda o, n: F.struct(o.alias("o"), n.alias("n"))
    keys = F.concat(
        F.transform("old", lambda x: pair(x["label"], absent)), F.transform("new", lambda x: pair(absent, x["label"])),
        F.flatten(F.transform("old", lambda x: F.transform(F.filter("new", lambda y: y["value"] == x["value"]), lambda y: pair(x["label"], y["label"])))))
    counts = both.select("w", "link", F.inline(keys)).groupBy("w", "link", "o", "n").agg(F.count(F.lit(1)).alias("m"))
    listed = counts.groupBy("w", "link").agg(F.collect_list(F.struct("o", "n", "m")).alias("l"))

    def size_of(side: str, label: Column) -> Column:
        return F.get(F.filter("l", lambda x: x["o"].isNull() & (x["n"] == label) if side == "n" else x["n"].isNull() & (x["o"] == label)), F.lit(0))["m"]

    scored = F.transform(F.filter("l", lambda x: x["o"].isNotNull() & x["n"].isNotNull()), lambda x: F.struct(
        (x["m"] / F.least(size_of("o", x["o"]), size_of("n", x["n"]))).alias("score"), x["m"].alias("m"), size_of("o", x["o"]).alias("n_old"),
        size_of("n", x["n"]).alias("n_new"), x["o"].alias("o"), x["n"].alias("n")))
    ranked = listed.select("w", "link", F.filter(scored, lambda x: x["score"] >= rename_share).alias("s"))
    rank = lambda x: F.struct(x["score"], x["m"], x["n_old"], x["n_new"])
    # each the other's best; of equals the first label by name
    better = lambda x, y, other: (rank(y) > rank(x)) | ((rank(y) == rank(x)) & (y[other] < x[other]))
    best = F.filter("s", lambda x: ~F.exists("s", lambda y: (y["o"] == x["o"]) & better(x, y, "n")) & ~F.exists("s", lambda y: (y["n"] == x["n"]) & better(x, y, "o")))
    return ranked.select("w", F.col("link").alias("part_no"), F.transform(best, lambda x: pair(x["o"], x["n"])).alias("pairs"))


_ROUTE = pa.list_(pa.struct([("label", pa.string()), ("target", pa.string()), ("cast_to", pa.string())]))


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Routes of each version, from versions sorted by writer and from the newest back.

    What is held is the schema of the version before last read: where its
    labels lead and the newest type of each target.
    """
    writer, targets, kinds, renames = object(), {}, {}, {}
    schema = pa.schema([("w", pa.string()), ("since", pa.int64()), ("route", _ROUTE)])
    for b in batches:
        out: list[tuple] = []
        for w, since, columns, pairs in zip(*[c.to_pylist() for c in b.columns]):
            if w != writer:
                writer, targets, kinds, renames = w, {}, {}, {}
            # all renames of one step apply at once; a label that is not there any more keeps its name
            targets = {c["label"]: targets.get(renames.get(c["label"], c["label"]), renames.get(c["label"], c["label"])) for c in columns}
            for c in columns:
                if c["kind"] is not None:
                    kinds.setdefault(targets[c["label"]], c["kind"])
            out.append((w, since, [{"label": a, "target": t, "cast_to": kinds.get(t)} for a, t in targets.items()]))
            renames = {p["o"]: p["n"] for p in pairs or ()}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)


def routes(parts: DataFrame, votes: DataFrame, rename_share: float = RENAME_SHARE) -> DataFrame:
    """``(w, part_no, route)``: per file a map from each label to its ``(target, cast_to)``, all steps chained.

    A writer's versions are read from the newest back, in sorted partitions and
    as a stream, one small row per version.
    """
    ship(parts.sparkSession)
    starts = parts.where("changed")
    renames = _renames(_with_sides(parts), votes, rename_share)
    rows = starts.join(renames, ["w", "part_no"], "left").select("w", F.col("part_no").cast("long").alias("since"), "columns", "pairs")
    ordered = rows.repartition("w").sortWithinPartitions("w", F.col("since").desc())
    led = ordered.mapInArrow(_follow, "w string, since bigint, route array<struct<label:string,target:string,cast_to:string>>")
    maps = led.select("w", "since", F.map_from_entries(F.transform("route", lambda x: F.struct(x["label"], F.struct(x["target"], x["cast_to"])))).alias("route"))
    return parts.select("w", "part_no", F.col("since").cast("long").alias("since")).join(maps, ["w", "since"]).select("w", "part_no", "route")


def consistent_table(rows: DataFrame, rename_share: float = RENAME_SHARE, route_files: int = ROUTE_FILES) -> DataFrame:
    """All records under each writer's newest column names and types.

    Result: ``writer_id, part_no, row_no, series_id, mint, maxt, name`` and five
    maps from newest label name to value, a label being in the map of its
    writer's newest type: ``strings``, ``integers``, ``decimals``, ``booleans``;
    ``unreadable`` has, as text, the values that this type cannot hold.  Each
    file is routed by its version's chained renames and casts; a label that a
    file lacks has its default, which is null: it is in no map.

    Of a record delivered twice the latest ``written_at`` stays (ties: the
    larger record).  Rows without a part or row number cannot be told to be one
    record unless they hold the same text, so each text of them stays; without a
    part number no route applies, and labels stay as they are, as text.  Records
    that are no JSON object have empty maps.  Should two columns of a record
    lead to one name, the larger text stays.  A null writer is a writer of its own.
    """
    votes = label_votes(rows)
    parts = cut_lineage(fingerprinted_parts(rows, votes))
    found = cut_lineage(routes(parts, votes, rename_share)).toDF("rw", "rp", "route")
    best = F.max(F.struct(F.col("written_at"), F.col("record")))["record"].alias("record")
    unnumbered = F.when(F.col("part_no").isNull() | F.col("row_no").isNull(), F.col("record"))
    once = rows.groupBy(_writer_key(F.col("writer_id")).alias("w"), "part_no", "row_no", unnumbered.alias("own_text")).agg(best)
    small = found.limit(route_files + 1).count() <= route_files
    met = once.join(F.broadcast(found) if small else found, (F.col("w") == F.col("rw")) & (F.col("part_no") == F.col("rp")), "left")
    parsed = met.select("w", "part_no", "row_no", "route", F.from_json("record", "map<string,variant>").alias("m"))
    entries = F.filter(F.coalesce(F.map_entries("m"), F.array().cast("array<struct<key:string,value:variant>>")), lambda x: ~x["key"].isin(*FIXED_KEYS))
    read = F.transform(entries, lambda x: F.struct(
        x["key"].alias("label"), F.try_element_at("route", x["key"]).alias("to"), F.try_variant_get(x["value"], "$", "string").alias("text")))
    given = F.filter(read, lambda x: x["text"] != "")  # a JSON null has no text
    routed = F.sort_array(F.transform(given, lambda x: F.struct(
        F.coalesce(x["to"]["target"], x["label"]).alias("target"), x["text"].alias("text"), F.coalesce(x["to"]["cast_to"], F.lit("string")).alias("cast_to"))))
    listed = parsed.select("w", "part_no", "row_no", "m", routed.alias("l"))
    single = listed.select("w", "part_no", "row_no", "m", F.filter(
        "l", lambda x, i: (i == F.size("l") - 1) | (F.get("l", i + 1)["target"] != x["target"])).alias("l"))

    def whole(text: Column) -> Column:
        exact = text.try_cast("decimal(38,6)")
        return F.when(exact == F.floor(exact), exact).try_cast("bigint")

    casts = {"string": lambda t: t, "integer": whole, "decimal": lambda t: t.try_cast("double"), "boolean": lambda t: t.try_cast("boolean")}
    cells = F.transform("l", lambda x: F.struct(
        x["target"].alias("target"), x["text"].alias("text"), *[F.when(x["cast_to"] == kind, cast(x["text"])).alias(kind) for kind, cast in casts.items()]))
    single = single.select("w", "part_no", "row_no", "m", cells.alias("cells"))

    def of(kind: str) -> Column:
        return F.map_from_entries(F.transform(F.filter("cells", lambda x: x[kind].isNotNull()), lambda x: F.struct(x["target"], x[kind])))

    unread = F.filter("cells", lambda x: F.coalesce(*[x[kind].cast("string") for kind in casts]).isNull())
    fixed = [F.expr(f"try_variant_get(m['{k}'], '$', '{t}')").alias(n) for k, t, n in (
        ("__series__id", "bigint", "series_id"), ("__mint", "bigint", "mint"), ("__maxt", "bigint", "maxt"), ("__name__", "string", "name"))]
    return single.select(
        _writer(F.col("w"), rows.schema["writer_id"].dataType).alias("writer_id"), "part_no", "row_no", *fixed,
        of("string").alias("strings"), of("integer").alias("integers"), of("decimal").alias("decimals"), of("boolean").alias("booleans"),
        F.map_from_entries(F.transform(unread, lambda x: F.struct(x["target"], x["text"]))).alias("unreadable"))
