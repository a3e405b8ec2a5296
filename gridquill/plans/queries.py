"""The registered queries of the core; each takes ``(spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payload import readings
from ..operators import drift, grid, periods, scan, skew, wide
from ..operators.distinct import unique_by
from ..operators.projection import arrow_batches, project
from ..operators.scan import Predicate, equals, gte, lte
from ..operators.series import ChunkEngine, assign_series_ids
from ..schema import MAXT, MINT, NAME, PAYLOAD, SERIES, label, make_chunk_rows
from ..session import scratch_dir
from ..sinks.writer import compact, write_parts
from ..sources.samples import samples_to_chunks
from ..sources.tables import epoch_ms, table
from .promql import range_query

Query = Callable[[SparkSession, str], DataFrame]

#: Bounds of the time-range queries, ms (inside the test data's fourteen days).
T0, T1 = 1_741_000_000_000, 1_741_300_000_000
#: Grid of the range queries, ms.
START, END, STEP = 1_741_000_020_000, 1_741_021_620_000, 1_800_000
#: The same over all fourteen days of the tables.
DAYS = (1_740_787_200_000, 1_741_996_800_000, 1_800_000)
#: Bucket of the chunks derived from ``events``, ms.
BUCKET = 7_200_000
LABELS = ["__name__", "container_id", "instance", "job", "namespace", "pod", "route"]
_IDS = [SERIES, MINT, MAXT]


def _index(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_index")


def _events_samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.lit("events").alias(NAME), "event_type", F.col("user_id").cast("string").alias("user_id"),
        epoch_ms("ts").alias("ms"), "event_id", F.round(F.col("value") * 100).cast("long").alias("cents"))


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Chunks derived from events: one per series and two-hour bucket."""
    cells = _events_samples(spark, d).withColumn("b", F.floor(F.col("ms") / BUCKET))
    keys = [NAME, "event_type", "user_id"]
    text = F.concat_ws(",", F.transform(
        F.sort_array(F.collect_list(F.struct("ms", "event_id", "cents"))), lambda x: F.concat_ws(":", x["ms"], x["cents"])))
    rows = cells.groupBy(*keys, "b").agg(F.min("ms").alias(MINT), F.max("ms").alias(MAXT), text.alias("payload"))
    return assign_series_ids(rows, keys).select(*_IDS, "payload", *keys)


def sample_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The conversion path: samples to chunk rows, payloads as text."""
    samples = _events_samples(spark, d).select(NAME, "event_type", "user_id", F.col("ms").alias("ts_ms"), F.col("cents").cast("double").alias("value"))
    rows = samples_to_chunks(samples, [NAME, "event_type", "user_id"], decimals=0)
    return rows.withColumn("payload", F.decode(PAYLOAD, "UTF-8")).drop(PAYLOAD)


def scan_equals(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [equals("job", "ingest")]).select(*_IDS, "namespace")


def scan_equals_absent(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [equals("job", "no such job")]).select(*_IDS)


def scan_gte(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [gte(MINT, T0)]).select(*_IDS)


def scan_lte(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [lte(MAXT, T0)]).select(*_IDS)


def scan_time_range(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [gte(MINT, T0), lte(MAXT, T1)]).select(*_IDS)


def scan_string_gte(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [gte("route", "/v2/")]).select(SERIES, MINT, "route")


def scan_string_lte(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [lte("namespace", "edge")]).select(SERIES, MINT, "namespace")


def scan_conjunction(spark: SparkSession, d: str) -> DataFrame:
    found = scan.scan(_index(spark, d), [lte(MAXT, T1), equals("namespace", "edge"), gte(MINT, T0), equals("job", "ingest")])
    return found.select(*_IDS, "job", "namespace")


def scan_missing_column_ignored(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [equals("no_such_label", "x"), equals("job", "ledger-api")]).select(*_IDS)


def scan_missing_column_empty(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [equals("no_such_label", "x")], "empty_string").select(*_IDS)


def scan_not_equals(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [Predicate("job", "!=", "ingest"), equals("namespace", "edge")]).select(*_IDS, "job")


def scan_regex(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [Predicate("job", "=~", "ledger.*|ing.*t")]).select(*_IDS, "job")


def scan_not_regex(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [Predicate("route", "!~", "/.*"), gte(MINT, T0)]).select(*_IDS, label("route").alias("route"))


def label_empty_string(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan(_index(spark, d), [equals("route", "")]).select(*_IDS, label("route").alias("route"))


def selection_num_rows(spark: SparkSession, d: str) -> DataFrame:
    return scan.num_rows(scan.scan(_index(spark, d), [equals("job", "ingest"), gte(MINT, T0)]))


def row_range_pick(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type")
    return scan.pick_ranges(rows, "event_id", [(10, 25), (40, 40), (100, 350), (340, 400)])


def row_range_skip(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("event_id", "event_type")
    return scan.skip_ranges(rows, "event_id", [(0, 500), (300, 900), (2000, 1 << 40)])


def project_columns(spark: SparkSession, d: str) -> DataFrame:
    return project(_index(spark, d), ["pod", SERIES, MINT])


def project_missing_skipped(spark: SparkSession, d: str) -> DataFrame:
    return project(_index(spark, d), ["no_such_label", "namespace", SERIES])


def project_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows that come in batches of at most 4,096, and whether any batch is larger."""
    cut = arrow_batches(project(_index(spark, d), ["pod", SERIES]), 4_096)
    return cut.agg(F.sum("n_rows").alias("n_rows"), (F.max("n_rows") <= 4_096).alias("bounded"))


def unique_by_column(spark: SparkSession, d: str) -> DataFrame:
    rows = _index(spark, d).where(F.col(MAXT).isNotNull()).select("instance", MINT, MAXT, SERIES)
    return unique_by(rows, "instance", [MINT, MAXT, SERIES])


def select_series(spark: SparkSession, d: str) -> DataFrame:
    return ChunkEngine(_index(spark, d), T0, T1).select_series([equals("namespace", "edge")]).withColumnRenamed(SERIES, "series_id")


def select_series_grouping(spark: SparkSession, d: str) -> DataFrame:
    out = ChunkEngine(_index(spark, d), T0, T1).select_series([equals("job", "ingest")], ["namespace", "instance", "nope"])
    return out.withColumnRenamed(SERIES, "series_id")


def select_series_ordered(spark: SparkSession, d: str) -> DataFrame:
    out = ChunkEngine(_index(spark, d), T0, T1).select_series_ordered([equals("job", "ingest")], ["namespace"])
    return out.withColumnRenamed(SERIES, "series_id")


def select_series_overlap(spark: SparkSession, d: str) -> DataFrame:
    out = ChunkEngine(_index(spark, d), T0, T0 + 3_600_000, mode="overlap").select_series([], ["job"])
    return out.withColumnRenamed(SERIES, "series_id")


def label_values(spark: SparkSession, d: str) -> DataFrame:
    return ChunkEngine(_index(spark, d)).label_values("instance", [equals("job", "ingest")])


def label_names(spark: SparkSession, d: str) -> DataFrame:
    return ChunkEngine(_index(spark, d)).label_names([equals("route", ""), equals("job", "ingest")])


def series_ids(spark: SparkSession, d: str) -> DataFrame:
    keyed = table(spark, d, "series").select("cluster", "job", "namespace").distinct()
    return assign_series_ids(keyed, ["cluster", "job", "namespace"]).withColumnRenamed(SERIES, "series_no")


def make_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "series").select(
        SERIES, F.col("scrape_ms").alias(MINT), F.create_map(F.lit("job"), F.col("job"), F.lit("zone"), F.col("cluster")).alias("labels"))
    return make_chunk_rows(rows, "labels", ["zone", "job", "absent"])


def read_chunk_bytes(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.scan(table(spark, d, "chunks"), [equals("job", "replayer")])
    return rows.select(SERIES, MINT, F.coalesce(F.octet_length(PAYLOAD), F.lit(0)).cast("long").alias("n_bytes"))


def decode_readings(spark: SparkSession, d: str) -> DataFrame:
    out = readings(table(spark, d, "chunks"))
    return out.groupBy(F.col(SERIES).alias("series_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.max("v").alias("max_v"))


def write_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Sorted parts written and read back."""
    path = scratch_dir(spark)
    write_parts(_index(spark, d), path, LABELS, rows_per_part=50_000)
    return spark.read.parquet(path).select(*_IDS, *LABELS)


def compact_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Three rounds of parts, compacted into range-partitioned files and read back."""
    path = scratch_dir(spark)
    rows = _index(spark, d)
    for r in range(3):
        write_parts(rows.where(F.pmod(MINT, F.lit(3)) == r), f"{path}/parts", LABELS, rows_per_part=100_000)
    compact(spark, f"{path}/parts", f"{path}/compact", bloom={"container_id": 400_000})
    return spark.read.parquet(f"{path}/compact").select(*_IDS, *LABELS)


def _prom(text: str, span: tuple[int, int, int] = (START, END, STEP), **more) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        source = table(spark, d, "chunks") if more.get("samples") == "decoded" else _index(spark, d)
        out = range_query(source, text, *span, **more)
        return out.withColumnRenamed(SERIES, "series_id").withColumnRenamed(NAME, "metric") if SERIES in out.columns else out
    return run


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    out = periods.periods_and_gaps(table(spark, d, "chunks"), SERIES, MINT, MAXT, table(spark, d, "series"), "scrape_ms")
    return out.withColumnRenamed(SERIES, "series_id")


def p3_series_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per series: periods, gaps and their total lengths."""
    spans = p3_found(spark, d)
    of = lambda kind: F.when(F.col("span_kind") == kind, F.col("end_ms") - F.col("start_ms"))
    return spans.groupBy("series_id").agg(
        F.count(of("period")).alias("n_periods"), F.count(of("gap")).alias("n_gaps"),
        F.sum(of("period")).alias("period_ms"), F.coalesce(F.sum(of("gap")), F.lit(0)).cast("long").alias("gap_ms"))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return wide.wide_table(table(spark, d, "label_rows"), table(spark, d, "label_catalog"))


def p4_wide(spark: SparkSession, d: str) -> DataFrame:
    """The wide table, its map of other labels written as text."""
    out = _wide(spark, d)
    filled = F.map_filter(wide.OTHER, lambda k, v: v.isNotNull())
    return out.withColumn(wide.OTHER, filled).select(*[_listed(c) if c == wide.OTHER else F.col(f"`{c}`") for c in out.columns])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wide.filled_cells(_wide(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_changes(table(spark, d, "part_rows"))


def _listed(column: str, value: Callable[[Column], Column] = lambda v: v.cast("string")) -> Column:
    """A map as text, ``label=value`` in the order of the labels."""
    entries = F.transform(F.array_sort(F.map_keys(column)), lambda k: F.concat(k, F.lit("="), value(F.element_at(column, k))))
    return F.array_join(entries, "|").alias(column)


def p5_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every record under its writer's newest names and types, the typed maps written as text."""
    out = drift.consistent_table(table(spark, d, "part_rows"))
    fixed = [c for c in out.columns if not isinstance(out.schema[c].dataType, T.MapType)]
    return out.select(*fixed, _listed("strings"), _listed("integers"), _listed("decimals", lambda v: F.format_string("%.6f", v)),
                      _listed("booleans"), _listed("unreadable"))


def p5_steps(spark: SparkSession, d: str) -> DataFrame:
    return drift.migration_steps(table(spark, d, "part_rows"))


def p5_versions(spark: SparkSession, d: str) -> DataFrame:
    return drift.schema_fingerprints(table(spark, d, "part_rows"))


def p6_span_summary(spark: SparkSession, d: str) -> DataFrame:
    return skew.span_summary(_index(spark, d), SERIES, LABELS, MINT, MAXT)


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(table(spark, d, "chunks"), table(spark, d, "series"))


def p7_grid(spark: SparkSession, d: str) -> DataFrame:
    """The grid, values to nine decimals."""
    return _grid(spark, d).withColumn("value", F.round("value", 9))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d).where("n_readings = 0").select("series_id", "slot_ms")


def p7_series_summary(spark: SparkSession, d: str) -> DataFrame:
    """Per series: cells of the grid, those observed and filled, and the time covered."""
    of = lambda status: F.count(F.when(F.col("status") == status, 1))
    return _grid(spark, d).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_slots"), of("observed").alias("n_observed"), of("filled").alias("n_filled"),
        F.sum(F.round(F.col("coverage") * grid.SLOT_MS)).cast("long").alias("covered_ms"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    scan_equals, scan_equals_absent, scan_gte, scan_lte, scan_time_range, scan_string_gte, scan_string_lte,
    scan_conjunction, scan_missing_column_ignored, scan_missing_column_empty, scan_not_equals, scan_regex,
    scan_not_regex, label_empty_string, selection_num_rows, row_range_pick, row_range_skip, project_columns,
    project_missing_skipped, unique_by_column, project_batches, select_series, select_series_grouping, select_series_overlap, select_series_ordered,
    label_values, label_names, series_ids, make_rows, chunk_rows, sample_chunks, read_chunk_bytes, decode_readings,
    write_roundtrip, compact_roundtrip,
)} | {
    "promql_sum": _prom('sum(beacon_retry_total{namespace!="lab"})'),
    "promql_sum_by": _prom("sum by (job, namespace) (beacon_retry_total)"),
    "promql_count_without": _prom('count without (container_id, instance, pod, route) ({job=~"ing.*"})'),
    "promql_sum_by_fortnight": _prom("sum by (job, namespace) ({job!=\"\"})", DAYS),
    "promql_decoded_max_fortnight": _prom("max by (cluster) ({job!=\"\"})", DAYS, samples="decoded", mode="overlap"),
    "promql_selector": _prom('{job="ingest", route=""}'),
    "promql_decoded_max": _prom("max by (cluster) ({job!=\"\"})", samples="decoded", mode="overlap"),
} | {f.__name__: f for f in (
    p3_found, p3_series_coverage, p4_found, p4_wide, p5_found, p5_consistent, p5_steps, p5_versions, p6_span_summary, p7_found, p7_grid,
    p7_series_summary,
)}
