"""The registered queries of this subpackage; each takes ``(spark, folder)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import MINT, SERIES, label
from ..session import cut_lineage
from ..sources.tables import table
from . import bitmaps, encoding, frequent, leakage, mixing

Query = Callable[[SparkSession, str], DataFrame]

FREQUENT_COLUMNS = ("pod", "route", "container_id")


def p1_frequent_values(spark: SparkSession, d: str) -> DataFrame:
    return frequent.frequent_values(table(spark, d, "chunk_index"), FREQUENT_COLUMNS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_frequent_values(spark, d).select("label_name", "label_value")


def _ids() -> dict[str, Column]:
    return {"series": F.col(SERIES), "pod": F.col("pod"), "container_id": F.col("container_id")}


def _dims() -> dict[str, Column]:
    day = F.date_from_unix_date(F.floor(F.col(MINT) / 86_400_000).cast("int"))
    return {"day": day, "namespace": label("namespace"), "job": label("job")}


def p2_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return bitmaps.distinct_cube(table(spark, d, "chunk_index"), _ids(), _dims())


def _plain_day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


def p2_distinct_counts_md5(spark: SparkSession, d: str) -> DataFrame:
    """As above, of the same size, with a hash that SQL can follow bit by bit."""
    return _plain_day(bitmaps.distinct_cube(table(spark, d, "chunk_index"), _ids(), _dims(), how="md5"))


def p2_merged_loads(spark: SparkSession, d: str) -> DataFrame:
    """The same counts from three loads, by day of arrival, whose bitmaps differ in size."""
    rows = table(spark, d, "chunk_index")
    bits = bitmaps.bits_for(max(rows.count(), 1))
    arrived = F.coalesce(F.unix_date(F.col("received_at").cast("date")), F.lit(0))
    loads = [bitmaps.partial_bitmaps(rows.where(F.pmod(arrived, F.lit(3)) == i), _ids(), _dims(), bits << i, "md5") for i in range(3)]
    return _plain_day(bitmaps.cube_estimates(bitmaps.merge_bitmaps(*loads), list(_dims()), bits))


def p2_bound_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every estimate next to the exact count, and whether its bound holds."""
    keys = ["id_kind", "level", "day", "namespace", "job"]
    exact = _plain_day(bitmaps.exact_cube(table(spark, d, "chunk_index"), _ids(), _dims()))
    both = p2_distinct_counts_md5(spark, d).unionByName(exact, allowMissingColumns=True)
    met = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("n_distinct", "error_count", "n_exact")])
    return met.withColumn("within_bound", F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.col("error_count"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_report(spark, d).select("doc_id", "item_id")


def p8_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """The documents that hold twelve consecutive words of a passage."""
    return p8_report(spark, d).where("match_kind = 'verbatim'").select("doc_id", "item_id")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    plan = mixing.plan_mixture(cut_lineage(mixing.token_counts(documents)), table(spark, d, "mix_targets"))
    return mixing.mix(documents, plan)


def _in_characters(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Share]]:
    counts = mixing.character_counts(table(spark, d, "documents"))
    return counts, mixing.plan_mixture(counts, table(spark, d, "mix_targets"))


def p9_mix_characters(spark: SparkSession, d: str) -> DataFrame:
    """The mixture by characters, a size that SQL can follow."""
    documents = table(spark, d, "documents").select("doc_id", "source")
    return mixing.mix(documents, _in_characters(spark, d)[1])


def p9_shares_characters(spark: SparkSession, d: str) -> DataFrame:
    out = mixing.reached_shares(*_in_characters(spark, d))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    counts = cut_lineage(mixing.token_counts(table(spark, d, "documents")))
    return mixing.reached_shares(counts, mixing.plan_mixture(counts, table(spark, d, "mix_targets")))


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.find_garbled(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_restored(spark, d).select("doc_id")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_frequent_values, p2_distinct_counts, p2_distinct_counts_md5,
                                                  p2_merged_loads, p2_bound_checked,
                                                  p8_found, p8_report, p8_verbatim, p9_mix, p9_shares, p9_mix_characters, p9_shares_characters,
                                                  p10_found, p10_restored)}
