"""Sorted Parquet parts and their compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIXED, PAYLOAD, chunk_schema, clustering_key, label_columns, text_labels

#: Rows per file of the write path.
ROWS_PER_PART = 262_144


def layout_options(df: DataFrame, bloom: dict[str, int] | None = None) -> dict[str, str]:
    """Writer options: small pages with a page index, delta-encoded bounds, zstd, bloom filters for labels.

    Each label has a bloom filter of a fitting size wherever its values outgrow
    the dictionary, which serves the same purpose as long as it holds them.
    ``bloom`` maps labels whose values are nearly all distinct to their expected
    number; they get a filter of that size and no dictionary.
    """
    options = {
        "compression": "zstd",
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.page.size": str(64 * 1024),
        "parquet.page.row.count.limit": "8192",
        "parquet.bloom.filter.adaptive.enabled": "true",
        **{f"parquet.enable.dictionary#{c}": "false" for c in FIXED if c in df.columns},
        **{f"parquet.bloom.filter.enabled#{c}": "true" for c in label_columns(df)},
    }
    for name, distinct in (bloom or {}).items():
        options |= {"parquet.bloom.filter.adaptive.enabled": "false", f"parquet.enable.dictionary#{name}": "false", f"parquet.bloom.filter.enabled#{name}": "true",
                    f"parquet.bloom.filter.expected.ndv#{name}": str(distinct)}
    return options


def conform(df: DataFrame, labels: list[str]) -> DataFrame:
    """Fixed columns, then labels ascending, as ``chunk_schema`` has them.

    Missing labels become ``''`` and missing payloads empty, so their columns
    are written as required ones; bounds may be null and stay so.
    """
    df, columns = text_labels(df), []
    for f in chunk_schema(labels):
        if f.name in FIXED[:3]:
            columns.append(F.col(f.name).cast(f.dataType).alias(f.name))
        else:
            empty = F.lit(b"" if f.name == PAYLOAD else "")
            columns.append((F.coalesce(F.col(f"`{f.name}`"), empty) if f.name in df.columns else empty).alias(f.name))
    return df.select(*columns)


def write_parts(df: DataFrame, path: str, labels: list[str], rows_per_part: int = ROWS_PER_PART,
                bloom: dict[str, int] | None = None, mode: str = "append") -> None:
    """Write sorted parts, one per input partition or more; no shuffle."""
    rows = conform(df, labels)
    (rows.sortWithinPartitions(*clustering_key(rows.columns)).write.mode(mode)
     .options(**layout_options(rows, bloom)).option("maxRecordsPerFile", rows_per_part).parquet(path))


def compact(spark: SparkSession, parts: str, target: str, files: int | None = None,
            bloom: dict[str, int] | None = None, mode: str = "overwrite") -> None:
    """Merge parts into range-partitioned files that are sorted within and across.

    Rows are kept as they are, repeated ones too; the parts stay.  The range
    runs over the whole clustering key, so a frequent name is split over files.
    """
    stored = spark.read.parquet(parts)
    rows = conform(stored, label_columns(stored))  # files lose what they say of required columns when read
    key = clustering_key(rows.columns)
    ranged = rows.repartitionByRange(files, *key) if files else rows.repartitionByRange(*key)
    ranged.sortWithinPartitions(*key).write.mode(mode).options(**layout_options(rows, bloom)).parquet(target)


__all__ = ["ROWS_PER_PART", "chunk_schema", "compact", "conform", "layout_options", "write_parts"]
