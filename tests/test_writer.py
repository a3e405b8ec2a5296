import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gridquill.schema import clustering_key
from gridquill.sinks.writer import compact, conform, layout_options, write_parts
from support import rows


def test_parts_and_compaction(spark, tmp_path):
    df = spark.range(3000).select(
        F.col("id").alias("__series__id"), (F.col("id") * 7 % 1000).alias("__mint"), (F.col("id") * 7 % 1000 + 5).alias("__maxt"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("m"), F.col("id") % 3)).alias("__name__"), (F.col("id") % 11).cast("string").alias("job"))
    labels = ["__name__", "job", "zone"]
    for part in range(3):
        write_parts(df.where(F.col("__series__id") % 3 == part),
                    f"{tmp_path}/parts", labels, rows_per_part=400)
    back = spark.read.parquet(f"{tmp_path}/parts")
    assert back.columns == ["__series__id", "__mint", "__maxt", "__chunk_bytes", "__name__", "job", "zone"]
    assert max(pq.ParquetFile(f).metadata.num_rows for f in glob.glob(f"{tmp_path}/parts/*.parquet")) <= 400
    compact(spark, f"{tmp_path}/parts", f"{tmp_path}/whole", files=2, bloom={"job": 20})
    whole = spark.read.parquet(f"{tmp_path}/whole")
    assert rows(whole.drop("__chunk_bytes")) == rows(back.drop("__chunk_bytes"))
    assert rows(whole.drop("__chunk_bytes", "zone")) == rows(df.withColumn("__name__", F.coalesce("__name__", F.lit(""))))
    key = clustering_key(whole.columns)
    files = [pq.read_table(f).to_pylist() for f in sorted(glob.glob(f"{tmp_path}/whole/*.parquet"))]
    assert len(files) == 2
    keys = [tuple(r[k] for k in key) for f in files for r in f]
    assert keys == sorted(keys)
    first = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/whole/*.parquet"))[0])
    assert [c.name for c in first.schema_arrow if not c.nullable] == ["__chunk_bytes", "__name__", "job", "zone"]
    assert first.metadata.row_group(0).column(5).dictionary_page_offset is None  # job: a filter instead
    meta = pq.ParquetFile(sorted(glob.glob(f"{tmp_path}/whole/*.parquet"))[0]).metadata.row_group(0).column(1)
    assert "DELTA_BINARY_PACKED" in meta.encodings and meta.compression == "ZSTD"


def test_labels_have_filters_by_default(spark, tmp_path):
    df = spark.range(40_000).select(F.col("id").alias("__series__id"), F.col("id").alias("__mint"), F.col("id").alias("__maxt"), F.lit("m").alias("__name__"),
                                    F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit("x")).alias("pod"), F.lit("j").alias("job"))
    write_parts(df.coalesce(1), f"{tmp_path}/t", ["__name__", "job", "pod"])
    options = layout_options(conform(df, ["pod", "job"]))
    assert {k for k in options if k.startswith("parquet.bloom.filter.enabled#")} == {f"parquet.bloom.filter.enabled#{c}" for c in ("pod", "job")}
    (path,) = glob.glob(f"{tmp_path}/t/*.parquet")
    columns = {(c := pq.ParquetFile(path).metadata.row_group(0).column(i)).path_in_schema: c for i in range(7)}
    assert "PLAIN" in str(columns["pod"].encodings) or "DELTA" in str(columns["pod"].encodings)  # outgrew the dictionary
    assert os.path.getsize(path) > sum(columns[c].total_compressed_size for c in columns) + 10_000  # so its filter is there
