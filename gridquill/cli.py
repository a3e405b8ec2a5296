"""Command line: convert samples or blocks to a chunk table, read a chunk table.

    python -m gridquill.cli convert SAMPLES OUT --labels job,instance
    python -m gridquill.cli convert-blocks OUT BLOCK [BLOCK ...]
    python -m gridquill.cli read TABLE --metric NAME --columns __chunk_bytes
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.projection import project
from .operators.scan import equals, scan
from .operators.series import assign_series_ids
from .schema import NAME, PAYLOAD, make_chunk_rows
from .session import RECOMMENDED
from .sinks.writer import compact, write_parts
from .sources.blocks import read_blocks
from .sources.samples import samples_to_chunks


def convert(spark: SparkSession, samples: str, out: str, labels: Sequence[str], files: int | None = None) -> None:
    """Samples (Parquet with the labels, ``ts_ms`` and ``value``) to ``out/parts`` and ``out/compact``."""
    chunks = samples_to_chunks(spark.read.parquet(samples), list(labels))
    write_parts(chunks, f"{out}/parts", list(labels), mode="overwrite")
    compact(spark, f"{out}/parts", f"{out}/compact", files)


def convert_blocks(spark: SparkSession, blocks: Sequence[str], out: str, files: int | None = None) -> None:
    """Blocks to ``out/parts`` and ``out/compact``, with a column for every label name that occurs."""
    rows = read_blocks(spark, blocks)
    names = sorted(r[0] for r in rows.select(F.explode(F.map_keys("labels"))).distinct().collect())  # the columns of the table
    chunks = assign_series_ids(make_chunk_rows(rows, "labels", names), names)
    write_parts(chunks, f"{out}/parts", names, mode="overwrite")
    compact(spark, f"{out}/parts", f"{out}/compact", files)


def read(spark: SparkSession, path: str, metric: str, columns: Sequence[str] = (PAYLOAD,)) -> DataFrame:
    """The columns of one metric's chunks."""
    return project(scan(spark.read.parquet(path), [equals(NAME, metric)]), columns)


def print_rows(df: DataFrame, path: str) -> None:
    """Rows as space-separated text files; binary columns in base 64, null as nothing."""
    texts = [F.base64(F.col(f"`{f.name}`")) if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`").cast("string") for f in df.schema]
    df.select(F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts]).alias("value")).write.mode("overwrite").text(path)


def main(argv: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="gridquill")
    commands = parser.add_subparsers(dest="command", required=True)
    c = commands.add_parser("convert")
    c.add_argument("samples")
    c.add_argument("out")
    c.add_argument("--labels", required=True)
    c.add_argument("--files", type=int)
    b = commands.add_parser("convert-blocks")
    b.add_argument("out")
    b.add_argument("blocks", nargs="+")
    b.add_argument("--files", type=int)
    r = commands.add_parser("read")
    r.add_argument("table")
    r.add_argument("--metric", required=True)
    r.add_argument("--columns", default=PAYLOAD)
    r.add_argument("--text", help="write rows as text here instead of discarding them")
    a = parser.parse_args(argv)
    builder = SparkSession.builder.appName("gridquill")
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    began = time.perf_counter()
    if a.command == "convert":
        convert(spark, a.samples, a.out, a.labels.split(","), a.files)
    elif a.command == "convert-blocks":
        convert_blocks(spark, a.blocks, a.out, a.files)
    else:
        rows = read(spark, a.table, a.metric, a.columns.split(","))
        if a.text:
            print_rows(rows, a.text)
        else:
            rows.write.format("noop").mode("overwrite").save()
    print(f"{a.command}: {time.perf_counter() - began:.3f} s")


if __name__ == "__main__":
    main()
