import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from gridquill.cli import main
from gridquill.operators.scan import equals
from gridquill.operators.series import ChunkEngine, assign_series_ids
from gridquill.sinks.writer import compact, write_parts
from gridquill.sources.blocks import BadBlock, Index, block_chunks, read_blocks


def uv(n):
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def zz(n):
    return uv(n << 1 if n >= 0 else (-n << 1) - 1)


def write_block(path, series, per_segment=3):
    """``series``: list of (labels, chunks); a chunk is (mint, maxt, data)."""
    os.makedirs(f"{path}/chunks")
    segments, refs = [], []
    for _, chunks in series:
        own = []
        for _, _, data in chunks:
            if not segments or segments[-1][1] == per_segment:
                segments.append([bytearray(struct.pack(">IB3x", 0x85BD40DD, 1)), 0])
            own.append((len(segments) - 1) << 32 | len(segments[-1][0]))
            segments[-1][0] += uv(len(data)) + b"\x01" + data + b"crc0"
            segments[-1][1] += 1
        refs.append(own)
    for n, (data, _) in enumerate(segments, 1):
        with open(f"{path}/chunks/{n:06d}", "wb") as f:
            f.write(data)
    symbols = sorted({x for labels, _ in series for kv in labels.items() for x in kv} | {""})
    out = bytearray(struct.pack(">IB", 0xBAAAD700, 2))
    at_symbols = len(out)
    body = struct.pack(">I", len(symbols)) + b"".join(uv(len(s.encode())) + s.encode() for s in symbols)
    out += struct.pack(">I", len(body)) + body + b"crc0"
    out += b"\0" * (-len(out) % 16)
    at_series = len(out)
    for (labels, chunks), own in zip(series, refs):
        out += b"\0" * (-len(out) % 16)
        entry = uv(len(labels)) + b"".join(uv(symbols.index(k)) + uv(symbols.index(v)) for k, v in sorted(labels.items())) + uv(len(chunks))
        for i, ((a, z, _), ref) in enumerate(zip(chunks, own)):
            entry += (zz(a) + uv(z - a) + uv(ref)) if i == 0 else uv(a - chunks[i - 1][1]) + uv(z - a) + zz(ref - own[i - 1])
        out += uv(len(entry)) + entry + b"crc0"
    at_labels = len(out)
    out += b"other sections" + struct.pack(">6Q", at_symbols, at_series, at_labels, 0, at_labels, 0) + b"crc0"
    with open(f"{path}/index", "wb") as f:
        f.write(out)


def made(seed, n=40):
    rng = random.Random(seed)
    series = []
    for i in range(n):
        labels = {"__name__": f"m{i % 3}", "job": f"jöb{i}" * (1 + i % 40)} | ({"zone": "z"} if i % 2 else {})
        chunks, t = [], rng.randrange(-10**6, 10**13)
        for _ in range(rng.choice([0, 1, 2, 7])):
            length = rng.choice([0, 5, 7_200_000])
            chunks.append((t, t + length, rng.randbytes(rng.choice([1, 150, 300]))))
            t += length + rng.choice([1, 30_000])
        series.append((labels, chunks))
    return series


def test_blocks_are_read_as_written(spark, tmp_path):
    blocks = {f"{tmp_path}/b{k}": made(k) for k in range(2)}
    for path, series in blocks.items():
        write_block(path, series)
    got = sorted((r[0], r[1], r[2], bytes(r[3]), sorted(r[4].items())) for r in read_blocks(spark, blocks).collect())
    assert got == sorted((i, a, z, data, sorted(labels.items())) for s in blocks.values() for i, (labels, chunks) in enumerate(s) for a, z, data in chunks)
    df = read_blocks(spark, [f"{tmp_path}/b0"])
    assert df.rdd.getNumPartitions() == len(os.listdir(f"{tmp_path}/b0/chunks")) > 5


def test_blocks_to_a_chunk_table(spark, tmp_path):
    write_block(f"{tmp_path}/b", made(5))
    labels = ["__name__", "job", "zone"]
    chunks = assign_series_ids(block_chunks(spark, [f"{tmp_path}/b"], labels), labels)
    write_parts(chunks, f"{tmp_path}/parts", labels)
    compact(spark, f"{tmp_path}/parts", f"{tmp_path}/compact")
    table = spark.read.parquet(f"{tmp_path}/compact")
    assert table.count() == sum(len(c) for _, c in made(5))
    series = ChunkEngine(table).select_series([equals("__name__", "m1"), equals("zone", "")], ["job"])
    assert {r.job for r in series.collect()} == {la["job"] for la, c in made(5) if c and la["__name__"] == "m1" and "zone" not in la}


def test_command_line(spark, tmp_path):
    write_block(f"{tmp_path}/b", made(6))
    main(["convert-blocks", f"{tmp_path}/out", f"{tmp_path}/b"])
    table = spark.read.parquet(f"{tmp_path}/out/compact")
    assert table.columns == ["__series__id", "__mint", "__maxt", "__chunk_bytes", "__name__", "job", "zone"] and table.count() == sum(len(c) for _, c in made(6))


def test_odd_blocks(spark, tmp_path):
    write_block(f"{tmp_path}/none", [({"a": "b"}, [])])
    assert read_blocks(spark, [f"{tmp_path}/none"]).count() == 0 and read_blocks(spark, []).count() == 0
    assert [n for n, _, _ in Index(open(f"{tmp_path}/none/index", "rb").read()).series()] == [0]
    with pytest.raises(BadBlock):
        Index(b"\0" * 200)
    write_block(f"{tmp_path}/bad", made(1))
    with open(f"{tmp_path}/bad/chunks/000001", "r+b") as f:
        f.write(b"oops")
    with pytest.raises(Exception, match="segment 1"):
        read_blocks(spark, [f"{tmp_path}/bad"]).agg(F.max("__mint")).collect()
