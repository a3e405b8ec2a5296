"""Blocks of a time-series database as chunk rows: one row per series and chunk.

A block is a folder with a file ``index`` and numbered segment files under
``chunks``, in the published on-disk format (index version 2, segments version
1): big-endian fixed integers, unsigned varints and zigzag varints.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import MAXT, MINT, PAYLOAD, SERIES, make_chunk_rows
from ..session import ship

# Fixed values of the format.
INDEX_MAGIC, INDEX_VERSION = 0xBAAAD700, 2
SEGMENT_MAGIC, SEGMENT_VERSION = 0x85BD40DD, 1
TOC_BYTES, SERIES_ALIGNMENT, SEGMENT_HEADER, CRC_BYTES = 52, 16, 8, 4

_FIELDS = [(SERIES, pa.int64()), (MINT, pa.int64()), (MAXT, pa.int64()), (PAYLOAD, pa.binary()), ("labels", pa.map_(pa.string(), pa.string()))]
_SCHEMA = f"`{SERIES}` bigint, `{MINT}` bigint, `{MAXT}` bigint, `{PAYLOAD}` binary, labels map<string,string>"
#: Rows and bytes after which a batch is handed on.
BATCH_ROWS, BATCH_BYTES = 8_192, 16 << 20


class BadBlock(ValueError):
    """A file is not what the format says."""


def uvarint(data: memoryview, at: int) -> tuple[int, int]:
    """An unsigned varint and the place after it."""
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def varint(data: memoryview, at: int) -> tuple[int, int]:
    """A zigzag varint and the place after it."""
    raw, at = uvarint(data, at)
    return (raw >> 1) ^ -(raw & 1), at


def _fixed(data: memoryview, at: int, size: int) -> int:
    return int.from_bytes(data[at:at + size], "big")


@dataclass(frozen=True)
class ChunkRef:
    mint: int
    maxt: int
    segment: int
    offset: int


class Index:
    """The symbols and series of a block's index."""

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        if len(data) < 5 + TOC_BYTES or _fixed(self.data, 0, 4) != INDEX_MAGIC or data[4] != INDEX_VERSION:
            raise BadBlock("not an index of version 2")
        toc = len(data) - TOC_BYTES
        symbols, self.first, self.end = (_fixed(self.data, toc + 8 * i, 8) for i in range(3))
        if not self.end:  # no label indices: the series end where the next section begins
            self.end = next((x for i in range(3, 6) if (x := _fixed(self.data, toc + 8 * i, 8))), toc)
        self.symbols: list[str] = []
        at = symbols + 8
        for _ in range(_fixed(self.data, symbols + 4, 4)):
            size, at = uvarint(self.data, at)
            self.symbols.append(bytes(self.data[at:at + size]).decode())
            at += size

    def series(self) -> Iterator[tuple[int, list[tuple[str, str]], list[ChunkRef]]]:
        """``(number, labels, chunks)`` in the index's order, which is that of the labels."""
        at, number = self.first, 0
        while True:
            at += -at % SERIES_ALIGNMENT
            if at >= self.end:
                return
            size, start = uvarint(self.data, at)
            if size == 0:
                return
            yield number, *self._entry(start)
            at, number = start + size + CRC_BYTES, number + 1

    def _entry(self, at: int) -> tuple[list[tuple[str, str]], list[ChunkRef]]:
        count, at = uvarint(self.data, at)
        labels = []
        for _ in range(count):
            name, at = uvarint(self.data, at)
            value, at = uvarint(self.data, at)
            labels.append((self.symbols[name], self.symbols[value]))
        count, at = uvarint(self.data, at)
        chunks, maxt, ref = [], 0, 0
        for i in range(count):
            # the first has its start and place in full, the others what they are beyond the one before
            step, at = varint(self.data, at) if i == 0 else uvarint(self.data, at)
            length, at = uvarint(self.data, at)
            move, at = uvarint(self.data, at) if i == 0 else varint(self.data, at)
            mint = maxt + step
            maxt, ref = mint + length, ref + move
            chunks.append(ChunkRef(mint, maxt, ref >> 32, ref & 0xFFFFFFFF))
        return labels, chunks


def chunk_data(segment: memoryview, offset: int) -> bytes:
    """The encoded samples of the chunk at an offset of a segment, without its encoding byte and checksum."""
    size, at = uvarint(segment, offset)
    return bytes(segment[at + 1:at + 1 + size])


class _Part(InputPartition):
    def __init__(self, block: str, segment: int | None) -> None:
        super().__init__((block, segment))


class BlockReader(DataSourceReader):
    """One task per segment file; each reads its block's index and its own segment."""

    def __init__(self, paths: list[str]) -> None:
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        for path in self.paths:
            files, root = fs.FileSystem.from_uri(path)
            found = files.get_file_info(fs.FileSelector(posixpath.join(root, "chunks"), allow_not_found=True))
            numbers = sorted(int(f.base_name) for f in found if f.is_file and f.base_name.isdigit())
            parts += [_Part(path, n) for n in numbers]
        return parts or [_Part("", None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        block, number = partition.value
        if number is None:
            return
        files, root = fs.FileSystem.from_uri(block)
        with files.open_input_file(posixpath.join(root, "index")) as f:
            index = Index(f.read())
        with files.open_input_file(posixpath.join(root, "chunks", f"{number:06d}")) as f:
            segment = memoryview(f.read())
        if len(segment) < SEGMENT_HEADER or _fixed(segment, 0, 4) != SEGMENT_MAGIC or segment[4] != SEGMENT_VERSION:
            raise BadBlock(f"{block}: segment {number} is not of version 1")
        rows: list[tuple] = []
        size = 0
        for series, labels, chunks in index.series():
            for c in chunks:
                if c.segment == number - 1:
                    rows.append((series, c.mint, c.maxt, chunk_data(segment, c.offset), labels))
                    size += len(rows[-1][3])
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)], names=[n for n, _ in _FIELDS])


class BlockSource(DataSource):
    """``spark.read.format("metric_blocks")``; option ``paths`` lists block folders, one a line."""

    @classmethod
    def name(cls) -> str:
        return "metric_blocks"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> BlockReader:  # noqa: ANN001
        return BlockReader([p for p in self.options.get("paths", "").split("\n") if p])


def read_blocks(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Chunk rows of blocks: id, bounds, encoded samples, and ``labels`` as a map.

    Ids number the series of one block only; ``series.assign_series_ids`` gives
    ids that hold across blocks.  Chunks are read as they are stored.
    """
    ship(spark)
    spark.dataSource.register(BlockSource)
    return spark.read.format("metric_blocks").option("paths", "\n".join(paths)).load()


def block_chunks(spark: SparkSession, paths: Iterable[str], labels: Iterable[str]) -> DataFrame:
    """``read_blocks`` as a chunk table with a column per label; missing labels are ``''``."""
    return make_chunk_rows(read_blocks(spark, paths), "labels", labels)
