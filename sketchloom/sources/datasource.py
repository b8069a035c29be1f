"""Spark data sources of files with 8-byte hashes and of sketches, one file a user bin.

Reading, a file of any size is cut into ranges of bytes, and each partition takes some that
follow each other: many small ranges or files make no more than ``MOST_PARTITIONS`` tasks, unless
they would hold more than ``RANGE_BYTES``.
Writing, each task streams its rows into temporary files, which are moved to their names when
the whole job has succeeded; what a lost task leaves behind goes with the folder of temporary
files. Files are opened by Arrow's file systems (local or shared folders, and stores it knows)."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

RANGE_BYTES = 64 << 20
MOST_PARTITIONS = 256
BATCH_VALUES = 1 << 17
TEMPORARY = "_temporary"


def file_system(path: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a path, and the path in it; ValueError where Arrow knows none."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path) and not path.startswith("file:"):
        try:
            return pa.fs.FileSystem.from_uri(path)
        except (pa.ArrowException, OSError) as e:
            raise ValueError(f"no file system for {path}") from e
    return pa.fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)


def reachable(paths: list[str]) -> bool:
    """Whether Arrow can open the files."""
    try:
        for path in {p.split(":", 1)[0] if ":" in p else "": p for p in paths}.values():
            file_system(path)
        return True
    except ValueError:
        return False


@dataclass
class ByteRange(InputPartition):
    path: str
    first: int
    last: int
    number: int = 0


@dataclass
class ByteRanges(InputPartition):
    ranges: list[ByteRange]

    @property
    def first(self) -> int:
        return self.ranges[0].first

    @property
    def last(self) -> int:
        return self.ranges[-1].last


class HashReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = json.loads(options["paths"])
        self.step = max(int(options.get("range_bytes", RANGE_BYTES)) // 8, 1) * 8
        self.numbered = options.get("numbered") == "true"

    def partitions(self) -> list[InputPartition]:
        out: list[ByteRange] = []
        for number, path in enumerate(self.paths):
            fs, inner = file_system(path)
            size = fs.get_file_info(inner).size or 0
            size -= size % 8  # a short tail is dropped
            out += [ByteRange(path, a, min(a + self.step, size), number) for a in range(0, size, self.step)]
        share = min(sum(r.last - r.first for r in out) / MOST_PARTITIONS, max(RANGE_BYTES, self.step))
        packed, held = [], share
        for r in out:
            if held >= share:
                packed.append(ByteRanges([]))
                held = 0
            packed[-1].ranges.append(r)
            held += r.last - r.first
        return packed or [ByteRanges([])]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        for one in partition.ranges:
            yield from self._range(one)

    def _range(self, one: ByteRange) -> Iterator[pa.RecordBatch]:
        fs, inner = file_system(one.path)
        with fs.open_input_file(inner) as f:
            at = one.first
            while at < one.last:
                raw = f.read_at(min(8 * BATCH_VALUES, one.last - at), at)
                if len(raw) < 8:
                    break
                h = np.frombuffer(raw[: len(raw) // 8 * 8], "<i8")
                at += 8 * len(h)
                if self.numbered:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), one.number, np.int32)), pa.array(h)], ["number", "h"])
                    continue
                name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(h), np.int8)), pa.array([one.path])).cast(pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(h)], ["path", "h"])


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class FileWriter(DataSourceArrowWriter):
    """Rows of one ``file`` must come one after another, in one task."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.temporary = f"{self.folder}/{TEMPORARY}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, temporary = file_system(self.temporary)
        moves, name, out = [], None, None
        try:
            for batch in iterator:
                files = batch.column(0)
                if not len(files):
                    continue
                number = files.dictionary_encode().indices.to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(files)]
                for a, b in zip(edges, edges[1:]):
                    if files[a].as_py() != name:
                        if out:
                            out.close()
                        name = files[a].as_py()
                        if not moves:
                            fs.create_dir(temporary)
                        moves.append((f"{temporary}/{uuid.uuid4().hex}", name))
                        out = fs.open_output_stream(moves[-1][0])
                    value = batch.column(1).slice(a, b - a)
                    if pa.types.is_integer(value.type):
                        out.write(value.to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                    else:
                        for one in value:
                            out.write(one.as_py())
        finally:
            if out:
                out.close()
        return Written(moves)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, temporary = file_system(self.temporary)
        folder = file_system(self.folder)[1]
        moves = [x for m in messages if m is not None for x in m.moves]
        names = [n for _, n in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("the rows of one file came from several places")
        for held, name in moves:
            fs.move(held, f"{folder}/{name}")
        if moves:
            fs.delete_dir(temporary)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, temporary = file_system(self.temporary)
        if fs.get_file_info(temporary).type == pa.fs.FileType.Directory:
            fs.delete_dir(temporary)


class UserBinFiles(DataSource):
    """Reads (path, h), or (number, h) with the path's place in the list; writes (file, h) as 8-byte values or (file, content) as bytes."""

    @classmethod
    def name(cls) -> str:
        return "userbinfiles"

    def schema(self) -> str:
        return "number int, h long" if self.options.get("numbered") == "true" else "path string, h long"

    def reader(self, schema) -> DataSourceReader:
        return HashReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UserBinFiles)


def read_hashes(spark: SparkSession, paths: list[str], range_bytes: int = RANGE_BYTES, numbered: bool = False):
    """(path, h) of files of little-endian 8-byte values, each read by many tasks. Where files are
    many, rows are far smaller as (number, h), with the path's place in ``paths``."""
    register(spark)
    return spark.read.format("userbinfiles").option("paths", json.dumps(paths)).option("range_bytes", str(range_bytes)).option("numbered", str(numbered).lower()).load()


def write_files(rows, folder: str, distinct: bool = False) -> None:
    """Rows (file, h) or (file, content): a file each in ``folder``, values in ascending order,
    with ``distinct`` each once."""
    register(rows.sparkSession)
    first, second = rows.columns
    dealt = rows.repartition(first)
    dealt = (dealt.distinct() if distinct else dealt).sortWithinPartitions(first, second)  # equal rows have met: no second shuffle
    dealt.write.format("userbinfiles").mode("append").save(folder)
