"""Following log files that grow: a streaming source whose offset is a number of bytes per file.

Every trigger takes the lines that were finished since the last one. A line without its line end
waits. Large growth is split over tasks by bytes; a task reads the lines that begin in its part. Parts grow
with the growth, so that a trigger has a bounded number of them until they have `PART_BYTES`. Files
are read through Arrow's file systems, so the path may be a URI that these know.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

FORMAT = "wirevault_tail"
PART_BYTES = 32 << 20
# Parts of a trigger for each core, before parts are made larger than they were asked for.
PARTS_PER_CORE = 4
_BLOCK = 1 << 20
_LINES = 4096
_SCHEMA = "value string, src_time timestamp, src_file string, src_split bigint"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Size of every file at or right below a path."""
    system, inner = _system(path)
    info = system.get_file_info(inner)
    found = [info]
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner))
    return {f.path: f.size for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))}


def finished(file: pa.NativeFile, size: int, known: int = 0) -> int:
    """Where the last finished line of the first ``size`` bytes ends; not before ``known``."""
    end = size
    while end > known:
        begin = max(known, end - _BLOCK)
        file.seek(begin)
        at = file.read(end - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        end = begin
    return known


def lines_of(file: pa.NativeFile, low: int, high: int, end: int) -> Iterator[bytes]:
    """The lines that begin in ``low`` to ``high``, of a file whose lines are finished at ``end``."""
    at = low
    if low:
        # The byte before tells whether a line begins at `low`; else it belongs to the part before.
        file.seek(low - 1)
        skip, at = True, low - 1
    else:
        file.seek(0)
        skip = False
    rest = b""
    while at < high or rest:
        block = file.read(min(_BLOCK, end - at - len(rest)))
        if not block:
            return
        pieces = (rest + block).split(b"\n")
        rest = pieces.pop()
        for line in pieces:
            if not skip:
                if at >= high:
                    return
                yield line
            skip = False
            at += len(line) + 1
        if at >= high:
            return


def part_size(grown: int, least: int, parts: int) -> int:
    """Bytes of a part: ``least``, or more where ``grown`` bytes would be more than ``parts`` of these; up to `PART_BYTES`."""
    return max(least, min(PART_BYTES, -(-grown // parts)))


class Part(InputPartition):
    def __init__(self, path: str, low: int, high: int, end: int):
        self.path, self.low, self.high, self.end = path, low, high, end


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.from_end = options.get("startat", "beginning").lower() == "end"
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.parts = int(options.get("parts", PARTS_PER_CORE))

    def _ends(self) -> dict[str, int]:
        system, _ = _system(self.path)
        ends = {}
        for path, size in _files(self.path).items():
            with system.open_input_file(path) as file:
                ends[path] = finished(file, size)
        return ends

    def initialOffset(self) -> dict[str, Any]:
        return self._ends() if self.from_end else {}

    def latestOffset(self) -> dict[str, Any]:
        return self._ends()

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[InputPartition]:
        spans = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            if stop < begin:  # the file was cut and written anew
                begin = 0
            spans.append((path, begin, stop))
        size = part_size(sum(stop - begin for _, begin, stop in spans), self.part_bytes, self.parts)
        return [Part(path, low, min(low + size, stop), stop) for path, begin, stop in spans for low in range(begin, stop, size)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        schema = pa.schema([("value", pa.string()), ("src_time", pa.timestamp("us", "UTC")), ("src_file", pa.string()), ("src_split", pa.int64())])

        def batch(lines: list[str]) -> pa.RecordBatch:
            n = len(lines)
            return pa.RecordBatch.from_arrays(
                [pa.array(lines, pa.string()), pa.nulls(n, schema.field(1).type), pa.array([partition.path] * n),
                 pa.array([partition.low] * n, pa.int64())],
                schema=schema,
            )

        held: list[str] = []
        with system.open_input_file(partition.path) as file:
            for line in lines_of(file, partition.low, partition.high, partition.end):
                held.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
                if len(held) == _LINES:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)

    def commit(self, end: dict[str, Any]) -> None:
        pass


class LineTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options)


def stream_tail(spark: SparkSession, path: str, *, start: str = "beginning", part_bytes: int = PART_BYTES) -> DataFrame:
    """Lines of a file, or of the files of a folder, as they are finished: `value` and place of arrival.

    ``start="end"`` leaves out what is there at the first start; later starts go on from the
    checkpoint. New files are read from their beginning. A file that has become shorter is taken as
    cut and written anew; one that was cut and has outgrown its old size since is not noticed.
    ``part_bytes`` is the least that growth is split into; a trigger that has grown by more than
    `PARTS_PER_CORE` of these for each core has larger parts, as a task costs more than a short read.
    """
    if start not in ("beginning", "end"):
        raise ValueError("start is 'beginning' or 'end'")
    spark.dataSource.register(LineTail)
    parts = PARTS_PER_CORE * spark.sparkContext.defaultParallelism
    options = {"startAt": start, "partBytes": part_bytes, "parts": parts}
    return spark.readStream.format(FORMAT).options(**options).load(path)
