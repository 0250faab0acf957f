"""Landed response bodies as a data source of Spark.

Bodies are landed as JSON text sequences: each between a record separator and a line feed, byte for byte as it came, in
gzip files (files that aren't are read too) under ``run_id=<run>/page=<page>``. The source plans one partition for each file, so runs and pages are read side by
side, and a file is read in pieces, so only one body is held. A filter on run_id or page that the engine pushes down
leaves out the folders of other runs and pages before any task is planned.

    spark.dataSource.register(LandedBodies)
    spark.read.format("landed_bodies").load(folder).where("run_id = 'r1'")
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from gaugeline.errors import MalformedBody, refuse

SCHEMA = "run_id string, page int, body string"
SEPARATOR = "\x1e"
PIECE = 1 << 20
ROWS = 100


def land(bodies: DataFrame, folder: str) -> None:
    """Lands bodies (run_id, page, body) once: a folder that exists is an error. JSON has no record separator; a body with one, or null, is refused."""
    refused = refuse(MalformedBody, "a body is null or holds a record separator", run_id=F.col("run_id"), page=F.col("page"))
    body = F.when(F.col("body").isNull() | F.contains("body", F.lit(SEPARATOR)), refused).otherwise(F.concat(F.lit(SEPARATOR), F.col("body")))
    bodies.select("run_id", "page", body.alias("value")).hint("rebalance", "run_id", "page").write.partitionBy("run_id", "page").text(folder, compression="gzip")


def _system(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri("file:///" + path[5:].lstrip("/") if path.startswith("file:") else path)


@dataclass
class LandedFile(InputPartition):
    path: str
    run_id: str
    page: int


class LandedReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Keeps what is asked of run_id and page; all other filters are the engine's."""
        for f in filters:
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if values is None or f.attribute not in (("run_id",), ("page",)):
                yield f
                continue
            name = f.attribute[0]
            self.wanted[name] = set(values) & self.wanted.get(name, set(values))

    def _parts(self, system, folder: str, name: str) -> Iterator[tuple[str, str]]:  # noqa: ANN001
        """The folders name=value in a folder, with their values, that a filter doesn't leave out."""
        from pyarrow import fs

        for found in system.get_file_info(fs.FileSelector(folder)):
            if found.type == fs.FileType.Directory and found.base_name.startswith(f"{name}="):
                value = unquote(found.base_name.partition("=")[2])
                if name not in self.wanted or value in set(map(str, self.wanted[name])):
                    yield found.path, value

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, inner = _system(self.folder)
        out = []
        for run_path, run_id in self._parts(system, inner, "run_id"):
            for page_path, page in self._parts(system, run_path, "page"):
                out += [LandedFile(f.path, run_id, int(page)) for f in system.get_file_info(fs.FileSelector(page_path)) if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._"]
        return sorted(out, key=lambda p: (p.run_id, p.page, p.path))

    def read(self, partition: LandedFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not partition.path:  # an empty folder is planned as one empty partition
            return
        system, _ = _system(self.folder)
        target = pa.schema([("run_id", pa.string()), ("page", pa.int32()), ("body", pa.string())])

        def batch(bodies: list[str]) -> pa.RecordBatch:
            n = len(bodies)
            return pa.RecordBatch.from_arrays([pa.array([partition.run_id] * n), pa.array([partition.page] * n, pa.int32()), pa.array(bodies, pa.string())], schema=target)

        held: list[str] = []
        with system.open_input_stream(partition.path) as stream:
            for body in bodies_of(iter(lambda: stream.read(PIECE), b"")):
                held.append(body)
                if len(held) == ROWS:
                    yield batch(held)
                    held = []
        if held:
            yield batch(held)


def bodies_of(pieces: Iterable[bytes]) -> Iterator[str]:
    """The bodies of a text sequence that comes in pieces; only the line feed that ends a record isn't part of its body."""
    mark, parts, begun = SEPARATOR.encode(), [], False
    for piece in pieces:
        first, *more = piece.split(mark)
        parts.append(first)
        for part in more:
            if begun:
                yield b"".join(parts).removesuffix(b"\n").decode("utf-8")
            begun, parts = True, [part]
    if begun:
        yield b"".join(parts).removesuffix(b"\n").decode("utf-8")


class LandedBodies(DataSource):
    """run_id, page and body of each landed body."""

    @classmethod
    def name(cls) -> str:
        return "landed_bodies"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001, ARG002
        return LandedReader(self.options["path"])


def read_landed(spark, folder: str) -> DataFrame:  # noqa: ANN001
    """The landed bodies of a folder, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedBodies)
    return spark.read.format("landed_bodies").load(folder)
