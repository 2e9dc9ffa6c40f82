"""Python data sources: elementary streams as tables that Spark plans, batch and streaming.

    spark.dataSource.register(AdtsSource)
    spark.read.format("adts").option("path", folder).load()

A partition is a file; a stream's offset names the files seen, so each new file is read once whatever
its name.  Paths must be reachable from every executor as local or mounted ones; for stores that only
Spark reads, binary.read_files() and binary.stream_files() feed the same walks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from . import binary


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith((".", "_")))


class _Reader(DataSourceReader):
    def __init__(self, path: str, walk):
        self.path, self.walk = path, walk

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p) for p in _files(self.path)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            data = f.read()
        for row in self.walk(data):
            yield (partition.path, *row)


class _Stream(DataSourceStreamReader):
    """New files of the folder, read by the executors."""

    def __init__(self, path: str, walk):
        self.path, self.walk = path, walk

    def initialOffset(self) -> dict:
        return {"seen": []}

    def latestOffset(self) -> dict:
        return {"seen": _files(self.path)}

    def partitions(self, start: dict, end: dict) -> list[FilePartition]:
        before = set(start["seen"])
        return [FilePartition(p) for p in end["seen"] if p not in before]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return _Reader(self.path, self.walk).read(partition)

    def commit(self, end: dict) -> None:
        pass


class _Source(DataSource):
    FORMAT, SCHEMA, WALK = "", "", staticmethod(list)

    @classmethod
    def name(cls) -> str:
        return cls.FORMAT

    def schema(self) -> str:
        return "path string, " + self.SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.WALK)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"], self.WALK)


class AdtsSource(_Source):
    """Frames of raw AAC files."""

    FORMAT, SCHEMA, WALK = "adts", binary.ADTS, staticmethod(binary.adts_frames)


class BoxSource(_Source):
    """Boxes of media files."""

    FORMAT, SCHEMA, WALK = "boxes", binary.BOX.replace("path string", "box_path string"), staticmethod(binary.boxes)


class NalSource(_Source):
    """NAL units of raw H.264 files."""

    FORMAT, SCHEMA, WALK = "nal", binary.NAL, staticmethod(binary.nal_units)


class TrackSource(_Source):
    """Tracks with their sample tables."""

    FORMAT, SCHEMA, WALK = "tracks", binary.TRACK, staticmethod(binary.tracks)


SOURCES = (AdtsSource, BoxSource, NalSource, TrackSource)


def register(spark) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)
