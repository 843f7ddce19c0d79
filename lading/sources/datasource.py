"""The data source "lading": spark.read.format("lading").load(folder or file).

Files are opened with seek, so that listing a large archive reads its headers only. Volumes of one set are one archive,
read where they lie. Small archives share a partition, so millions of them are not millions of tasks."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .reader import ENTRIES, Options, rows_of, volume_place
from .source import FileSource, Joined

#: Bytes and archives of a partition, about; an archive is never divided.
PARTITION_BYTES, PARTITION_ARCHIVES = 128 << 20, 10_000
#: What opening an archive costs, in bytes.
OPEN_BYTES = 1 << 18


class _Archives(InputPartition):
    """Archives, each as the paths of its volumes in order."""

    def __init__(self, archives: list[list[str]]) -> None:
        super().__init__(archives)
        self.archives = archives


def grouped(files: list[tuple[str, int]], volumes: bool = True) -> list[list[list[str]]]:
    """Partitions of archives from (path, size) of files: sets of volumes together, then packed by size in the order of
    names."""
    sets: dict[str, list] = {}
    for path, size in files:
        key, order = volume_place(path) if volumes else (path, (0, ""))
        sets.setdefault(key, []).append((order, path, size))
    out: list[list[list[str]]] = []
    room = 0
    for key in sorted(sets):
        own = sorted(sets[key])
        cost = OPEN_BYTES + sum(size for _, _, size in own)
        if not out or room < cost or len(out[-1]) >= PARTITION_ARCHIVES:
            out.append([])
            room = PARTITION_BYTES
        out[-1].append([path for _, path, _ in own])
        room -= cost
    return out


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        flag = lambda k, default="false": str(options.get(k, default)).lower() == "true"
        self.uri = options["path"]
        self.volumes = flag("volumes", "true")
        self.options = Options(flag("content"), flag("test"), int(options.get("depth", 0)), options.get("password"), options.get("encoding"), int(options.get("most_bytes", options.get("mostBytes", 1 << 30))), int(options.get("most_entries", options.get("mostEntries", 5_000_000))))
        self.names = [f.split()[0] for f in ENTRIES.split(", ")]

    def _fs(self):
        uri = self.uri if "://" in self.uri or self.uri.startswith("file:") else f"file://{self.uri}"
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = uri.replace("file:/", "file:///", 1)
        return pafs.FileSystem.from_uri(uri)

    def partitions(self) -> list[_Archives]:
        fs, top = self._fs()
        info = fs.get_file_info(top)
        if info.type == pafs.FileType.File:
            return [_Archives([[top]])]
        found = fs.get_file_info(pafs.FileSelector(top, recursive=True))
        return [_Archives(p) for p in grouped([(f.path, f.size) for f in found if f.type == pafs.FileType.File], self.volumes)]

    def read(self, partition: _Archives) -> Iterator[tuple]:
        fs, _ = self._fs()
        for paths in partition.archives:
            with ExitStack() as held:
                parts = [FileSource(f, f.size()) for f in (held.enter_context(fs.open_input_file(p)) for p in paths)]
                for row in rows_of(parts[0] if len(parts) == 1 else Joined(parts), paths[0], self.options):
                    row["extras"] = dict(row["extras"]) if row["extras"] is not None else None
                    yield tuple(row[n] for n in self.names)


class LadingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lading"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LadingSource)
