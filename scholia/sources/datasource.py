"""A folder of study material as a data source: batch and stream reading by file, and writing of named
files, all on executors.

    spark.dataSource.register(StudySource)
    spark.read.format("study").load(folder)
    spark.readStream.format("study").load(folder)
    files.write.format("study").mode("append").save(folder)

Paths may be local or of any file system that Arrow opens by its address.  Rows read are
(path, size, modified, content); files of unknown type are skipped, or with the option
`unknown` = `true` read as well.  The stream sees a file again when it changes.  Rows written
are (path, content): a file that is there with the same bytes stays as it is, any other
is written beside its place and moved there, so a repeated or lost task leaves one whole file.
"""

from __future__ import annotations

import datetime
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import SUFFIXES

SCHEMA = "path string, size long, modified timestamp, content binary"
#: Bytes of files that one partition reads, and files at most.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 1000


def _open(folder: str):  # noqa: ANN202
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder.replace("file:///", "file:/").replace("file:/", "file:///"))


def listed(folder: str, unknown: bool = False) -> tuple[list[tuple[str, int, int]], int]:
    """(path, size, modified ns) of the files below a folder by path, and how many were skipped."""
    from pyarrow import fs

    system, root = _open(folder)
    info = system.get_file_info(root)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    if info.type != fs.FileType.Directory:
        raise NotADirectoryError(folder)
    files = [f for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]
    known = [f for f in files if unknown or f.extension.lower() in SUFFIXES]
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in known), len(files) - len(known)


@dataclass
class Files(InputPartition):
    files: tuple[tuple[str, int, int], ...]


def _partitions(files: list[tuple[str, int, int]]) -> list[Files]:
    out, held, size = [], [], 0
    for f in files:
        if held and (size + f[1] > PARTITION_BYTES or len(held) == PARTITION_FILES):
            out.append(Files(tuple(held)))
            held, size = [], 0
        held.append(f)
        size += f[1]
    return [*out, Files(tuple(held))] if held else out


def _contents(folder: str, part: Files) -> Iterator[tuple]:
    system, _ = _open(folder)
    for path, size, modified in part.files:
        with system.open_input_stream(path) as f:
            data = f.read()
        yield path, size, datetime.datetime.fromtimestamp(modified / 1e9, datetime.UTC), bytes(data)


class StudySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "study"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> str:
        if "path" not in self.options:
            raise ValueError("a folder is needed")
        return self.options["path"]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return StudyReader(self._folder(), self.options.get("unknown", "false").lower() == "true")

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return StudyStream(self._folder(), self.options.get("unknown", "false").lower() == "true")

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("files are added or replaced one by one: use mode append")
        names = schema.names
        return FilesWriter(self._folder(), names.index("path"), names.index("content"))


class StudyReader(DataSourceReader):
    def __init__(self, folder: str, unknown: bool):
        self.folder = folder
        self.files, self.skipped = listed(folder, unknown)

    def partitions(self) -> list[InputPartition]:
        return _partitions(self.files)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _contents(self.folder, partition) if isinstance(partition, Files) else iter(())


class StudyStream(DataSourceStreamReader):
    """Offsets are times of change: a batch holds the files whose last change lies between two of them."""

    def __init__(self, folder: str, unknown: bool):
        self.folder, self.unknown = folder, unknown

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        files, _ = listed(self.folder, self.unknown)
        return {"until": max((f[2] for f in files), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files, _ = listed(self.folder, self.unknown)
        return _partitions([f for f in files if start["until"] < f[2] <= end["until"]])

    def read(self, partition: Files) -> Iterator[tuple]:
        return _contents(self.folder, partition)


@dataclass
class Written(WriterCommitMessage):
    paths: str


class FilesWriter(DataSourceWriter):
    def __init__(self, folder: str, path: int, content: int):
        self.folder, self.path, self.content = folder, path, content

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        system, root = _open(self.folder)
        root, done = posixpath.normpath(root), []
        for row in iterator:
            data, place = row[self.content], row[self.path]
            if self.folder == "/" and (place.startswith("file:") or "://" in place):
                # Without a folder, paths may be addresses.
                system, place = _open(place)
            else:
                place = posixpath.normpath(posixpath.join(root, place.lstrip("/")))
                if not place.startswith(root.rstrip("/") + "/"):
                    raise ValueError(f"{row[self.path]} leaves the folder")
            data = data.encode() if isinstance(data, str) else bytes(data or b"")
            done.append(row[self.path])
            info = system.get_file_info(place)
            if info.type == fs.FileType.File and info.size == len(data):
                with system.open_input_stream(place) as f:
                    if f.read() == data:
                        continue
            system.create_dir(posixpath.dirname(place), recursive=True)
            beside = f"{place}.{uuid.uuid4().hex}.part"
            with system.open_output_stream(beside) as f:
                f.write(data)
            system.move(beside, place)
        return Written(json.dumps(done))
