"""A Python data source of byte windows of text files: `spark.read.format("byte_windows")`.

A window is read by its own task; of its lines the first and the last are dropped, as they are nearly always cut. Windows
are for samples of files too large to be read whole. Folders on any file system that pyarrow knows can be read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


class Window(InputPartition):
    def __init__(self, path: str, offset: int):
        super().__init__((path, offset))
        self.path, self.offset = path, offset


def local(path: str) -> str | None:
    """The path of a folder on a file system that is mounted; None for one that needs a client."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    return None if "://" in path else path


class WindowReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.length = options["path"], int(options["length"])
        self.offsets = [int(x) for x in options["offsets"].split(",")]

    def files(self) -> list[tuple[str, int]]:
        root = local(self.path)
        if root is not None:
            found = [os.path.join(folder, name) for folder, _, names in os.walk(root) for name in names]
            return [(path, os.path.getsize(path)) for path in found]
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.path)
        return [(f.path, f.size) for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.type == fs.FileType.File]

    def partitions(self) -> list[InputPartition]:
        shown = sorted((path, size) for path, size in self.files() if not os.path.basename(path).startswith(("_", ".")))
        return [Window(path, x) for path, size in shown for x in self.offsets if x < size]

    def read(self, partition: Window | None) -> Iterator[tuple]:
        if partition is None:  # there is no window
            return
        if local(self.path) is not None:
            file = open(partition.path, "rb")
        else:
            from pyarrow import fs

            file = fs.FileSystem.from_uri(self.path)[0].open_input_file(partition.path)
        with file as f:
            f.seek(partition.offset)
            data = f.read(self.length + 1)  # a range of bytes names its last one
        for line in data.split(b"\n")[1:-1]:
            if line.strip():
                yield partition.path, partition.offset, line.decode("utf-8", "replace")


class WindowSource(DataSource):
    """Options: path, offsets (separated by commas), length."""

    @classmethod
    def name(cls) -> str:
        return "byte_windows"

    def schema(self) -> str:
        return "file string, offset bigint, line string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return WindowReader(self.options)
