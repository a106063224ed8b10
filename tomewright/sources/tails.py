"""A data source for the last bytes of files: it seeks, so that the size of a file costs nothing."""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatch

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files that one task reads.
FILES = 64


class Files(InputPartition):
    def __init__(self, uri: str, paths: list[str]):
        self.uri, self.paths = uri, paths


def opened(uri: str):
    """(file system, path) of a folder, file or pattern that pyarrow can open: local, HDFS, S3, GCS."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def listed(uri: str) -> list[str]:
    """The files of a folder at any depth, of a file itself, or those that match a pattern in the last part; hidden ones are passed over."""
    from pyarrow import fs

    store, path = opened(uri)
    if any(c in path.rpartition("/")[2] for c in "*?["):
        folder, _, pattern = path.rpartition("/")
        found = [f for f in store.get_file_info(fs.FileSelector(folder, recursive=False)) if f.is_file and fnmatch(f.base_name, pattern)]
    elif store.get_file_info(path).is_file:
        return [path]
    else:
        found = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file]
    return sorted(f.path for f in found if not f.base_name.startswith((".", "_")))


class TailReader(DataSourceReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def partitions(self) -> list[Files]:
        paths = listed(self.uri)
        return [Files(self.uri, paths[k : k + FILES]) for k in range(0, len(paths), FILES)] or [Files(self.uri, [])]

    def read(self, part: Files) -> Iterator[tuple]:
        store, _ = opened(part.uri)
        for path in part.paths:
            with store.open_input_file(path) as f:
                size = f.size()
                f.seek(max(0, size - self.size))
                yield path, size, bytes(f.read(self.size))


class TailSource(DataSource):
    """``format("tails")`` with the option ``size``: (file, length, content), the last bytes of each file."""

    @classmethod
    def name(cls) -> str:
        return "tails"

    def schema(self) -> str:
        return "file string, length long, content binary"

    def reader(self, schema) -> TailReader:
        return TailReader(self.options["path"], int(self.options.get("size", "8192")))
