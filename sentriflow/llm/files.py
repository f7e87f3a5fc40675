"""Files in shared storage, read and written from tasks through whatever file system their URI names."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"/{uri}")


class Sink:
    """A new file in a folder, under a name that no other attempt of a task uses.

    Readers learn the name from the row that the finished task returns, so what a lost attempt left is never read.
    """

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        self._fs, self._path = file_system(self.uri)
        self._fs.create_dir(self._path.rsplit("/", 1)[0], recursive=True)
        self._out, self.size = self._fs.open_output_stream(self._path, compression=None), 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()


def open_read(uri: str):
    """A seekable binary file."""
    fs, path = file_system(uri)
    return fs.open_input_file(path)
