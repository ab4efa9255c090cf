"""Files in the shared folder, written and range-read by executors, without Spark's help.

The folder must be in a store that pyarrow opens by its URI: file, hdfs or viewfs (with libhdfs), s3 (also written s3a
or s3n), gs, abfs and abfss. Keys come from the executors' environment, not from Spark's settings. Of the
operators, op5, op6 and op9 need such files; the others only need tables that Spark reads and writes.
"""

from __future__ import annotations

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    scheme, found, rest = uri.partition("://")
    if scheme in ("s3a", "s3n"):
        uri = f"s3://{rest}"
    return pafs.FileSystem.from_uri(uri if found or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """A file written once under a temporary name and renamed when whole; no half file is ever referred to."""

    def __init__(self, folder: str, name: str):
        self.fs, root = opened(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.uri = f"{root}/{name}", f"{folder.rstrip('/')}/{name}"
        self.out, self.at = self.fs.open_output_stream(self.path + ".part"), 0

    def write(self, data: bytes) -> int:
        """Write and return where the data begins."""
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return at

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class Reader:
    """Range reads; keeps a few files open."""

    def __init__(self, most: int = 16):
        self.files: dict[str, object] = {}
        self.most = most

    def read(self, uri: str, offset: int, length: int) -> bytes:
        f = self.files.get(uri)
        if f is None:
            if len(self.files) >= self.most:
                self.files.pop(next(iter(self.files))).close()
            fs, path = opened(uri)
            f = self.files[uri] = fs.open_input_file(path)
        f.seek(offset)
        return f.read(length)

    def close(self) -> None:
        for f in self.files.values():
            f.close()
