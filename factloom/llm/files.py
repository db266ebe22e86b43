"""Binary files in the shared folder, from executors. Hadoop's local and remote schemes both go through pyarrow.fs."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{os.path.abspath(uri)}" if not uri.startswith("file:") else uri.replace("file:", "file://", 1))


class Output:
    """A file that appears under its name only when it is whole, so that a task may be run again."""

    def __init__(self, uri: str):
        self.fs, self.path = _at(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"

    def __enter__(self):
        self.stream = self.fs.open_output_stream(self.part, compression=None)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind:
            self.fs.delete_file(self.part)
        else:
            self.fs.move(self.part, self.path)


def open_input(uri: str):
    at, path = _at(uri)
    return at.open_input_stream(path, compression=None)
