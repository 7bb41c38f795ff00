"""Plain files in the shared folder, from tasks and the driver, on any file system pyarrow knows."""

from __future__ import annotations

import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Spark path such as ``file:/a``, ``/a`` or ``hdfs://host/a``."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(path)


class Replacing:
    """A file written under another name and moved into place when whole: a lost task leaves no half file."""

    def __init__(self, path: str):
        self.fs, self.path = located(path)
        self.part = f"{self.path}.{uuid.uuid4().hex[:8]}.part"

    def __enter__(self):
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.part)
        return self.out

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is None:
            self.fs.move(self.part, self.path)
        else:
            self.fs.delete_file(self.part)
