"""Binary files in the shared folder, by any scheme that pyarrow knows (plain paths, ``file:``, ``hdfs:``, ``s3:`` and so on)."""

from __future__ import annotations

import re
import uuid
from typing import Any

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it. ``file:/x`` is another way to write ``file:///x``."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


class AtomicFile:
    """Writes beside the final name and moves into place on leaving, so a retried task replaces the whole file or nothing."""

    def __init__(self, path: str) -> None:
        self.system, self.final = located(path)
        self.parts = f"{self.final}.{uuid.uuid4().hex}"

    def __enter__(self) -> Any:
        self.system.create_dir(self.final.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.parts)
        return self.out

    def __exit__(self, kind: type | None, *_: object) -> None:
        self.out.close()
        if kind is None:
            self.system.move(self.parts, self.final)
        else:
            self.system.delete_file(self.parts)
