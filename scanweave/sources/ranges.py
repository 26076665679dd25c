"""Byte ranges of files on any store that pyarrow opens: local paths, ``file``, ``hdfs``, ``s3`` and ``gs`` addresses."""

from __future__ import annotations

import fnmatch

from pyarrow import fs


class Ranges:
    """A file opened for reading ranges; ``bytes_read`` counts what was read."""

    def __init__(self, path: str) -> None:
        store, place = located(path)
        self._file = store.open_input_file(place)
        self.size = self._file.size()
        self.bytes_read = 0

    def read(self, start: int, length: int) -> bytes:
        """Exactly ``length`` bytes from ``start`` on."""
        data = self._file.read_at(length, start)
        self.bytes_read += len(data)
        if len(data) != length:
            raise ValueError(f"{length} bytes from {start} on are wanted, the file ends after {len(data)}")
        return data

    def upto(self, start: int, length: int) -> bytes:
        """At most ``length`` bytes: fewer where the file ends."""
        return self.read(start, max(min(length, self.size - start), 0))

    def close(self) -> None:
        self._file.close()


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return (fs.LocalFileSystem(), path.removeprefix("file:"))


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The files that a path names, in order: one file, a folder's with one of the suffixes, or those of a pattern in its last part."""
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    store, place = located(path)
    folder, _, last = place.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.is_file and fnmatch.fnmatchcase(f.base_name, last)]
    elif store.get_file_info(place).type == fs.FileType.Directory:
        found = [f.path for f in store.get_file_info(fs.FileSelector(place)) if f.is_file and f.base_name.lower().endswith(suffixes)]
    else:
        found = [place]
    return [scheme + f for f in sorted(found)]
