"""A streaming source that follows growing and rotated log files.

The offset of a file is its inode and the bytes read, up to the last complete
line.  When a name gets a new inode, the rest of the old file is read first, if
a file with that inode is still in the folder, and the new one from its start.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Span(InputPartition):
    """Bytes of a file to read, and the name and inode that its lines go by."""

    def __init__(self, path: str, name: str, inode: int, start: int, end: int):
        self.path, self.name, self.inode, self.start, self.end = path, name, inode, start, end


def complete_end(path: str, start: int, size: int) -> int:
    """The end of the last complete line in a file's bytes from ``start`` to ``size``."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            step = min(65536, at - start)
            f.seek(at - step)
            cut = f.read(step).rfind(b"\n")
            if cut >= 0:
                return at - step + cut + 1
            at -= step
    return start


class LogTailReader(DataSourceStreamReader):
    def __init__(self, patterns: list[str], exclude: list[str]):
        self.patterns, self.exclude = patterns, exclude

    def _paths(self) -> list[str]:
        found = {p for x in self.patterns for p in glob.glob(x)}
        return sorted(p for p in found if os.path.basename(p) not in self.exclude)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        now = {}
        for path in self._paths():
            stat = os.stat(path)
            now[path] = [stat.st_ino, complete_end(path, 0, stat.st_size)]
        return {"files": json.dumps(now, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        out = []
        for path, (inode, upto) in after.items():
            old_inode, seen = before.get(path, [inode, 0])
            if old_inode != inode:
                rotated = self._by_inode(os.path.dirname(path), old_inode)
                if rotated:
                    rest = complete_end(rotated, seen, os.path.getsize(rotated))
                    if rest > seen:
                        out.append(Span(rotated, os.path.basename(path), old_inode, seen, rest))
                seen = 0
            if upto > seen:
                out.append(Span(path, os.path.basename(path), inode, seen, upto))
        return out

    @staticmethod
    def _by_inode(folder: str, inode: int) -> str | None:
        with os.scandir(folder or ".") as entries:
            return next((e.path for e in entries if e.is_file() and e.inode() == inode), None)

    def read(self, partition: Span) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                yield line.decode("utf-8", "replace").rstrip("\r\n"), f"{partition.name}#{partition.inode}", at
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """``spark.dataSource.register(LogTail)``, then ``readStream.format("logtail").load(glob)``.

    The path may be a JSON list of globs; the option ``exclude`` is one of base
    names.  A line's ``file`` is its log's name and inode, its ``seq`` the number
    of its first byte.  Files are read where the logs are: by executors on the
    server itself, or on machines that mount its folder.
    """

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "value string, file string, seq long"

    def streamReader(self, schema) -> LogTailReader:  # noqa: N802
        return LogTailReader(json.loads(self.options["path"]) if self.options["path"].startswith("[") else [self.options["path"]], json.loads(self.options.get("exclude", "[]")))
