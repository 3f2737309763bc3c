"""A streaming source that follows growing files by (inode, offset), beside Spark's whole-file source."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class _TailReader(DataSourceStreamReader):
    """Offsets are JSON per file: inode and bytes read up to the last line feed. A file is known by its inode, so a renamed one goes
    on where it was; a new inode or a shorter file starts at 0. Files are read in pieces of ``piecebytes``: a line belongs to the
    piece in which it begins."""

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.piece = int(options.get("piecebytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        found = {}
        for folder, _, names in os.walk(self.path):
            for name in sorted(names):
                p = os.path.join(folder, name)
                if name.endswith(self.suffix):
                    st = os.stat(p)
                    found[p] = [st.st_ino, self._complete(p, st.st_size)]
        return {"files": json.dumps(found, sort_keys=True)}

    @staticmethod
    def _complete(path: str, size: int) -> int:
        """The end of the last whole line."""
        with open(path, "rb") as f:
            at = size
            while at > 0:
                step = min(65536, at)
                f.seek(at - step)
                k = f.read(step).rfind(b"\n")
                if k >= 0:
                    return at - step + k + 1
                at -= step
        return 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        read = {inode: stop for inode, stop in json.loads(start["files"]).values()}
        out = []
        for p, (inode, stop) in sorted(json.loads(end["files"]).items()):
            at = read.get(inode, 0)
            at = at if at <= stop else 0
            out += [_Range(p, a, min(a + self.piece, stop)) for a in range(at, stop, self.piece)]
        return out

    def read(self, partition: _Range) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            at = partition.start
            if at:  # the line that began before belongs to the piece before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            else:
                f.seek(0)
            while at < partition.end:
                line = f.readline()
                if not line:
                    return
                text = line.rstrip(b"\n").decode("utf-8", "replace")
                if text:
                    yield text, partition.path, at
                at += len(line)

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    """``spark.dataSource.register(TailSource)``, then ``readStream.format("logtail").option("path", folder)``."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "message string, path string, byte_offset bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(self.options)
