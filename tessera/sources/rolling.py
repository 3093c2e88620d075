"""A sink whose files roll by size: a Python data source with a writer by task and commit messages.

Every task writes files of at most so many characters into a pending folder of the job; only when all tasks have
ended are the files of the attempts that count moved beside each other, and a failed job leaves nothing.
Paths are those of ``pyarrow.fs`` (local or mounted ones, and the stores it knows by their scheme).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "rolling_text"


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    system, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, base.rstrip("/")


class RollingWriter(DataSourceArrowWriter):
    """``max_chars``: characters of a file, line ends included; a longer line has a file of its own."""

    def __init__(self, path: str, max_chars: int, suffix: str, overwrite: bool):
        self.path, self.max_chars, self.suffix, self.overwrite = path, max_chars, suffix, overwrite
        self.job = uuid.uuid4().hex

    def _pending(self, base: str) -> str:
        return f"{base}/_pending-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, base = _opened(self.path)
        folder, task = self._pending(base), TaskContext.get()
        system.create_dir(folder, recursive=True)
        names: list[str] = []
        out, left = None, 0
        try:
            for batch in iterator:
                lines = batch.column(0).fill_null("")
                ends = np.cumsum(pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
                begin = before = 0
                while begin < len(lines):
                    # as many lines as the open file takes; a new one takes one at least
                    upto = int(np.searchsorted(ends, before + left, "right"))
                    if upto == begin:
                        if out is not None:
                            out.close()
                        names.append(f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(names):05d}-{self.job[:8]}{self.suffix}")
                        out, left = system.open_output_stream(f"{folder}/{names[-1]}", compression="gzip" if self.suffix.endswith(".gz") else None), self.max_chars
                        upto = max(begin + 1, int(np.searchsorted(ends, before + left, "right")))
                    out.write(("\n".join(lines.slice(begin, upto - begin).to_pylist()) + "\n").encode())
                    left -= int(ends[upto - 1]) - before
                    begin, before = upto, int(ends[upto - 1])
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = _opened(self.path)
        system.create_dir(base, recursive=True)
        old = [f.path for f in system.get_file_info(fs.FileSelector(base)) if f.type == fs.FileType.File and not f.base_name.startswith("_")]
        for message in messages:
            for name in message.files if message else []:
                system.move(f"{self._pending(base)}/{name}", f"{base}/{name}")
        if self.overwrite:
            for path in old:
                system.delete_file(path)
        self._clear(system, base)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.path))

    def _clear(self, system: fs.FileSystem, base: str) -> None:
        if system.get_file_info(self._pending(base)).type == fs.FileType.Directory:
            system.delete_dir(self._pending(base))


class RollingText(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> RollingWriter:
        o = self.options
        return RollingWriter(o["path"], int(o["max_chars"]), o.get("suffix", ".nt.gz"), overwrite)


def write_rolling(lines: DataFrame, path: str, max_chars: int, suffix: str = ".nt.gz", append: bool = False) -> None:
    """Lines (one string column) as text files of at most ``max_chars`` characters each; null lines are empty ones. Without
    ``append`` the files that are there go once the new ones are in place."""
    lines.sparkSession.dataSource.register(RollingText)
    lines.write.format(FORMAT).option("path", path).option("max_chars", max_chars).option("suffix", suffix).mode("append" if append else "overwrite").save()
