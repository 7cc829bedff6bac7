"""Splittable work: offset ranges, a ledger of what of a range is claimed, and data sources that read one range per partition."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from fractions import Fraction
from typing import NamedTuple

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


class OffsetRange(NamedTuple):
    start: int
    stop: int

    def split(self, size: int) -> Iterator[OffsetRange]:
        """Consecutive ranges of at most ``size`` (1 at least)."""
        step = max(1, size)
        return (OffsetRange(a, min(self.stop, a + step)) for a in range(self.start, self.stop, step))


class RangeTracker:
    """A range as three parts: what is behind the frontier, what is ahead of it, what was given away.

    The frontier is the first position that may still be claimed.  A claim moves it past
    the claimed position, inside the range or not; a split gives away an end of what is
    ahead of it; the work is done when nothing is ahead.
    """

    def __init__(self, work: OffsetRange, on_claim: Callable[[int, bool], None] | None = None) -> None:
        if work.start > work.stop:
            raise ValueError(f"range [{work.start}, {work.stop}) is reversed")
        self.work = work
        self.frontier = work.start
        self.on_claim = on_claim

    @property
    def last(self) -> int:
        """The last attempted position; the one before the start as long as there is none."""
        return self.frontier - 1

    def try_claim(self, at: int) -> bool:
        if at < self.frontier:
            why = "before the start" if at < self.work.start else f"not after {self.last}, the last attempted position"
            raise ValueError(f"position {at} is {why} of [{self.work.start}, {self.work.stop})")
        self.frontier = at + 1
        inside = at in range(*self.work)
        if self.on_claim is not None:
            self.on_claim(at, inside)
        return inside

    def try_split(self, share: float) -> tuple[OffsetRange, OffsetRange] | None:
        """Keep ``share`` of what is left from the last attempted position on (that position at least), give the rest away; None if there is no rest."""
        kept = Fraction(share) * (self.work.stop - self.last)
        at = max(self.frontier, self.last + int(kept))
        if at >= self.work.stop:
            return None
        given = OffsetRange(at, self.work.stop)
        self.work = self.work._replace(stop=at)
        return self.work, given

    def check_done(self) -> None:
        ahead = OffsetRange(min(self.frontier, self.work.stop), self.work.stop)
        if ahead.start < ahead.stop:
            raise ValueError(f"nothing tried to claim [{ahead.start}, {ahead.stop}) of [{self.work.start}, {self.work.stop})")

    def progress(self) -> tuple[int, int]:
        """Work completed and remaining: the last attempted position itself counts as remaining."""
        total = self.work.stop - self.work.start
        done = min(max(self.last - self.work.start, 0), total)
        return done, total - done


class _Part(InputPartition):
    def __init__(self, work: OffsetRange, path: str = "") -> None:
        self.work, self.path = work, path


def claimed(work: OffsetRange, step: int = 1) -> Iterator[int]:
    """The positions of a range, ``step`` apart, each claimed before it is given; all of it is claimed at the end."""
    tracker, at = RangeTracker(work), work.start
    while tracker.try_claim(at):
        yield at
        at += step
    tracker.check_done()


class WordRangeSource(DataSource):
    """``i, word`` of option ``text``, read in ``splits`` ranges (at least one word each)."""

    @classmethod
    def name(cls) -> str:
        return "word_ranges"

    def schema(self) -> str:
        return "i long, word string"

    def reader(self, schema) -> DataSourceReader:
        return _WordReader(self.options.get("text", "").split(" "), int(self.options.get("splits", 5)))


class _WordReader(DataSourceReader):
    def __init__(self, words: list[str], splits: int) -> None:
        self.words, self.splits = words, splits

    def partitions(self) -> list[_Part]:
        return [_Part(r) for r in OffsetRange(0, len(self.words)).split(len(self.words) // self.splits)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return ((i, self.words[i]) for i in claimed(partition.work))


class FileRangeSource(DataSource):
    """Files in byte ranges, so that one of any size is read by many tasks and no row holds more than a chunk or line.

    Options: ``path`` (a file, or a folder for all files below it; local, ``hdfs://``,
    ``s3://`` and what else pyarrow opens), ``mode``, ``size`` and ``split``.

    - ``chunks`` (the default): rows of ``size`` bytes (1 MiB), the last one shorter.
    - ``lines``: a line belongs to the range that holds its first byte; ``encoding``
      decodes it (``latin-1`` keeps every byte).

    Rows: ``path, start, content`` (binary) or ``path, start, value``.  ``split`` is the
    bytes of a range (32 MiB; for chunks rounded to whole ones).
    """

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return "path string, start long, value string" if self.options.get("mode") == "lines" else "path string, start long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _FileReader(dict(self.options))


class _FileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options
        self.lines = options.get("mode") == "lines"
        self.size = int(options.get("size", 1 << 20))
        split = int(options.get("split", 32 << 20))
        self.split = split if self.lines else max(1, split // self.size) * self.size

    def _open(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))

    def partitions(self) -> list[_Part]:
        from pyarrow import fs

        system, path = self._open(self.options["path"])
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return [_Part(r, p) for p, n in files for r in OffsetRange(0, n).split(self.split)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        system, _ = self._open(self.options["path"])
        with system.open_input_file(partition.path) as f:
            yield from (self._lines if self.lines else self._chunks)(f, partition)

    def _chunks(self, f, part: _Part) -> Iterator[tuple]:
        for at in claimed(part.work, self.size):
            yield part.path, at, f.read_at(min(self.size, part.work.stop - at), at)

    def _lines(self, f, part: _Part) -> Iterator[tuple]:
        encoding = self.options.get("encoding", "utf-8")
        tracker, at = RangeTracker(part.work), part.work.start
        f.seek(max(0, at - 1))
        if at:  # a line that began before belongs to another range
            at += len(self._line(f)) - 1
        while at < f.size() and tracker.try_claim(at):
            line = self._line(f)
            yield part.path, at, line.removesuffix(b"\n").removesuffix(b"\r").decode(encoding, "replace")
            at += len(line)

    def _line(self, f) -> bytes:
        parts = []
        while block := f.read(1 << 16):
            cut = block.find(b"\n") + 1
            if cut:
                f.seek(f.tell() - len(block) + cut)
                return b"".join([*parts, block[:cut]])
            parts.append(block)
        return b"".join(parts)


class CountingStream(DataSource):
    """An unbounded or bounded source of numbers that resumes and stops: ``i`` from ``start``, ``per_batch`` a micro-batch, up to ``stop`` if given.

    ``committed`` (a file path, the driver's) gets the end of each batch that the query
    has finished: the place for work that must follow a batch's success, and where a
    restarted query finds how far it came.
    """

    @classmethod
    def name(cls) -> str:
        return "counting"

    def schema(self) -> str:
        return "i long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _CountingReader(dict(self.options))


class _CountingReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.begin, self.step = int(options.get("start", 0)), int(options.get("per_batch", 100))
        self.stop = int(options["stop"]) if "stop" in options else None
        self.committed, self.at = options.get("committed"), self.begin
        if self.committed and os.path.exists(self.committed):
            with open(self.committed) as f:
                self.at = max([self.begin, *map(int, f.read().split())])

    def initialOffset(self) -> dict:
        return {"at": self.begin}

    def latestOffset(self) -> dict:
        self.at = self.at + self.step if self.stop is None else min(self.at + self.step, max(self.at, self.stop))
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Part]:
        self.at = max(end["at"], self.at)  # a batch that is done again
        return [_Part(r) for r in OffsetRange(start["at"], end["at"]).split(-(-self.step // 2))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        return ((i,) for i in claimed(partition.work))

    def commit(self, end: dict) -> None:
        if self.committed:
            with open(self.committed, "a") as f:
                f.write(f"{end['at']}\n")
