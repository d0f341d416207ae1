"""A data source ``corpus`` for Spark's Python Data Source API (U4): text files as books, in batch and as a stream.

    register(spark)
    spark.read.format("corpus").option("path", "/books").load()
    spark.readStream.format("corpus").option("path", "/books").load()

A partition is a group of files of bounded bytes. The stream's offset is the last file's time and name, so that files
are read once each, in that order, however often the stream is started again. Listing and reading go through the file
system that the path names. Other formats of books are subclasses that say how a file becomes rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes of files that make one partition.
GROUP_BYTES = 64 << 20


@dataclass
class FileGroup(InputPartition):
    """Files of one partition."""

    paths: tuple[str, ...]


@dataclass(frozen=True, order=True)
class Found:
    """A file, in the order in which files are read."""

    time: int
    path: str
    size: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[Found]:
    """Files with a suffix below a path, the oldest first; hidden ones are left out."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    visible = (f for f in found if f.type == fs.FileType.File and f.path.endswith(suffix) and not any(p[:1] in "._" for p in f.path[len(root) :].split("/") if p))
    return sorted(Found(f.mtime_ns or 0, f.path, f.size) for f in visible)


def groups(files: list[Found], most: int) -> list[FileGroup]:
    """The files in their order, in groups of up to ``most`` bytes; a larger file is a group of its own."""
    out: list[list[str]] = []
    size = most + 1
    for f in files:
        if size + f.size > most:
            out.append([])
            size = 0
        out[-1].append(f.path)
        size += f.size
    return [FileGroup(tuple(g)) for g in out]


class _Files:
    """What both readers need: where the files are and how one becomes rows."""

    def __init__(self, options: dict[str, str], rows) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".txt")
        self.most, self.rows = int(options.get("group_bytes", GROUP_BYTES)), rows

    def read(self, partition: FileGroup) -> Iterator[tuple]:
        store, _ = _store(self.path)
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as stream:
                yield from self.rows(path, stream.read())


class CorpusReader(_Files, DataSourceReader):
    def partitions(self) -> list[FileGroup]:
        return groups(listed(self.path, self.suffix), self.most) or [FileGroup(())]


class CorpusStreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.path, self.suffix)
        return {"time": files[-1].time, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FileGroup]:
        inside = [f for f in listed(self.path, self.suffix) if (start["time"], start["path"]) < (f.time, f.path) <= (end["time"], end["path"])]
        return groups(inside, self.most) or [FileGroup(())]

    def commit(self, end: dict) -> None:
        pass


class Corpus(DataSource):
    """Plain-text books: ``(path, title, text)``; bytes that are no UTF-8 are read in the likeliest character set."""

    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return "path string, title string, text string"

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        """The rows of one file."""
        from .charsets import detect

        try:
            text = data.decode()
        except UnicodeDecodeError:
            found = detect(data)
            text = found[0] if found else None
        yield path, path.rpartition("/")[2].rpartition(".")[0], text

    def reader(self, schema) -> CorpusReader:
        return CorpusReader(self.options, self.rows)

    def streamReader(self, schema) -> CorpusStreamReader:  # noqa: N802
        return CorpusStreamReader(self.options, self.rows)


class JsonLines(Corpus):
    """Books as lines of JSON with ``title`` and ``text``; other lines are left out."""

    @classmethod
    def name(cls) -> str:
        return "corpus_jsonl"

    def rows(self, path: str, data: bytes) -> Iterator[tuple]:
        for line in data.decode(errors="replace").splitlines():
            try:
                book = json.loads(line)
            except ValueError:
                continue
            if isinstance(book, dict):
                yield path, book.get("title"), book.get("text")


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Make the sources known to a session: those of this module, and a caller's own."""
    for source in (Corpus, JsonLines, *sources):
        spark.dataSource.register(source)
