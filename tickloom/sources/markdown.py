"""A tree of Markdown files as a Spark data source: read, written and followed as a stream.

    spark.dataSource.register(MarkdownTree)
    spark.read.format("markdown").load(folder)                      # path, text
    df.select("path", "text").write.format("markdown").mode("append").save(folder)
    spark.readStream.format("markdown").load(folder)

``path`` is relative to the folder, with ``/`` between parts.  Files named ``_meta.md`` are
no documents.  Spark's own text writer names its files itself; here a row names its file.
The folder must be one that the driver and all executors see.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

META = "_meta.md"
SCHEMA = "path string, text string"
FILES_PER_TASK = 256


def markdown_files(folder: str) -> list[str]:
    """Paths of the tree's documents relative to the folder, in path order."""
    found = []
    for top, folders, names in os.walk(folder):
        folders[:] = [f for f in folders if not f.startswith(".")]
        found += [os.path.relpath(os.path.join(top, n), folder).replace(os.sep, "/") for n in names if n.endswith(".md") and n != META and not n.startswith(".")]
    return sorted(found)


@dataclass
class Files(InputPartition):
    paths: list[str]


def _parts(paths: list[str], each: int) -> list[Files]:
    return [Files(paths[i : i + each]) for i in range(0, len(paths), each)]


def _texts(folder: str, part: Files) -> Iterator[tuple[str, str]]:
    for path in part.paths:
        with open(os.path.join(folder, path), encoding="utf-8", newline="") as file:
            yield path, file.read()


def _folder(options: dict) -> str:
    return options["path"].removeprefix("file://")


class TreeReader(DataSourceReader):
    """One task for every ``filesPerTask`` documents, in path order."""

    def __init__(self, options: dict) -> None:
        self.folder, self.each = _folder(options), int(options.get("filesPerTask", FILES_PER_TASK))

    def partitions(self) -> list[Files]:
        return _parts(markdown_files(self.folder), self.each) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return _texts(self.folder, partition)


class TreeStream(DataSourceStreamReader):
    """Documents as they come.  The offset is the number of files, oldest first; files are not changed once written."""

    def __init__(self, options: dict) -> None:
        self.folder, self.each = _folder(options), int(options.get("filesPerTask", FILES_PER_TASK))

    def _ordered(self) -> list[str]:
        return sorted(markdown_files(self.folder), key=lambda p: (os.stat(os.path.join(self.folder, p)).st_mtime_ns, p))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(markdown_files(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return _parts(self._ordered()[start["files"] : end["files"]], self.each)

    def read(self, partition: Files) -> Iterator[tuple[str, str]]:
        return _texts(self.folder, partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    pairs: list[tuple[str, str]]  # hidden name, path


class TreeWriter(DataSourceWriter):
    """Each row becomes the file that it names.

    Tasks write under hidden names; the driver puts them in place when all tasks are
    done, so a failed or repeated task leaves no document behind.
    """

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder, self.overwrite = _folder(options), overwrite

    def write(self, iterator) -> Written:
        pairs = []
        for row in iterator:
            path = row["path"]
            if not path or not path.endswith(".md") or path.startswith("/") or any(p in ("", ".", "..") or p.startswith(".") for p in path.split("/")):
                raise ValueError(f"not a relative Markdown path: {path!r}")
            top, name = os.path.split(os.path.join(self.folder, path))
            os.makedirs(top, exist_ok=True)
            hidden = os.path.join(top, f".{name}-{uuid.uuid4().hex}")
            with open(hidden, "w", encoding="utf-8", newline="") as file:
                file.write(row["text"] or "")
            pairs.append((hidden, os.path.join(top, name)))
        return Written(pairs)

    def commit(self, messages: list[Written | None]) -> None:
        pairs = [p for m in messages if m is not None for p in m.pairs]
        kept = {final for _, final in pairs}
        if self.overwrite:
            for path in markdown_files(self.folder):
                if os.path.join(self.folder, path) not in kept:
                    os.remove(os.path.join(self.folder, path))
        for hidden, final in pairs:
            os.replace(hidden, final)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for hidden, _ in m.pairs if m is not None else []:
                if os.path.exists(hidden):
                    os.remove(hidden)


class MarkdownTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "markdown"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options, overwrite)
