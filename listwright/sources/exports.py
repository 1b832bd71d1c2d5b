"""A sink for exports: lines in parts that, one after another, are the file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "listwright_export"
END = "\r\n"


@dataclass
class Part(WriterCommitMessage):
    number: int
    written: str


class ExportSource(DataSource):
    """Writes rows of one column, line, to options path and header.

    The first part begins with the header; before every other line stands a CRLF, so parts put
    together have the header once, CRLF between lines and none at the end.  Parts get their
    names when all tasks have ended well: a task that is run again or twice leaves no second part.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ExportWriter(self.options["path"], self.options["header"], overwrite)


class ExportWriter(DataSourceWriter):
    def __init__(self, path: str, header: str, overwrite: bool):
        self.path, self.header, self.overwrite = path.rstrip("/"), header, overwrite
        self.job = uuid.uuid4().hex

    def place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def write(self, rows: Iterator) -> Part:
        store, path = self.place()
        number = TaskContext.get().partitionId()
        target = f"{path}/_{self.job}/{number}-{uuid.uuid4().hex}"
        store.create_dir(f"{path}/_{self.job}", recursive=True)
        with store.open_output_stream(target) as out:
            if number == 0:
                out.write(self.header.encode())
            for row in rows:
                out.write((END + row[0]).encode())
        return Part(number, target)

    def commit(self, messages: list) -> None:
        store, path = self.place()
        store.create_dir(path, recursive=True)
        if self.overwrite:
            from pyarrow import fs

            for old in store.get_file_info(fs.FileSelector(path)):
                if old.base_name.startswith("part-"):
                    store.delete_file(old.path)
        parts = [m for m in messages if m is not None]
        for m in parts:
            store.move(m.written, f"{path}/part-{m.number:05d}.csv")
        if not any(m.number == 0 for m in parts):  # no rows at all
            with store.open_output_stream(f"{path}/part-00000.csv") as out:
                out.write(self.header.encode())
        self.leave(store, path)

    def abort(self, messages: list) -> None:
        self.leave(*self.place())

    def leave(self, store, path: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{path}/_{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{path}/_{self.job}")


def write_lines(lines: DataFrame, path: str, header: str, mode: str = "append") -> None:
    """lines(line), in their order, to parts in the folder path; mode is append (to nothing) or overwrite."""
    lines.sparkSession.dataSource.register(ExportSource)
    lines.select("line").write.format(NAME).option("header", header).mode(mode).save(path)
