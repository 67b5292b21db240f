"""Sinks of one file for each key, of which only what was committed stays."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, of those that Arrow reaches (local, S3, GCS, HDFS), and the path in it."""
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class CommittedWriter(DataSourceWriter):
    """A task writes to names of its own in a folder for what is not done; commit moves what the tasks that succeeded have written and removes the
    folder, abort removes it alone. So a task that fails and runs again leaves neither half a file nor two."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"].rstrip("/")
        self.waiting = f"{self.path}/_temporary/{uuid.uuid4().hex}"

    def commit(self, messages: list[Written | None]) -> None:
        store, where = located(self.path)
        for message in messages:
            for at, name in message.files if message else []:
                store.move(at, f"{where}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, where = located(f"{self.path}/_temporary")
        if store.get_file_info(where).type != fs.FileType.NotFound:
            store.delete_dir(where)


class TextWriter(CommittedWriter):
    """A file for each row (file, content)."""

    def write(self, iterator: Iterator) -> Written:
        store, waiting = located(self.waiting)
        store.create_dir(waiting, recursive=True)
        done = []
        for row in iterator:
            at = f"{waiting}/{uuid.uuid4().hex}"
            with store.open_output_stream(at) as file:
                file.write(row["content"].encode())
            done.append((at, row["file"]))
        return Written(done)


class KeyedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_text"

    def schema(self) -> str:
        return "file string, content string"

    def writer(self, schema, overwrite: bool) -> TextWriter:
        return TextWriter(dict(self.options))


def write_text(rows: DataFrame, path: str) -> None:
    """Each row (file, content) as a file of that name in the folder ``path``; one of the same name is replaced."""
    rows.sparkSession.dataSource.register(KeyedText)
    rows.select("file", "content").write.format("keyed_text").mode("append").save(path)
