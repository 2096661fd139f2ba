"""A sink of named files: df.write.format("named_files").mode("append").save(folder) with rows (name, content).

Each task writes its files into a folder of its own below `_staging`; when all tasks have ended, the driver moves them into
place by name, folder by folder, and removes the staging. If a task fails for good, or the job is stopped, nothing of the
job appears. No content passes through the driver: a task tells it only its folder. Names may hold folders; a name that
leaves the target is an error; of rows with equal names in one job the last one moved stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from crestline.sources.ranges import system_of


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.staging = path, f"_staging-{uuid.uuid4().hex}"

    def _base(self) -> tuple[fs.FileSystem, str]:
        system, base, _ = system_of(self.path)
        return system, base.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, base = self._base()
        folder, made, files = f"{base}/{self.staging}/{uuid.uuid4().hex}", set(), 0  # a second attempt has another folder
        for row in iterator:
            name, content = row[0], row[1]
            if not name or name.startswith("/") or ".." in name.split("/"):
                raise ValueError(f"no name for a file: {name!r}")
            place = f"{folder}/{name}"
            parent = place.rsplit("/", 1)[0]
            if parent not in made:
                system.create_dir(parent, recursive=True)
                made.add(parent)
            with system.open_output_stream(place) as out:
                out.write(content.encode() if isinstance(content, str) else bytes(content or b""))
            files += 1
        return Staged(folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, base = self._base()
        system.create_dir(base, recursive=True)
        for message in messages:
            if message is None or not message.files:
                continue
            for info in system.get_file_info(fs.FileSelector(message.folder, recursive=True)):
                target = f"{base}/{info.path[len(message.folder) :].lstrip('/')}"
                if info.type == fs.FileType.Directory:
                    system.create_dir(target, recursive=True)
                else:
                    system.move(info.path, target)
        self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, base = self._base()
        place = f"{base}/{self.staging}"
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NamedFiles)


def write_files(files: DataFrame, folder: str) -> None:
    """Writes (name, content) rows as files of a folder, all or none."""
    register(files.sparkSession)
    files.write.format("named_files").mode("append").save(folder)
