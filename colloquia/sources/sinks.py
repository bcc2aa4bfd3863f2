"""Writers. Each writes in parallel; none gathers rows on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def write_transcripts(lines: DataFrame, path: str) -> None:
    """Text files per local day; lines of a day are ordered inside each file and files are
    range-split on time, so one busy day is several files in order."""
    lines.repartitionByRange("day", "sent_at").sortWithinPartitions("day", "sent_at", "row_id").select("day", "line").write.mode("overwrite").partitionBy("day").text(path)


def write_report(tables: dict[str, DataFrame], path: str, by: dict[str, list[str]] | None = None) -> None:
    """One Parquet folder per report table; ``by`` names the partition columns of some (day, group). Rows are
    rebalanced by them, so a busy partition is several files and a quiet one is one."""
    for name, table in tables.items():
        parts = (by or {}).get(name, [])
        (table.hint("rebalance", *parts) if parts else table).write.mode("overwrite").partitionBy(*parts).parquet(f"{path}/{name}")


def write_jsonl(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_csv(records: DataFrame, path: str) -> None:
    """Quoted CSV; give it the guarded cells of ``export.csv_records``."""
    records.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)


def write_sidecars(files: DataFrame, folder: str) -> None:
    """One text file per (path, content) row, under exactly that path below ``folder``; see ``NamedFiles``."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select("path", "content").write.format("named-files").mode("append").save(folder)


class NamedFiles(DataSource):
    """Writes each row as a file with the name it asks for, in any file system that Arrow reaches.

    Two phases: a task writes below a staging folder of the job and of its own; the commit moves
    the files of the tasks that Spark counts, so what a failed or repeated task wrote is never
    seen, and an aborted job leaves nothing. The driver handles names, never contents.
    """

    @classmethod
    def name(cls) -> str:
        return "named-files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _NamedFilesWriter(self.options["path"])


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class _NamedFilesWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path, self.staging = path.rstrip("/"), f"_staging-{uuid4().hex}"

    def _system(self):
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, root

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        system, root = self._system()
        own, names = f"{self.staging}/{uuid4().hex}", []
        for path, content in iterator:
            name = path.strip("/")
            if not name or ".." in name.split("/"):
                raise ValueError(f"not a file below the folder: {path!r}")
            system.create_dir(f"{root}/{own}/{name}".rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(f"{root}/{own}/{name}") as out:
                out.write((content or "").encode())
            names.append(name)
        return _Staged(own, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = self._system()
        staged = [(m.folder, name) for m in messages if m is not None for name in m.names]
        for folder in {f"{root}/{name}".rsplit("/", 1)[0] for _, name in staged}:
            system.create_dir(folder, recursive=True)
        with ThreadPoolExecutor(32) as pool:
            list(pool.map(lambda f: system.move(f"{root}/{f[0]}/{f[1]}", f"{root}/{f[1]}"), staged))
        self._drop(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop(*self._system())

    def _drop(self, system, root: str) -> None:
        from pyarrow import fs
        if system.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.staging}")
