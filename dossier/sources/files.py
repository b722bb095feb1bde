"""Writing files whole, a file a row, and reading a folder's files back with all that is found in them.

The sink is a Spark data source. Each task writes its files into a folder of its own attempt below a temporary one; when all
tasks have ended well the driver moves those folders into place, one a task, and drops the temporary one. So a job that fails
leaves nothing, and of a task that ran twice only the attempt that Spark counts is kept. The path may be on any file
system that Arrow opens by its URI; on a cluster it has to be one that all executors share.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from dossier.functions.text import source_text
from dossier.operators.extract import import_texts
from dossier.operators.lines import with_sections
from dossier.sources import writers
from dossier.sources.extract import extract
from dossier.sources.formats import OWN_SUFFIX, TASKS, is_text_route, read_files

#: What a name may be: one step of a path that is neither this folder nor the one above.
NAME = re.compile(r"(?!\.{1,2}$)[^/\\\0]+")
SUFFIXES = {
    "own_json": OWN_SUFFIX, "json_resume": ".json", "yaml": ".yaml", "europass_xml": ".europass.xml", "hr_xml": ".hr.xml", "csv": ".csv", "tsv": ".tsv", "txt": ".txt", "md": ".md", "html": ".html", "latex": ".tex",
}


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int


class FileWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.stage = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        system, at = self._at(self.stage)
        system.create_dir(at, recursive=True)

    @staticmethod
    def _at(path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def write(self, rows: Iterator[Row]) -> Written:
        task = TaskContext.get()
        folder, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}", 0
        system, at = self._at(f"{self.stage}/{folder}")
        system.create_dir(at, recursive=False)  # a task that starts after its job has failed makes no folder anew
        seen: set[str] = set()
        for row in rows:
            if row["name"] is None or not NAME.fullmatch(row["name"]) or row["name"] in seen:
                raise ValueError(f"no name for a file, or one given twice: {row['name']!r}")
            seen.add(row["name"])
            with system.open_output_stream(f"{at}/{row['name']}", compression=None) as out:
                out.write(bytes(row["content"] or b""))
            n += 1
        return Written(folder, n)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = self._at(self.path)
        for m in messages:
            if m and m.files:
                system.move(f"{self._at(self.stage)[1]}/{m.folder}", f"{at}/{m.folder}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, at = self._at(self.stage)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            # Tasks that still run write by the old name, so nothing is added while the folder goes.
            system.move(at, f"{at}-gone")
            system.delete_dir(f"{at}-gone")


class FileSink(DataSource):
    """``dossier_files``: rows (name string, content binary) as files below a path; only appends."""

    @classmethod
    def name(cls) -> str:
        return "dossier_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        if overwrite:
            raise ValueError("files are only added")
        return FileWriter(self.options["path"])


def write_files(df: DataFrame, path: str) -> None:
    """A file for each row (name, content as text or bytes) below a path, byte for byte; a null content is an empty file.

    Rows are dealt out to tasks by name, and a name that is given twice, is null or leads elsewhere fails the job.
    """
    spark = df.sparkSession
    spark.dataSource.register(FileSink)
    rows = df.select("name", F.col("content").cast("binary").alias("content"))
    rows.repartition(spark.sparkContext.defaultParallelism * TASKS, "name").write.format("dossier_files").mode("append").save(path)


def export_files(cvs: DataFrame, key: str, path: str, formats: tuple[str, ...] = writers.FORMATS) -> None:
    """CV rows in each text format as files named by key and format."""
    suffix = F.create_map(*(F.lit(x) for f in formats for x in (f, SUFFIXES[f])))
    made = writers.export(cvs, key, formats)
    write_files(made.select(F.concat(F.col(key).cast("string"), F.element_at(suffix, F.col("format"))).alias("name"), "content"), path)


def text_attempts(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, extraction, sections, result) of a folder's files that go through text; structured ones have no row.

    ``extraction`` holds text, links, warnings and error as they were read, ``sections`` the segmented text, ``result`` the fields.
    """
    texts = extract(read_files(spark, path)).where(is_text_route(F.col("format")))
    extraction = F.struct("text", "links", "warnings", "error").alias("extraction")
    parts = with_sections(texts.select("path", "format", extraction, source_text("text").alias("_text")), "_text").drop("warning")
    # What is known of a file goes with it as its key, so files are opened once and nothing is joined.
    known = F.struct("path", "format", "extraction", "sections")
    read = import_texts(parts.select(known.alias("file"), source_text("extraction.text").alias("text")), "file")
    result = F.when(F.col("file.extraction.error").isNull(), F.struct(*(c for c in read.columns if c != "file")))
    return read.select("file.*", result.alias("result"))
