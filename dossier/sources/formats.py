"""Reading documents as rows: sniffing, routing, decoding. Errors are values; no document fails a job."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest document that is read.
LARGEST = 25 * 1024 * 1024
#: Tasks a core in which files are written, listed and read, and bytes of files from which a task passes them on.
TASKS, HELD = 4, 4 * 1024 * 1024
READ = (pa.string(), pa.int64(), pa.binary(), pa.string())
#: Key of the engine's own JSON files and suffix of their names.
OWN_KEY, OWN_SUFFIX = "dossierVersion", ".dossier.json"
EXTENSIONS = {
    ".pdf": "Pdf", ".docx": "Docx", ".doc": "Doc", ".odt": "Odt", ".rtf": "Rtf", ".txt": "PlainText", ".md": "Markdown", ".markdown": "Markdown",
    ".htm": "Html", ".html": "Html", ".tex": "Latex", ".abw": "Abw", ".wps": "Wps", ".pages": "Pages", ".csv": "Csv", ".tsv": "Csv",
    ".yaml": "Yaml", ".yml": "Yaml", ".jpg": "Image", ".jpeg": "Image", ".png": "Image", ".webp": "Image", ".tif": "Image", ".tiff": "Image", ".bmp": "Image",
}
STRUCTURED = ("JsonResume", "OwnJson", "EuropassXml", "HrXml", "Csv", "Yaml")
EUROPASS_TOKENS = ("europass", "skillspassport", "learnerinfo")
HR_TOKENS = ("hr-xml", "hropen", "resume", "candidate", "employmenthistory", "structuredxmlresume", "personname", "positionhistory")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def json_flavour(text: Column) -> Column:
    """'OwnJson', 'JsonResume' or 'Unknown' by the keys of an object; malformed text and other values are unknown."""
    keys = F.json_object_keys(text)
    schema = F.get_json_object(text, "$.$schema")
    known = F.arrays_overlap(keys, F.array(*map(F.lit, ("basics", "work", "education", "skills"))))
    return (
        F.when(keys.isNull(), "Unknown")
        .when(F.array_contains(keys, OWN_KEY), "OwnJson")
        .when(F.coalesce(F.lower(schema).contains("jsonresume"), F.lit(False)) | known, "JsonResume")
        .otherwise("Unknown")
    )


def xml_flavour(text: Column) -> Column:
    """'EuropassXml', 'HrXml' or 'Unknown' by names in the text; document types are refused."""
    low = F.lower(text)
    any_of = lambda tokens: F.greatest(*(low.contains(t) for t in tokens))
    return F.when(low.contains("<!doctype"), "Unknown").when(any_of(EUROPASS_TOKENS), "EuropassXml").when(any_of(HR_TOKENS), "HrXml").otherwise("Unknown")


def format_of(path: Column, text: Column) -> Column:
    """Format by extension; JSON and XML by content, JSON with the engine's suffix by name."""
    ext = extension(path)
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    own = F.lower(path).endswith(OWN_SUFFIX)
    return (
        F.when(own, "OwnJson")
        .when(ext == ".json", json_flavour(text))
        .when(ext == ".xml", xml_flavour(text))
        .otherwise(F.coalesce(F.element_at(table, ext), F.lit("Unknown")))
    )


def is_text_route(fmt: Column) -> Column:
    """Formats that go through text extraction."""
    return ~fmt.isin(*STRUCTURED) & (fmt != "Unknown")


def encoding_of(content: Column) -> Column:
    """Charset of plain text: by byte order mark, else UTF-8 where valid, else windows-1250."""
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "utf-8-sig").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be").when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("cp1250")


def _entries(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What a folder lists: names that Spark's readers pass over are left out, as are empty files."""
    seen = system.get_file_info(fs.FileSelector(folder))
    shown = (e for e in seen if not (e.base_name.startswith(".") or (e.base_name.startswith("_") and "=" not in e.base_name) or e.base_name.endswith("._COPYING_")))
    return [e for e in shown if e.type == fs.FileType.Directory or e.size]


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(at, size) of every file below a folder, dealt out to tasks: one lists the folder itself, others the folders in it."""
    system, root = fs.FileSystem.from_uri(path.rstrip("/"))
    if system.get_file_info(root).type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = ["at", "size"]

    def batch(rows: list[tuple[str, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names)

    def walk(folder: str, deep: bool) -> Iterator[list[tuple[str, int | None]]]:
        """Files of a folder, a folder at a time; folders in it come without a size, or are walked."""
        system, _ = fs.FileSystem.from_uri(path.rstrip("/"))
        todo = [folder]
        while todo:
            found = _entries(system, todo.pop())
            folders = [e.path for e in found if e.type == fs.FileType.Directory]
            yield [(e.path, e.size) for e in found if e.type == fs.FileType.File] + [(f, None) for f in folders if not deep]
            todo += folders if deep else []

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column(0).to_pylist():
                one = fs.FileSystem.from_uri(path.rstrip("/"))[0].get_file_info(at)
                yield from map(batch, [[(at, one.size)]] if one.type == fs.FileType.File else walk(at, False))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pc.is_valid(b.column(1)))
            for at in b.filter(pc.is_null(b.column(1))).column(0).to_pylist():
                yield from map(batch, walk(at, True))

    tasks = spark.sparkContext.defaultParallelism * TASKS
    first = spark.createDataFrame([(root, None)], "at string, size long").coalesce(1).mapInArrow(top, "at string, size long")
    # A number of tasks of our own, as paths alone look too small to be dealt out.
    return first.repartition(tasks, "at").mapInArrow(below, "at string, size long").repartition(tasks, "at")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, content, error): every file of a folder; larger ones than the limit come without content.

    Paths are listed and files opened by tasks, so the driver holds no list of them, and however many files there are,
    a task holds the content of a few.
    """
    largest, uri = LARGEST, path.rstrip("/")
    system, root = fs.FileSystem.from_uri(uri)
    before = "file:" if isinstance(system, fs.LocalFileSystem) else uri.split("?")[0].removesuffix(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(uri)
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for at, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                content = None
                if size <= largest:
                    with system.open_input_file(at) as f:
                        content = f.read()
                    held += len(content)
                rows.append((before + at, size, content, None if size <= largest else "too_large"))
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), READ, strict=True)], ["path", "size", "content", "error"])
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), READ, strict=True)], ["path", "size", "content", "error"])

    return list_files(spark, path).mapInArrow(run, "path string, size long, content binary, error string")
