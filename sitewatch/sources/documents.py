"""Documents as single objects, written by a Python data source.

``df.write.format("site_documents").mode("append").save(path)`` puts each row (file_name,
document) at ``{path}/{file_name}``, UTF-8 and nothing else.  A task writes an object
beside its place and moves it there when it is whole, so a reader never sees half of
one, and a task that runs twice leaves one object.  What tasks left unfinished goes when
the write is committed or given up.  A document that cannot be written (its name is
no object's name, the store refuses it) does not stop the others: it has no object.

Paths may be of any file system that pyarrow knows (file, s3, gs, hdfs, ...).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..session import ship_package

FORMAT = "site_documents"
UNFINISHED = "_unfinished"
LONGEST_NAME = 255          # bytes


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path.rstrip("/")
    store, root = pafs.FileSystem.from_uri(path)
    return store, root.rstrip("/")


def object_name(name: str | None) -> str:
    """``name``, if it can be an object's."""
    if not name or name in (".", "..") or "/" in name or "\0" in name or len(name.encode()) > LONGEST_NAME:
        raise ValueError(f"no name of an object: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    documents: int
    refused: int


class DocumentWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.attempt = path, f"{UNFINISHED}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        store, root = _store(self.path)
        here = f"{root}/{self.attempt}/{uuid.uuid4().hex}"
        store.create_dir(here)
        written = refused = 0
        for row in iterator:
            try:
                name = object_name(row["file_name"])
                with store.open_output_stream(f"{here}/object") as out:
                    out.write((row["document"] or "").encode())
                store.move(f"{here}/object", f"{root}/{name}")
                written += 1
            except (OSError, ValueError):
                refused += 1
        return Written(written, refused)

    def commit(self, messages: list[Written | None]) -> None:
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/{self.attempt}").type != pafs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.attempt}")


class SiteDocuments(DataSource):
    """The registered format; see the module."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file_name string, document string"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and to those that streams derive from it afterwards."""
    try:
        spark.dataSource.register(SiteDocuments)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def write_objects(docs: DataFrame, path: str) -> None:
    """Write (file_name, document) rows as objects under ``path``; those of the same names are replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    register(spark)
    docs.select("file_name", "document").write.format(FORMAT).mode("append").save(path)


def object_names(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, size_bytes) of the objects under ``path``, but for empty ones; none is opened."""
    listed = spark.read.format("binaryFile").load(path)
    return listed.select(F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("size_bytes"))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, document) of the objects under ``path``, but for empty ones."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(F.substring_index("path", "/", -1).alias("file_name"), F.col("content").cast("string").alias("document"))
