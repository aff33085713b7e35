"""Ingest of a folder of files that hold pages: two ledgers, failures as rows, counters.

Edge cases: a file that can't be read or has no page is a failure with its reason, and the others go on; it isn't entered, so
that it is tried again. The same file under several names is read once, a page that several files hold is one sheet. An
empty folder gives no rows. A task holds one file at a time.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators.lineage import settled

c = F.col
PAGES = "file_sha string, name string, page int, page_sha string, content binary, failure string"


def zip_pages(content: bytes) -> list[bytes]:
    """The members of an archive, in order of name."""
    with zipfile.ZipFile(io.BytesIO(content)) as f:
        return [f.read(n) for n in sorted(f.namelist()) if not n.endswith("/")]


def read_files(spark: SparkSession, folder: str, pattern: str = ".*") -> DataFrame:
    """name, file_sha, content of a folder's files with such a name, each content under its least name."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    hashed = files.where(c("name").rlike(pattern)).withColumn("file_sha", F.sha2("content", 256))
    return hashed.groupBy("file_sha").agg(F.min("name").alias("name"), F.any_value("content").alias("content"))


def explode_pages(files: DataFrame, pages: Callable[[bytes], list[bytes]]) -> DataFrame:
    """One row a page of each file, or one with the failure."""
    schema = pa.schema([("file_sha", pa.string()), ("name", pa.string()), ("page", pa.int32()), ("page_sha", pa.string()), ("content", pa.binary()), ("failure", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in parts:
            for i in range(len(p)):
                sha, name, content = (p.column(k)[i].as_py() for k in range(3))
                try:
                    found = pages(content)
                    if not found:
                        raise ValueError("no pages")
                    rows = [(sha, name, k, hashlib.sha256(x).hexdigest(), x, None) for k, x in enumerate(found)]
                except Exception as e:  # whatever a broken file does to its reader is told, not raised
                    rows = [(sha, name, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return files.select("file_sha", "name", "content").mapInArrow(run, PAGES)


class Ingest:
    """What one pass over a folder found; every part is a table."""

    def __init__(self, spark: SparkSession, folder: str, file_ledger: DataFrame, page_ledger: DataFrame, pattern: str = ".*", pages: Callable[[bytes], list[bytes]] = zip_pages):
        """file_ledger: file_sha of files done; page_ledger: page_sha of sheets that are there."""
        files = read_files(spark, folder, pattern)
        self._seen = files.agg(F.count(F.lit(1)).alias("seen"))
        fresh = files.join(file_ledger.select("file_sha").distinct(), "file_sha", "left_anti")
        self._pages = settled(explode_pages(fresh, pages))
        whole = self._pages.where("failure is null")
        new = whole.join(page_ledger.select("page_sha").distinct(), "page_sha", "left_anti")
        first = F.min(F.struct("name", "page", "file_sha")).alias("x")
        #: page_sha, name, page, content of pages that become sheets, each content once, from the first file by name.
        self.sheets = new.join(new.groupBy("page_sha").agg(first).select("page_sha", "x.*"), ["page_sha", "name", "page", "file_sha"]).select("page_sha", "name", "page", "content")
        #: file_sha, name, pages to enter into the ledger of files.
        self.done = whole.groupBy("file_sha", "name").agg(F.count(F.lit(1)).alias("pages"))
        #: name, failure of files that could not be read.
        self.failures = self._pages.where("failure is not null").select("name", "failure")

    def counters(self) -> DataFrame:
        """seen, files (new ones that were read), sheets (made), repeated (pages that were there), failed. One row."""
        own = self._pages.agg(F.count_distinct(F.when(c("failure").isNull(), c("file_sha"))).alias("files"), F.count("page_sha").alias("all"), F.count("failure").alias("failed"))
        made = self.sheets.agg(F.count(F.lit(1)).alias("sheets"))
        return self._seen.crossJoin(own).crossJoin(made).select("seen", "files", "sheets", (c("all") - c("sheets")).alias("repeated"), "failed")  # one row each
