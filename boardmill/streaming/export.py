"""Exports that are broken off and go on: a log of commits is the truth about what exists.

A batch writes its rows to its own folder and then commits: a small file with the batch's number, rows and
last page of each book, written under another name and renamed.  Rows without a commit, whole or
torn, don't exist for a reader and are replaced when the batch runs again, so a run that is killed
anywhere loses and repeats nothing.  The header, with version, parameters and model, is the first file written;
an export with other parameters is not gone on with.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .incremental import compatible

VERSION = 1
#: Books whose last page a commit names; a batch is a few files, and so a few books.
BOOKS_EACH = 10_000


class ExportLog:
    """The commits of one export in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, parameters: dict[str, object], model: str = ""):
        self.spark, self.path, self.parameters, self.model = spark, path.rstrip("/"), parameters, model
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._place("").getFileSystem(self._conf)

    def _place(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _write(self, name: str, content: dict[str, object]) -> None:
        """A small file that is there whole or not at all."""
        draft, place = self._place(f"{name}.draft"), self._place(name)
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        self._files.delete(place, False)
        if not self._files.rename(draft, place):
            raise OSError(f"{name} of {self.path} can't be committed")

    def _read(self, name: str) -> dict | None:
        if not self._files.exists(self._place(name)):
            return None
        size = self._files.getFileStatus(self._place(name)).getLen()
        rows = self.spark.read.text(f"{self.path}/{name}", wholetext=True).collect() if size else []
        try:
            return json.loads(rows[0].value) if rows else None
        except ValueError:
            return None

    def open(self) -> bool:
        """Whether there is something to go on with; else the folder is begun anew, and what other parameters left is removed."""
        header = self._read("header.json")
        if header and header.get("version") == VERSION and compatible(header.get("parameters", {}), json.loads(json.dumps(self.parameters)), header.get("model", ""), self.model):
            return True
        self._files.delete(self._place(""), True)
        self._files.mkdirs(self._place("commits"))
        self._write("header.json", {"version": VERSION, "parameters": self.parameters, "model": self.model})
        return False

    def commits(self) -> DataFrame:
        """(batch, rows, pages: array of (book, page)) of the finished batches."""
        schema = "batch long, rows long, pages array<struct<book:string,page:long>>"
        if not self._files.exists(self._place("commits")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.path}/commits")

    def rows(self, schema: str) -> DataFrame:
        """What the finished batches wrote, and nothing else."""
        if not self._files.exists(self._place("rows")):
            return self.spark.createDataFrame([], schema)
        table = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.path}/rows")
        return table.join(F.broadcast(self.commits().select("batch")), "batch", "left_semi").drop("batch")  # a number for each batch

    def resume_from(self) -> DataFrame:
        """(book, resume_from): the page after the last that a finished batch holds; pages without rows count if they were given."""
        return self.commits().select(F.explode("pages").alias("p")).groupBy("p.book").agg((F.max("p.page") + 1).alias("resume_from"))

    def sink(self, book: str, page: str, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
        """A sink for batches of pages: ``keep`` makes the rows to be written of them; every page counts as done.

        Rows, their number and the pages come from one pass over the batch.
        """

        def write(batch: DataFrame, number: int) -> None:
            if self._files.exists(self._place(f"commits/{number}.json")):
                return
            seen, kept = Observation(), Observation()
            last = F.collect_set(F.struct(F.col(book).cast("string").alias("book"), F.col(page).cast("long").alias("page")))
            counted = batch.observe(seen, last.alias("pages"))
            keep(counted).observe(kept, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
            pages: dict[str, int] = {}
            for p in seen.get["pages"]:
                pages[p["book"]] = max(p["page"], pages.get(p["book"], -1))
            if len(pages) > BOOKS_EACH:
                raise ValueError(f"a batch of {len(pages)} books: give fewer files to each")
            self._write(f"commits/{number}.json", {"batch": number, "rows": kept.get["rows"], "pages": [{"book": b, "page": p} for b, p in sorted(pages.items())]})

        return write

    def discard(self) -> None:
        """Removes the export's folder, once its result is elsewhere."""
        self._files.delete(self._place(""), True)
