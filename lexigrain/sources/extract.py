"""Page extraction: given pages, Poppler, a page cache, and transcription by a vision model."""

from __future__ import annotations

import os
import re
import subprocess
import tempfile
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions.text import split_pages
from lexigrain.storage import materialize

MAX_OUTPUT_BYTES = 256 << 20
#: path, page_num, text
PAGES = "path string, page_num int, text string"
TRANSCRIBE = "Transcribe this page as markdown. Keep headings as # lines, lists, and tables as pipe tables. Give the text alone, without remarks."


class Extractor(ABC):
    """Pages of files: (path, page_num from 1, text); blank pages are left out."""

    @abstractmethod
    def pages(self, files: DataFrame) -> DataFrame:
        """Pages of ``files``, a frame as the binaryFile source reads it (path, content)."""

    def page(self, files: DataFrame, number: int) -> DataFrame:
        """One page of each file; an error if none has it."""
        found = self.pages(files).filter(F.col("page_num") == number)
        if found.isEmpty():
            raise ValueError(f"page {number} not found")
        return found


@dataclass(frozen=True)
class GivenPages(Extractor):
    """The same pages for every file."""

    given: tuple[tuple[int, str], ...]

    def pages(self, files: DataFrame) -> DataFrame:
        own = F.array(*(F.struct(F.lit(n).cast("int").alias("page_num"), F.lit(t).alias("text")) for n, t in self.given))
        return files.select("path", F.inline(own)) if self.given else files.sparkSession.createDataFrame([], PAGES)


@dataclass(frozen=True)
class FormFeedText(Extractor):
    """Text files whose pages end with form feeds, in UTF-8."""

    def pages(self, files: DataFrame) -> DataFrame:
        return files.select("path", F.inline(split_pages(F.col("content").cast("string")))).select("path", F.col("page_num").cast("int").alias("page_num"), "text")


def run_tool(arguments: list[str]) -> bytes:
    """Output of a command; an error with its messages if it fails or gives more than MAX_OUTPUT_BYTES."""
    with tempfile.TemporaryFile() as out:
        try:
            done = subprocess.run(arguments, stdout=out, stderr=subprocess.PIPE, check=False)
        except OSError as e:
            raise RuntimeError(f"{arguments[0]} could not be run: {e}") from e
        if done.returncode:
            raise RuntimeError(f"{arguments[0]} failed ({done.returncode}): {done.stderr.decode(errors='replace').strip()}")
        if out.tell() > MAX_OUTPUT_BYTES:
            raise RuntimeError(f"{arguments[0]} gave more than {MAX_OUTPUT_BYTES} bytes")
        out.seek(0)
        return out.read()


def _on_files(files: DataFrame, use: Callable[[str], list[tuple]], schema: str, columns: list[str]) -> DataFrame:
    """``use(local path)`` for each file's bytes, inside the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                with tempfile.TemporaryDirectory() as folder:
                    name = os.path.join(folder, "file.pdf")
                    with open(name, "wb") as f:
                        f.write(content)
                    rows = use(name)
                yield pd.DataFrame([(path, *r) for r in rows], columns=["path", *columns])

    return files.select("path", "content").mapInPandas(run, schema)


@dataclass(frozen=True)
class Poppler(Extractor):
    """``pdftotext -layout`` in the tasks."""

    tool: str = "pdftotext"

    def pages(self, files: DataFrame) -> DataFrame:
        tool = self.tool
        whole = _on_files(files, lambda name: [(run_tool([tool, "-layout", name, "-"]).decode(errors="replace"),)], "path string, text string", ["text"])
        return whole.select("path", F.inline(split_pages("text"))).select("path", F.col("page_num").cast("int").alias("page_num"), "text")

    def page(self, files: DataFrame, number: int) -> DataFrame:
        tool = self.tool
        whole = _on_files(files, lambda name: [(number, run_tool([tool, "-layout", "-f", str(number), "-l", str(number), name, "-"]).decode(errors="replace").replace("\f", "").strip())], PAGES, ["page_num", "text"])
        found = whole.filter(F.col("text") != "")
        if found.isEmpty():
            raise ValueError(f"page {number} not found")
        return found


@dataclass(frozen=True)
class CachedPages(Extractor):
    """A table of pages by content hash in front of another extractor; page numbers are kept, so blank pages do no harm."""

    inner: Extractor
    cache_path: str

    def pages(self, files: DataFrame) -> DataFrame:
        spark = files.sparkSession
        hashed = files.withColumn("hash", F.sha2("content", 256))
        names = hashed.select("path", "hash")
        known = _read(spark, self.cache_path, "hash string, page_num int, text string")
        missing = hashed.join(known.select("hash").distinct(), "hash", "left_anti").dropDuplicates(["hash"])
        # Each content goes to the extractor under its hash: which of its copies is kept, so which path, may differ each time that Spark works it out.
        found = self.inner.pages(missing.withColumn("path", F.col("hash")).drop("hash")).withColumnRenamed("path", "hash")
        # A file without pages is known by a row of page 0.
        fresh = missing.select("hash").join(found, "hash", "left")
        fresh = materialize(fresh.select("hash", F.coalesce("page_num", F.lit(0)).alias("page_num"), "text"), "pages")
        if not fresh.isEmpty():
            fresh.write.mode("append").parquet(self.cache_path)
        return names.join(_read(spark, self.cache_path, "hash string, page_num int, text string").filter("page_num > 0"), "hash").select("path", "page_num", "text")


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def bounded_map(limit: int, use: Callable, items: list) -> list:
    """``use`` of every item, at most ``limit`` at a time, in order."""
    with ThreadPoolExecutor(max_workers=max(1, limit)) as pool:
        return list(pool.map(use, items))


@dataclass(frozen=True)
class VisionPages(Extractor):
    """Pages rendered by Poppler and transcribed by ``transcribe(png, prompt, max_tokens)``, a few at a time in each task."""

    transcribe: Callable[[bytes, str, int], str]
    concurrency: int = 5
    dpi: int = 150
    max_tokens: int = 4096

    def _count(self, name: str) -> int:
        m = re.search(r"Pages:\s+(\d+)", run_tool(["pdfinfo", name]).decode(errors="replace"))
        if not m:
            raise RuntimeError("pdfinfo gave no page count")
        return int(m[1])

    def _one(self, name: str, number: int) -> tuple[int, str]:
        stem = f"{name}-{number}"
        run_tool(["pdftoppm", "-png", "-r", str(self.dpi), "-f", str(number), "-l", str(number), "-singlefile", name, stem])
        with open(stem + ".png", "rb") as f:
            return number, self.transcribe(f.read(), TRANSCRIBE, self.max_tokens)

    def pages(self, files: DataFrame) -> DataFrame:
        return _on_files(files, lambda name: sorted(bounded_map(self.concurrency, lambda n: self._one(name, n), list(range(1, self._count(name) + 1)))), PAGES, ["page_num", "text"])

    def page(self, files: DataFrame, number: int) -> DataFrame:
        return _on_files(files, lambda name: [self._one(name, number)], PAGES, ["page_num", "text"])
