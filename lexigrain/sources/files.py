"""Reading documents: whole text files, and files by format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexigrain.functions.text import join_pages
from lexigrain.sources.extract import Extractor
from lexigrain.storage import shuffles_dropped

#: Bytes of a file that ``write_texts`` writes, about; whoever reads it whole holds it several times.
FILE_BYTES = 8 << 20


def resolve_format(path: Column, format: str = "auto") -> Column:
    """``pdf`` or ``markdown``: by the file's ending, any case, if ``auto``."""
    if format not in ("auto", "markdown", "pdf"):
        raise ValueError("format must be auto, markdown or pdf")
    return F.when(F.lower(path).endswith(".pdf"), "pdf").otherwise("markdown") if format == "auto" else F.lit(format)


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(doc_path, text) of text files, each whole."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_path"), F.col("value").alias("text"))


def write_texts(texts: DataFrame, path: str) -> None:
    """Write a frame of one string column as text files, a text after the other with a line break behind each.

    Files are of about FILE_BYTES, or of one text that is longer, however the
    input is cut: each can be read whole.
    """
    size = texts.agg(F.sum(F.octet_length(texts.columns[0]) + F.lit(1).cast("long"))).first()[0] or 0
    with shuffles_dropped(texts.sparkSession):
        texts.repartition(-(-size // FILE_BYTES) or 1).write.text(path)


def read_documents(spark: SparkSession, path: str | list[str], format: str = "auto", extractor: Extractor | None = None) -> DataFrame:
    """(doc_path, text, paged): markdown as it is, pdf pages joined with page markers.

    An error if there is a pdf and no extractor.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if format not in ("auto", "markdown", "pdf"):
        raise ValueError("format must be auto, markdown or pdf")
    is_pdf = lambda p: format == "pdf" or (format == "auto" and p.lower().endswith(".pdf"))
    pdfs, texts = [p for p in paths if is_pdf(p)], [p for p in paths if not is_pdf(p)]
    if pdfs and extractor is None:
        raise ValueError("an extractor is required for pdf files")
    parts = []
    if texts:
        parts.append(read_texts(spark, texts).withColumn("paged", F.lit(False)))
    if pdfs:
        pages = extractor.pages(spark.read.format("binaryFile").load(pdfs).select("path", "content"))
        ordered = F.array_sort(F.collect_list(F.struct("page_num", "text")))
        parts.append(pages.groupBy(F.col("path").alias("doc_path")).agg(join_pages(ordered).alias("text")).withColumn("paged", F.lit(True)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
