"""Ingestion: documents to stored chunks, one lazy plan over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.text import content_hash, search_text, token_count
from lexigrain.operators.chunks import chunk_documents
from lexigrain.operators.classify import Classifier, RuleClassifier
from lexigrain.operators.embed import Embedder, HashEmbedder
from lexigrain.operators.store import COLUMNS, ChunkStore
from lexigrain.schema import DOCUMENT_TYPES, Source
from lexigrain.sources.extract import Extractor
from lexigrain.sources.files import read_documents


def assemble(docs: DataFrame, source: Source, classifier: Classifier | None = None, embedder: Embedder | None = None, document_type: str = "core_rules") -> DataFrame:
    """Chunks in the store's columns from documents (doc_id, doc_path, text, optionally paged and document_type).

    Token counts and hashes are of the raw chunk; the stored and embedded text
    has the headings in front.  Ids come from source, document and content.
    """
    if document_type not in DOCUMENT_TYPES:
        raise ValueError(f"document_type must be one of {', '.join(DOCUMENT_TYPES)}")
    names = set(docs.columns)
    base = docs.select("doc_id", "doc_path", "text", (F.col("paged") if "paged" in names else F.lit(False)).alias("paged"), (F.col("document_type") if "document_type" in names else F.lit(document_type)).alias("document_type"))
    # Page markers are found and taken out of paged documents alone.
    from_pages = chunk_documents(base, source.chunking, paged=True)
    plain = chunk_documents(base, source.chunking)
    cut = plain.filter(~F.col("paged")).unionByName(from_pages.filter("paged")) if "paged" in names else plain
    classified = (classifier or RuleClassifier()).apply(cut)
    ready = classified.withColumn("token_count", token_count("text")).withColumn("content_hash", content_hash("text")).withColumn("text", search_text("heading_path", "text"))
    embedded = (embedder or HashEmbedder(source.embedding_dim)).apply(ready, "text")
    given = {
        "id": F.sha2(F.concat_ws("\x01", F.lit(source.id), "doc_id", "content_hash"), 256),
        "source_id": F.lit(source.id),
        "embedding_model": F.lit(source.embedding_model),
        "system": F.lit(source.system),
        "edition": F.lit(""),
        "parent_id": F.lit(None).cast("string"),
        "license": F.lit(source.license),
        "doc_id": F.col("doc_id").cast("string"),
    }
    return embedded.withColumns(given).select(*COLUMNS)


def ingest_documents(store: ChunkStore, source: Source, docs: DataFrame, classifier: Classifier | None = None, embedder: Embedder | None = None, document_type: str = "core_rules") -> int:
    """Chunk, classify, embed and insert documents; returns how many chunks were new."""
    store.initialize(source)
    return store.insert(source, assemble(docs, source, classifier, embedder, document_type))


def ingest_files(store: ChunkStore, source: Source, path: str, doc_id: str, document_type: str = "core_rules", format: str = "auto", classifier: Classifier | None = None, embedder: Embedder | None = None, extractor: Extractor | None = None) -> int:
    """Ingest files as one document id; pdf needs an extractor."""
    docs = read_documents(store.spark, path, format, extractor).withColumn("doc_id", F.lit(doc_id))
    return ingest_documents(store, source, docs, classifier, embedder, document_type)
