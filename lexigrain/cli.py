"""Command line: ingest files into a source's store."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lexigrain.operators.classify import ConstantClassifier, RuleClassifier
from lexigrain.operators.embed import HashEmbedder, HostedEmbedder, LocalServiceEmbedder
from lexigrain.operators.store import ChunkStore
from lexigrain.plans.ingest import ingest_files
from lexigrain.schema import DOCUMENT_TYPES
from lexigrain.sources.config import load_source
from lexigrain.sources.extract import Poppler


def parser() -> argparse.ArgumentParser:
    """The arguments; what is missing or unknown ends with status 2."""
    p = argparse.ArgumentParser(prog="lexigrain", description="Ingest files into a chunk store.")
    p.add_argument("--source-config", required=True)
    p.add_argument("--doc-id", required=True)
    p.add_argument("--document-type", required=True, choices=DOCUMENT_TYPES)
    p.add_argument("--path", required=True)
    p.add_argument("--format", default="auto", choices=("auto", "markdown", "pdf"))
    p.add_argument("--classify", default="heuristic", choices=("heuristic", "mock"))
    p.add_argument("--embed", default="ollama", choices=("ollama", "nomic", "mock"))
    p.add_argument("--extract", default="none", choices=("none", "poppler"))
    p.add_argument("--nomic-api-key")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    source = load_source(args.source_config)
    model, dim = source.embedding_model, source.embedding_dim
    embedder = {"mock": lambda: HashEmbedder(dim), "ollama": lambda: LocalServiceEmbedder(model, dim), "nomic": lambda: HostedEmbedder(model=model, dim=dim, key=args.nomic_api_key)}[args.embed]()
    classifier = {"heuristic": RuleClassifier, "mock": ConstantClassifier}[args.classify]()
    spark = SparkSession.builder.appName("lexigrain").getOrCreate()
    n = ingest_files(ChunkStore(spark, source.store_path), source, args.path, args.doc_id, args.document_type, args.format, classifier, embedder, Poppler() if args.extract == "poppler" else None)
    print(f"source={source.id} doc={args.doc_id} → inserted {n} chunk(s) into {source.store_path}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
