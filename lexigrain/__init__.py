"""Spark-native preparation and search of document corpora."""

from lexigrain.functions.text import content_hash, inject_page_marker, normalize_text, split_pages, token_count, ws_tokens
from lexigrain.operators.chunks import chunk_documents, sections, split_to_budget
from lexigrain.operators.classify import Classifier, ConstantClassifier, ModelClassifier, RuleClassifier, forecast_cost, reset_price_cache
from lexigrain.operators.embed import Embedder, HashEmbedder, HostedEmbedder, LocalServiceEmbedder
from lexigrain.operators.store import ChunkStore
from lexigrain.plans.ingest import assemble, ingest_documents, ingest_files
from lexigrain.schema import CHUNK_SCHEMA, DEFAULT_CONTENT_TYPES, PBTA_CONTENT_TYPES, YZE_CONTENT_TYPES, ChunkingConfig, Source
from lexigrain.sources.config import load_config, load_source, model_key, reset_config_cache
from lexigrain.sources.extract import CachedPages, Extractor, GivenPages, Poppler, VisionPages

__all__ = [
    "CHUNK_SCHEMA", "CachedPages", "ChunkStore", "ChunkingConfig", "Classifier", "ConstantClassifier", "DEFAULT_CONTENT_TYPES", "Embedder", "Extractor", "GivenPages", "HashEmbedder", "HostedEmbedder",
    "LocalServiceEmbedder", "ModelClassifier", "PBTA_CONTENT_TYPES", "Poppler", "RuleClassifier", "Source", "VisionPages", "YZE_CONTENT_TYPES", "assemble", "chunk_documents", "content_hash", "forecast_cost",
    "ingest_documents", "ingest_files", "inject_page_marker", "load_config", "load_source", "model_key", "normalize_text", "reset_config_cache", "reset_price_cache", "sections", "split_pages", "split_to_budget",
    "token_count", "ws_tokens",
]
