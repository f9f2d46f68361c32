"""Table schemas, closed vocabularies and configuration records."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Fixed values.
LICENSES = ("cc_by", "cc_by_sa", "ogl", "orc", "homebrew", "proprietary")
DOCUMENT_TYPES = ("core_rules", "adventure", "supplement", "campaign")
OVERFLOWS = ("paragraph", "sentence", "token")
DEFAULT_CONTENT_TYPES = frozenset({"mechanic", "lore", "adventure_scene", "table", "stat_block", "example", "gm_guidance", "flavor", "procedure", "boxed_text"})
PBTA_CONTENT_TYPES = DEFAULT_CONTENT_TYPES | {"move", "gm_move", "playbook", "oracle", "front"}
YZE_CONTENT_TYPES = DEFAULT_CONTENT_TYPES | {"oracle", "faction", "gear"}
CONTENT_TYPES = PBTA_CONTENT_TYPES | YZE_CONTENT_TYPES
FILTER_COLUMNS = ("content_type", "document_type", "system", "doc_id")

_S, _I = T.StringType(), T.IntegerType()
_STRINGS = T.ArrayType(_S)

PAGE_SCHEMA = T.StructType([T.StructField("page_num", _I), T.StructField("text", _S)])
CLASSIFICATION_SCHEMA = T.StructType([T.StructField("content_type", _S), T.StructField("tags", _STRINGS), *(T.StructField(c, _S) for c in ("move_trigger", "scene_type", "encounter_key", "npc_name"))])
META_SCHEMA = T.StructType([T.StructField(c, _S) for c in ("source_id", "key", "value")])
CHUNK_SCHEMA = T.StructType(
    [
        T.StructField("id", _S, False),
        *(T.StructField(c, _S) for c in ("source_id", "doc_id", "doc_path", "text")),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_model", _S),
        T.StructField("token_count", _I),
        *(T.StructField(c, _S) for c in ("content_hash", "document_type", "system", "edition", "page")),
        T.StructField("heading_path", _STRINGS),
        T.StructField("chunk_order", _I),
        *(T.StructField(c, _S) for c in ("parent_id", "content_type")),
        T.StructField("tags", _STRINGS),
        *(T.StructField(c, _S) for c in ("move_trigger", "scene_type", "encounter_key", "npc_name", "license")),
    ]
)


@dataclass(frozen=True)
class ChunkingConfig:
    """Token budgets: sections under ``min_tokens`` are merged forward, texts over ``max_tokens`` are split from the ``overflow`` rung on."""

    min_tokens: int = 100
    max_tokens: int = 800
    overflow: str = "paragraph"
    overlap_tokens: int = 50
    atomic_patterns: tuple[str, ...] = ()  # accepted for compatibility; tables are atomic by themselves

    def __post_init__(self) -> None:
        if self.max_tokens <= 0:
            raise ValueError("max_tokens must be positive")
        if self.overflow not in OVERFLOWS:
            raise ValueError(f"overflow must be one of {', '.join(OVERFLOWS)}")

    def with_(self, **changes) -> ChunkingConfig:
        """A copy with some values changed."""
        return dataclasses.replace(self, **changes)


@dataclass(frozen=True)
class Source:
    """One corpus: where it is stored, how it is embedded, chunked and classified."""

    id: str
    name: str
    system: str
    store_path: str
    embedding_model: str
    embedding_dim: int
    license: str
    chunking: ChunkingConfig = field(default_factory=ChunkingConfig)
    content_types: frozenset[str] = DEFAULT_CONTENT_TYPES

    def __post_init__(self) -> None:
        if self.license not in LICENSES:
            raise ValueError(f"license must be one of {', '.join(LICENSES)}")
        if self.embedding_dim <= 0:
            raise ValueError("embedding_dim must be positive")
