"""Configuration files: service keys, and sources."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path

from lexigrain.schema import DEFAULT_CONTENT_TYPES, ChunkingConfig, Source

CONFIG_FILE = "lexigrain.config.json"
_KEYS = ("anthropicApiKey", "nomicApiKey")
_loaded: dict[str, dict[str, str]] = {}


def load_config(path: str | Path = CONFIG_FILE) -> dict[str, str]:
    """The key file, read once a process: a JSON object of string keys."""
    where = str(Path(path).resolve())
    if where not in _loaded:
        try:
            data = json.loads(Path(path).read_text(encoding="utf-8"))
        except FileNotFoundError as e:
            raise ValueError(f"no config file at {where}; create it with your keys ({', '.join(_KEYS)})") from e
        except ValueError as e:
            raise ValueError(f"{where} is not JSON: {e}") from e
        if not isinstance(data, dict) or not all(isinstance(data.get(k, ""), str) for k in _KEYS):
            raise ValueError(f"{where} must be an object whose {', '.join(_KEYS)} are strings")
        _loaded[where] = {k: data[k] for k in _KEYS if k in data}
    return _loaded[where]


def reset_config_cache() -> None:
    """Forget what was read."""
    _loaded.clear()


def model_key(explicit: str | None = None, path: str | Path = CONFIG_FILE) -> str:
    """The language model's key: given, or from the config file."""
    key = explicit or load_config(path).get("anthropicApiKey")
    if not key:
        raise ValueError("no model key: give one, or put anthropicApiKey into the config file")
    return key


def source_from(data: Mapping[str, object]) -> Source:
    """A source from its JSON object: id, name, system, dbPath, embeddingModel, embeddingDim, license; chunking and contentTypes may be left out, in part or whole."""
    kinds: dict[str, type | tuple[type, ...]] = {"id": str, "name": str, "system": str, "dbPath": str, "embeddingModel": str, "embeddingDim": int, "license": str}
    for k, kind in kinds.items():
        if not isinstance(data.get(k), kind) or isinstance(data.get(k), bool):
            raise ValueError(f"source config: {k} must be of type {kind.__name__}")
    chunking = data.get("chunking") or {}
    names = {"minTokens": "min_tokens", "maxTokens": "max_tokens", "overlapTokens": "overlap_tokens", "overflow": "overflow"}
    if not isinstance(chunking, dict) or not all(isinstance(chunking.get(k, 0 if k != "overflow" else ""), str if k == "overflow" else int) for k in names):
        raise ValueError("source config: chunking has a value of a wrong type")
    types = data.get("contentTypes")
    if types is not None and not (isinstance(types, list) and all(isinstance(t, str) for t in types)):
        raise ValueError("source config: contentTypes must be a list of strings")
    return Source(
        id=data["id"], name=data["name"], system=data["system"], store_path=data["dbPath"], embedding_model=data["embeddingModel"], embedding_dim=data["embeddingDim"], license=data["license"],
        chunking=ChunkingConfig(**{names[k]: v for k, v in chunking.items() if k in names}),
        content_types=frozenset(types) if types is not None else DEFAULT_CONTENT_TYPES,
    )


def load_source(path: str | Path) -> Source:
    """A source from a JSON file."""
    return source_from(json.loads(Path(path).read_text(encoding="utf-8")))
