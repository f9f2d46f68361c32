"""Chunks to and from flat rows, in which arrays of strings are JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.schema import CHUNK_SCHEMA

OPTIONAL = ("parent_id", "move_trigger", "scene_type", "encounter_key", "npc_name")
ARRAYS = ("heading_path", "tags")


def parse_array(text: Column) -> Column:
    """Strings of a JSON array; none for null, anything that is no array, and what does not parse. JSON null is "null"."""
    items = F.from_json(F.when(F.trim(text).startswith("["), text), "array<string>", {"mode": "PERMISSIVE"})
    return F.coalesce(F.transform(items, lambda x: F.coalesce(x, F.lit("null"))), F.array().cast("array<string>"))


def to_flat(chunks: DataFrame) -> DataFrame:
    """``chunks`` with their arrays of strings as JSON text."""
    return chunks.withColumns({c: F.to_json(c) for c in ARRAYS})


def from_flat(rows: DataFrame) -> DataFrame:
    """Chunks in the store's columns and types from flat rows.

    A null page is empty and the optional strings stay null; other null
    strings are "null", as their text form is.  Null elements of an embedding
    are left out.
    """
    out = {}
    for f in CHUNK_SCHEMA.fields:
        c = F.col(f.name)
        if f.name in ARRAYS:
            c = parse_array(c)
        elif f.name == "embedding":
            c = F.coalesce(F.filter(c, lambda x: x.isNotNull()), F.array()).cast("array<float>")
        elif f.name == "page":
            c = F.coalesce(c.cast("string"), F.lit(""))
        elif f.dataType.typeName() == "string" and f.name not in OPTIONAL:
            c = F.coalesce(c.cast("string"), F.lit("null"))
        else:
            c = c.cast(f.dataType)
        out[f.name] = c
    return rows.select(*(c.alias(n) for n, c in out.items()))
