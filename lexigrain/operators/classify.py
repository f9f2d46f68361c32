"""Chunk classifiers: constant, rule-based, and a language model behind an injected client; cost forecast."""

from __future__ import annotations

import json
import math
import re
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrain.functions.text import WS, strip
from lexigrain.schema import CLASSIFICATION_SCHEMA

# What the rules look for.
_MOVE = rf"(?i)\*\*when{WS}+([^*]+?)\*\*"
_TABLE_ROW = rf"(?m)^{WS}*\|.*\|{WS}*$"
_STAT_LINE = r"(?i)(?<![A-Za-z0-9_])(hp|hit points|armor|ac|attack)(?![A-Za-z0-9_])[^\n]*[0-9]"
_TABLE_HEADING = "tables?|oracle|random"
_BESTIARY_HEADING = "bestiary|stat ?block|npcs?|monsters?"
_LORE_HEADING = "world|geography|history|cult|faction|lore"
_GUIDE_HEADING = "running|gm ?(guide|advice)|how to run"

FIELDS = tuple(CLASSIFICATION_SCHEMA.fieldNames())
OPTIONAL = FIELDS[2:]


class Classifier(ABC):
    """Adds the classification columns to chunks that have ``text`` and ``heading_path``."""

    @abstractmethod
    def apply(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with content_type, tags and the four optional strings, replaced if present."""


def _with(chunks: DataFrame, **columns: Column) -> DataFrame:
    empty = F.lit(None).cast("string")
    defaults = {"tags": F.array().cast("array<string>"), **dict.fromkeys(OPTIONAL, empty)}
    return chunks.withColumns({c: (defaults | columns)[c] for c in FIELDS})


@dataclass(frozen=True)
class ConstantClassifier(Classifier):
    """One type and the same tags for every chunk."""

    content_type: str = "mechanic"
    tags: tuple[str, ...] = ()

    def apply(self, chunks: DataFrame) -> DataFrame:
        return _with(chunks, content_type=F.lit(self.content_type), tags=F.array(*map(F.lit, self.tags)).cast("array<string>"))


def rules(text: Column, path: Column) -> dict[str, Column]:
    """Columns of the rule-based classification: the first rule that holds decides."""
    heading = F.lower(F.array_join(path, " / "))
    move = text.rlike(_MOVE)
    table = (F.regexp_count(text, F.lit(_TABLE_ROW)) >= 2) | heading.rlike(_TABLE_HEADING)
    stats = heading.rlike(_BESTIARY_HEADING) & text.rlike(_STAT_LINE)
    kind = F.when(move, "move").when(table, "table").when(stats, "stat_block").when(heading.rlike(_GUIDE_HEADING), "gm_guidance").when(heading.rlike(_LORE_HEADING), "lore").otherwise("mechanic")
    name = strip(F.try_element_at(path, F.lit(-1)))
    return {
        "content_type": kind,
        "move_trigger": F.when(move, strip(F.regexp_extract(text, _MOVE, 1))),
        "npc_name": F.when(~move & ~table & stats & (name != ""), name),
    }


class RuleClassifier(Classifier):
    """Rules over headings and text; needs no service, and no Python on the executors."""

    def apply(self, chunks: DataFrame) -> DataFrame:
        return _with(chunks, **rules(F.col("text"), F.col("heading_path")))


def extract_json_array(text: str) -> str:
    """The first bracketed array in a reply, brackets inside strings not counted."""
    start = text.find("[")
    if start < 0:
        raise ValueError("No JSON array found in response")
    depth = 0
    for m in re.finditer(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[\[\]]', text[start:], re.S):
        depth += {"[": 1, "]": -1}.get(m[0], 0)
        if not depth:
            return text[start : start + m.end()]
    raise ValueError("Unterminated JSON array in response")


def parse_classification(item: Mapping[str, object], content_types: frozenset[str]) -> dict[str, object]:
    """A reply's entry as a record: unknown types are ``mechanic``, tags that are no list are none, null and "null" are null."""
    kind = str(item.get("content_type") or "mechanic")
    tags = item.get("tags")
    out: dict[str, object] = {"content_type": kind if kind in content_types else "mechanic", "tags": [str(t) for t in tags] if isinstance(tags, list) else []}
    for c in OPTIONAL:
        v = item.get(c)
        out[c] = None if v is None or v == "null" else str(v)
    return out


@dataclass(frozen=True)
class ModelClassifier(Classifier):
    """A language model in batches; what it leaves out or fails on is classified by the rules.

    ``complete(system, prompt, max_tokens)`` gives the reply; it is called on
    the executors and must pickle.
    """

    complete: Callable[[str, str, int], str]
    content_types: frozenset[str]
    model: str = "default"
    batch_size: int = 20
    system_hint: str = ""
    count: Callable[[str, str], int] | None = None

    def system_prompt(self) -> str:
        hint = f" of the {self.system_hint} system" if self.system_hint else ""
        return f"You sort passages of a rulebook{hint} into content types. Answer with one JSON array and nothing else: no fences, no remarks."

    def batch_prompt(self, batch: Sequence[tuple[str, Sequence[str]]]) -> str:
        """Prompt for (text, heading_path) pairs, numbered from 1."""
        n = len(batch)
        head = [
            f"There are {n} passages. Answer with a JSON array of exactly {n} objects, the k-th for passage k.",
            f"content_type is one of: {', '.join(sorted(self.content_types))}",
            "tags is an array of keywords and may be empty.",
            "move_trigger (for a move), scene_type, encounter_key and npc_name (for a stat_block) are strings or null.",
        ]
        body = [f"[{k}] heading: {' / '.join(path) if len(path) else '(no heading)'}\ntext: {text}" for k, (text, path) in enumerate(batch, 1)]
        return "\n\n".join(["\n".join(head), *body])

    def replies(self, batch: Sequence[tuple[str, Sequence[str]]]) -> list[dict[str, object]]:
        """Records of the first passages of a batch, as many as the model answered; none if anything fails."""
        try:
            reply = self.complete(self.system_prompt(), self.batch_prompt(batch), max(4096, 300 * len(batch)))
            return [parse_classification(x, self.content_types) for x in json.loads(extract_json_array(reply))[: len(batch)]]
        except Exception:  # noqa: BLE001  any failure of the service leaves the batch to the rules
            return []

    def apply(self, chunks: DataFrame) -> DataFrame:
        ruled = RuleClassifier().apply(chunks)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                frame = frame.copy()
                for c in FIELDS:
                    frame[c] = frame[c].astype(object)
                for lo in range(0, len(frame), self.batch_size):
                    rows = frame.iloc[lo : lo + self.batch_size]
                    for k, record in enumerate(self.replies(list(zip(rows["text"], rows["heading_path"], strict=True)))):
                        for c, v in record.items():
                            frame.iat[lo + k, frame.columns.get_loc(c)] = v
                yield frame

        return ruled.mapInPandas(run, ruled.schema)


@dataclass(frozen=True)
class CostEstimate:
    """What classifying would cost."""

    model: str
    n_chunks: int
    n_batches: int
    input_tokens: int
    output_tokens: int
    total_cost_usd: float


#: US dollars per million tokens, in and out, where a model's price is unknown.
FALLBACK_PRICES = (3.0, 15.0)
#: Output tokens that a chunk is reckoned at.
OUTPUT_TOKENS_PER_CHUNK = 50
PRICE_TIMEOUT_S = 10
_prices: dict[str, tuple[float, float]] | None = None


def reset_price_cache() -> None:
    """Forget fetched prices."""
    global _prices
    _prices = None


def prices_of(model: str, fetch: Callable[[float], Mapping[str, Mapping[str, object]]] | None = None) -> tuple[float, float]:
    """Prices per million tokens, from ``fetch(timeout)`` once a process: {model: {input_cost_per_token, output_cost_per_token}}; the fallback if that fails."""
    global _prices
    if _prices is None and fetch is not None:
        _prices = {}
        try:
            for name, x in fetch(PRICE_TIMEOUT_S).items():
                a, b = x.get("input_cost_per_token"), x.get("output_cost_per_token")
                if isinstance(a, int | float) and isinstance(b, int | float):
                    _prices[name] = (a * 1e6, b * 1e6)
        except Exception:  # noqa: BLE001  prices are a convenience
            pass
    return (_prices or {}).get(model, FALLBACK_PRICES)


def forecast_cost(classifier: ModelClassifier, chunks: DataFrame, fetch: Callable[[float], Mapping[str, Mapping[str, object]]] | None = None) -> CostEstimate:
    """Cost of classifying ``chunks``; ``classifier.count`` counts a prompt's tokens, on the executors, batch by batch.

    Chunks are batched within their partitions, as classifying batches them.
    """
    if classifier.count is None:
        raise ValueError("a token counter is required")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            starts = range(0, len(frame), classifier.batch_size)
            batches = [list(zip(frame["text"][lo : lo + classifier.batch_size], frame["heading_path"][lo : lo + classifier.batch_size], strict=True)) for lo in starts]
            yield pd.DataFrame({"chunks": [len(b) for b in batches], "tokens": [classifier.count(classifier.system_prompt(), classifier.batch_prompt(b)) for b in batches]})

    total = chunks.select("text", "heading_path").mapInPandas(run, "chunks long, tokens long").agg(F.sum("chunks").alias("n"), F.count("*").alias("b"), F.sum("tokens").alias("t")).first()
    n, tokens = total.n or 0, total.t or 0
    price_in, price_out = prices_of(classifier.model, fetch) if n else (0.0, 0.0)
    output = n * OUTPUT_TOKENS_PER_CHUNK
    return CostEstimate(classifier.model, n, total.b, tokens, output, math.fsum([tokens * price_in, output * price_out]) / 1e6)
