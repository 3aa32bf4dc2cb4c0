"""Calls of model providers: retries, a check of the answer's shape, and batches on the executors.

A provider is any function from a JSON-like payload to a JSON-like answer.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.functions.text import headline
from voxmill.operators.ingest import dedupe_last_wins
from voxmill.session import ship

RETRIES, BATCH = 3, 100
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "number": (int, float), "integer": int}


class ProviderError(RuntimeError):
    """A model's answer is missing or has another shape."""


def fits(value: Any, schema: dict) -> bool:
    """Whether a value has the shape of a JSON schema's type, required, properties and items."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or (kind in ("number", "integer") and isinstance(value, bool))):
        return False
    if isinstance(value, dict):
        return all(k in value for k in schema.get("required", ())) and all(fits(value[k], s) for k, s in schema.get("properties", {}).items() if k in value)
    return not isinstance(value, list) or all(fits(x, schema.get("items", {})) for x in value)


def call(provider: Callable[[Any], Any], payload: Any, schema: dict | None = None, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> Any:
    """The provider's answer; a failed call or an answer of another shape is tried again after 1, 2, 4, ... seconds. ProviderError after the last."""
    for attempt in range(retries):
        try:
            found = provider(payload)
            if schema is not None and not fits(found, schema):
                raise ProviderError("the answer has another shape")
            return found
        except Exception as e:  # whatever the provider's client raises
            if attempt == retries - 1:
                raise ProviderError(f"failed after {retries} attempts: {e}") from e
            wait(2.0**attempt)
    raise ProviderError("no attempts")


def embed_texts(provider: Callable[[list[str]], list[list[float]]], texts: list[str], size: int = BATCH, retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """One vector per text, in order, asked for in batches of `size`. ProviderError if a batch fails or comes back with another number of vectors."""
    out: list[list[float]] = []
    for at in range(0, len(texts), size):
        part = texts[at : at + size]

        def complete(asked: list[str]) -> list[list[float]]:
            found = provider(asked)
            if len(found) != len(asked):
                raise ProviderError(f"{len(found)} vectors for {len(asked)} texts")
            return found

        out += call(complete, part, {"type": "array", "items": {"type": "array", "items": {"type": "number"}}}, retries, wait)
    return out


def embed_reviews(df: DataFrame, provider: Callable[[list[str]], list[list[float]]], size: int = BATCH, retries: int = RETRIES) -> DataFrame:
    """ord, id, vec of df(ord, id, title, text): of rows that share an id the last, at the place of the first. A batch that fails fails the job."""
    ship(df.sparkSession)
    rows = dedupe_last_wins(df.select("ord", "id", headline(F.col("title"), F.col("text")).alias("text")))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"ord": part["ord"], "id": part["id"], "vec": embed_texts(provider, part["text"].tolist(), size, retries)})

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInPandas(run, f"ord {kind['ord']}, id {kind['id']}, vec array<double>")
