"""JSON and maps: canonical text, digests, merges, search by key."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """JSON text with sorted keys and without white space; null if it isn't JSON. NaN and Infinity aren't JSON."""
    return F.to_json(F.try_parse_json(F.when(~text.rlike(r"(?<![\w\"])-?(?:NaN|Infinity)(?![\w\"])"), text)))


def json_digest(text: Column) -> Column:
    """sha256 of the canonical text."""
    return F.sha2(canonical_json(text), 256)


def json_bytes(value: Column) -> Column:
    """Bytes of a structure as JSON text in UTF-8, nulls included."""
    return F.octet_length(F.to_json(value, {"ignoreNullFields": "false"}))


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; where both have a key the right value counts, even a null one."""
    return F.map_zip_with(left, right, lambda k, x, y: F.when(F.map_contains_key(right, k), y).otherwise(x))


def updated(values: Column, key: Column, value: Column) -> Column:
    """A map with one key set."""
    return merged(values, F.create_map(key, value))


def found_under(text: Column, names: list[str]) -> Column:
    """The first text under one of the names, depth first, in JSON of any depth; null if there is none or the JSON is broken."""

    def search(node: object) -> str | None:
        if isinstance(node, dict):
            for name in names:
                if isinstance(node.get(name), str) and node[name]:
                    return node[name]
        for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else []:
            if (found := search(child)) is not None:
                return found
        return None

    def one(raw: str | None) -> str | None:
        try:
            return search(json.loads(raw)) if raw is not None else None
        except ValueError:
            return None

    @F.pandas_udf("string")
    def each(raw: pd.Series) -> pd.Series:
        return raw.map(one)

    return each(text)
