"""Byte-exact JSON forms and their hashes (sorted keys, fixed separators)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def canonical_dump(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def sha256_json(value: object) -> str:
    return hashlib.sha256(canonical_dump(value).encode("utf-8")).hexdigest()


def template_sha256(templates: dict[str, str], names: list[str]) -> str:
    return sha256_json({n: templates[n] for n in names})


@F.pandas_udf(StringType())
def canonical_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A JSON text with sorted keys and compact separators."""
    for part in texts:
        yield part.map(lambda t: None if t is None else canonical_dump(json.loads(t)))


@F.pandas_udf(StringType())
def spaced_json(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A JSON text with sorted keys and the default separators, for comparing records."""
    for part in texts:
        yield part.map(lambda t: None if t is None else json.dumps(json.loads(t), sort_keys=True, default=str))


def json_sha256(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)
