"""Sizes in tokens of a public byte-level vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rank file of a byte-level BPE for many languages; a parameter of every operator.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count(text: str, path: str = VOCABULARY) -> int:
    return len(encoding(path).encode_ordinary(text))


def counted(frame: DataFrame, text_column: str, path: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``tokens`` (0 for a null text)."""
    keep = keep or []
    types = dict(frame.dtypes)
    names = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(path)
        for batch in batches:
            sizes = [len(coder.encode_ordinary(t)) if t else 0 for t in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(len(names))), pa.array(np.array(sizes, np.int64))], names=[*names, "tokens"])

    schema = ", ".join([f"{n} {types[k]}" for n, k in zip(names, keep, strict=True)] + ["tokens long"])
    out = frame.select(*(F.col(k).alias(n) for k, n in zip(keep, names, strict=True)), F.col(text_column).alias("_text")).mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(k) for k, n in zip(keep, names, strict=True)), "tokens")
