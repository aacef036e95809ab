"""Exact token counts by a vocabulary file, where the tokenizers library is installed; estimates are in scalars."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .scalars import col, est_ratio


@functools.lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def exact(text: str | Column, path: str) -> Column:
    """Tokens of a text by the vocabulary at path (on every worker), without special tokens; null for null."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        by = _tokenizer(path)
        found = iter(by.encode_batch([t for t in texts if t is not None], add_special_tokens=False))
        return pd.Series([None if t is None else len(next(found).ids) for t in texts], dtype="Int64")

    return count(col(text))


def count(text: str | Column, family: str = "auto", path: str | None = None) -> Column:
    """Exact if a vocabulary is given and the library is there, else the family's estimate."""
    if path is not None:
        try:
            import tokenizers  # noqa: F401

            return exact(text, path)
        except ImportError:  # the library is optional
            pass
    return est_ratio(text, family)
