"""Vectorised functions that Spark has no built-in for: Unicode folding and similarity."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return text.map(lambda s: None if s is None else s if s.isascii() else unicodedata.normalize("NFKC", s))


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Unicode compatibility decomposition."""
    return text.map(lambda s: None if s is None else s if s.isascii() else unicodedata.normalize("NFKD", s))


def sequence_ratio(a: str, b: str) -> float:
    """Share of characters in matching blocks, from ``a`` to ``b`` (not symmetric)."""
    return difflib.SequenceMatcher(None, a or "", b or "").ratio()


def token_set_score(a: str, b: str) -> float:
    """Best ratio (0 to 100) among the common words and either side's words in order."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 100.0
    left = " ".join(filter(None, [common, " ".join(sorted(x - y))]))
    right = " ".join(filter(None, [common, " ".join(sorted(y - x))]))
    pairs = [(left, right)] + ([(common, left), (common, right)] if common else [])

    def indel(s: str, t: str) -> float:
        row = [0] * (len(t) + 1)
        for c in s:
            last = 0
            for j, d in enumerate(t):
                last, row[j + 1] = row[j + 1], last + 1 if c == d else max(row[j], row[j + 1])
        return 100.0 * 2 * row[-1] / (len(s) + len(t))

    return max(indel(s, t) for s, t in pairs)


@F.pandas_udf(DoubleType())
def sm_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sequence_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_score(x, y) for x, y in zip(a, b)], dtype="float64")
