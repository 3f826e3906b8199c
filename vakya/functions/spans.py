"""Overlap of a passage with the best span of a text."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def best_span(words: list[str], gold: list[str]) -> tuple[float, int, int]:
    """(F1, start, stop) of the span of half to one and a half times the passage's words that shares most with it, repeats counted; the first and shortest of equal ones. A shorter text is one span.

    The best span of a start grows word by word, so a text costs its words times one and a half passages.
    """
    n, m = len(gold), len(words)
    if not n or not m:
        return 0.0, 0, 0
    least, most = min(m, (n + 1) // 2), max(1, n + n // 2)
    need, best = Counter(gold), (0.0, 0, 0)
    for start in range(m - least + 1):
        have: dict[str, int] = {}
        shared = 0
        for stop in range(start, min(m, start + most)):
            w = words[stop]
            if w in need:
                have[w] = have.get(w, 0) + 1
                shared += have[w] <= need[w]
            size = stop - start + 1
            if size >= least and 2 * shared / (size + n) > best[0]:
                best = (2 * shared / (size + n), start, stop + 1)
    return best


@F.pandas_udf(T.StructType([T.StructField("f1", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
def best_spans(words: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """``best_span`` of lists of words; null counts as empty."""
    rows = [best_span([] if a is None else list(a), [] if b is None else list(b)) for a, b in zip(words, gold, strict=True)]
    return pd.DataFrame(rows, columns=["f1", "start", "stop"])
