"""Answer metrics as expressions; ROUGE-L's subsequences go through one Arrow function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .text import answer_form, containment_form


def exact_match(predicted: Column, truth: Column) -> Column:
    return (answer_form(predicted) == answer_form(truth)).cast("int")


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence; rows of the table are bits of one integer."""
    places: dict = {}
    for i, w in enumerate(b):
        places[w] = places.get(w, 0) | (1 << i)
    row, full = (1 << len(b)) - 1, (1 << len(b)) - 1
    for w in a:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(LongType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of two arrays of words; Arrow batches, since the table is quadratic and copies an array for each cell as an expression."""
    return pd.Series([0 if x is None or y is None else lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def rouge_l(predicted: Column, truth: Column, alpha: float = 0.0) -> Column:
    """ROUGE-L over blank-separated words; alpha weighs precision against recall (0: recall alone)."""
    p, t = (F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "") for x in (predicted, truth))
    n = lcs_length(p, t).cast("double")
    precision, recall = n / F.greatest(F.size(p), F.lit(1)), n / F.greatest(F.size(t), F.lit(1))
    bottom = alpha * recall + (1 - alpha) * precision
    return F.when(n == 0, F.lit(0.0)).otherwise(precision * recall / bottom)


def contains_all(predicted: Column, truths: Column) -> Column:
    """1 for each inner list of alternatives of which one is in the prediction, else 0; both sides in containment_form."""
    return F.transform(truths, lambda alts: F.exists(alts, lambda a: F.contains(containment_form(predicted), containment_form(a))).cast("int"))


def accurate(flags: Column) -> Column:
    """Counted when there is a 1 and no 0."""
    return F.array_contains(flags, 1) & ~F.array_contains(flags, 0)
