"""Splitting texts into chunks, and packing small texts together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SIZE, OVERLAP = 800, 100
SEPARATORS = ("\n\n", "\n", "。", ".", " ", "")  # fixed values, tried in this order


def fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, doc_id, seq, text): strides of size - overlap characters."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / F.lit(step)).cast("int"))
    return docs.where(F.length("text") > 0).select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("seq")).select(T.chunk_id(F.col("doc_id"), F.col("seq")).alias("chunk_id"), "doc_id", F.col("seq").cast("bigint").alias("seq"), F.substring("text", F.col("seq") * step + 1, F.lit(size)).alias("text"))


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces between the first separator that occurs, re-joined up to `size`; longer pieces are split by the next separators.

    Neighbouring chunks share whole pieces of up to `overlap` characters.  A separator stays at the head of the piece after it.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[level], separators[level + 1 :]
    if mark:
        cuts = text.split(mark)
        parts = [p for p in [cuts[0], *(mark + c for c in cuts[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    held: list[str] = []
    width = 0

    def emit() -> None:
        whole = "".join(held).strip()
        if whole:
            out.append(whole)

    for part in parts:
        if len(part) > size and finer:
            emit()
            held, width = [], 0
            out.extend(split_text(part, size, overlap, finer))
            continue
        if width + len(part) > size and held:
            emit()
            while held and (width > overlap or width + len(part) > size):
                width -= len(held.pop(0))
        held.append(part)
        width += len(part)
    emit()
    return out


def recursive(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, doc_id, seq, text) by split_text; Arrow batches of texts, as the recursion has no expression form."""

    @F.pandas_udf("array<string>")
    def pieces(x: pd.Series) -> pd.Series:
        return x.map(lambda t: split_text(t or "", size, overlap))

    return docs.select("doc_id", F.posexplode(pieces("text")).alias("seq", "text")).select(T.chunk_id(F.col("doc_id"), F.col("seq")).alias("chunk_id"), "doc_id", F.col("seq").cast("bigint").alias("seq"), "text")


def packed(rows: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """(group, pack, text): texts in order are joined until their words exceed `limit`; the pack that does is emitted whole."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t"), F.size(F.filter(F.split("text", r"\s+"), lambda w: w != "")).alias("n"))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n"))

    def step(s, x):
        now, n = F.when(s["now"] == "", x["t"]).otherwise(F.concat(s["now"], F.lit(" "), x["t"])), s["n"] + x["n"]
        return F.struct(F.when(n > limit, F.concat(s["done"], F.array(now))).otherwise(s["done"]).alias("done"), F.when(n > limit, "").otherwise(now).alias("now"), F.when(n > limit, 0).otherwise(n).alias("n"))

    folded = rows.groupBy(group).agg(F.aggregate(items, start, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"])))).alias("packs"))
    return folded.select(group, F.posexplode("packs").alias("pack", "text")).select(group, F.col("pack").cast("bigint").alias("pack"), "text")
