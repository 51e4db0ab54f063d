"""Models behind columns: embedders, rerankers, completers, in Arrow batches with retries; and texts for them.

A model is a plain object that workers can import or unpickle.  Each distinct input is sent once.  What fails after all retries gives null.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, questions: list[str], texts: list[str]) -> list[float]: ...


class Completer(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


def with_retries(call: Callable, *args, retries: int = 5, wait: float = 1.0, factor: float = 2.0):
    """call(*args), again after a wait that grows by `factor`; None after `retries` failures."""
    for i in range(retries):
        try:
            return call(*args)
        except Exception:
            if i + 1 < retries:
                time.sleep(wait * factor**i)
    return None


def mapped(df: DataFrame, columns: list[str], call: Callable, out: str, kind: str, batch: int = 64, **retry) -> DataFrame:
    """df with `out`: call(list of each column) over distinct inputs, `batch` rows at a time."""

    def run(parts):
        for part in parts:
            for a in range(0, part.num_rows, batch):
                rows = part.slice(a, batch)
                got = with_retries(call, *(rows.column(c).to_pylist() for c in columns), **retry)
                values = [None] * rows.num_rows if got is None else list(got)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(values, type_)], names=[*rows.schema.names, out])

    type_ = {"string": pa.string(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[kind]
    inputs = df.select(*columns).distinct()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields)
    done = inputs.mapInArrow(run, f"{schema}, `{out}` {kind}")
    keys = [df[c].eqNullSafe(done[c]) for c in columns]
    return df.join(done, keys, "left").select(*[df[c] for c in df.columns], done[out])


def embedded(df: DataFrame, text: str, model: Embedder, out: str = "vec", **how) -> DataFrame:
    return mapped(df, [text], model.embed, out, "array<double>", **how)


def completed(df: DataFrame, prompt: str, model: Completer, cache: DataFrame | None = None, out: str = "response", **how) -> tuple[DataFrame, DataFrame]:
    """df with the model's response, and the cache(key, response) with what it said newly; a prompt that the cache holds isn't sent."""
    keyed = df.withColumn("__key", F.md5(prompt))
    known = cache if cache is not None else df.sparkSession.createDataFrame([], "key string, response string")
    known = known.select(F.col("key").alias("__key"), F.col("response").alias("__known")).dropDuplicates(["__key"])
    fresh = mapped(keyed.join(known, "__key", "left_anti").select("__key", prompt).distinct(), [prompt], model.complete, "__new", "string", **how).where("__new is not null").select("__key", "__new")
    both = known.select("__key", F.col("__known").alias("__r")).unionByName(fresh.select("__key", F.col("__new").alias("__r")))
    return keyed.join(both, "__key", "left").withColumnRenamed("__r", out).drop("__key"), both.select(F.col("__key").alias("key"), F.col("__r").alias("response"))


def reranked(pairs: DataFrame, model: Reranker, n: int, **how) -> DataFrame:
    """Best n of each question by the model's score through a logistic curve, kept within 0..1; a question whose scoring fails has none."""
    from .vector_search import ranked

    scored = mapped(pairs, ["question", "text"], model.score, "__s", "double", **how)
    failed = scored.where("__s is null").select("q_id").distinct()
    value = F.least(F.greatest(1 / (1 + F.exp(-F.col("__s"))), F.lit(0.0)), F.lit(1.0))
    good = scored.join(failed, "q_id", "left_anti").withColumn("rerank_score", value).drop("__s")
    return ranked(good, "q_id", [F.desc("rerank_score"), F.col("chunk_id")], n)


def embed_absent(rows: DataFrame, key: list[str], text: Column, done: DataFrame, embed: Callable[[Column], Column]) -> DataFrame:
    """done(key, vec) with vectors of the rows it lacks: what was embedded before isn't embedded again."""
    new = rows.select(*key, text.alias("__t")).dropDuplicates(key).join(done.select(*key), key, "left_anti")
    return done.select(*key, "vec").unionByName(new.select(*key, embed(F.col("__t")).alias("vec")))


def rewritten(question: Column, rewrite: Column) -> Column:
    """A rewritten question if it has more than three characters, else the question."""
    x = F.trim(F.coalesce(rewrite, F.lit("")))
    return F.when(F.length(x) > 3, x).otherwise(question)


def prompt(template: str, **parts: Column) -> Column:
    """A template with {name} places as one column."""
    pieces, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        pieces += [F.lit(head), F.coalesce(parts[name].cast("string"), F.lit(""))]
    return F.concat(*pieces, F.lit(rest))


#: Asks of the seven kinds a run makes; the keys of the answers are what functions/parsing.py reads.
TEMPLATES = {
    "extract": 'List the entities of the text and how they relate, as JSON {open}"entities":[{open}"id","type","desc"{close}],"relations":[{open}"src","tgt","rel"{close}]{close}.\n\nText:\n{text}',
    "question_entities": 'List what the question is about, as JSON {open}"entities":[...],"relations":[...]{close}.\n\nQuestion: {question}',
    "answer": 'Answer from the passages alone, as JSON {open}"final_answer":"..."{close}; say "I don\'t know." if they don\'t tell.\n\n{context}\n\nQuestion: {question}',
    "first_step": 'Does the question need several steps? Reply as JSON {open}"need_multihop":true|false,"subquestion":"..."{close}.\n\nQuestion: {question}',
    "next_step": 'Steps so far:\n{steps}\n\nReply as JSON {open}"is_final":true|false,"subquestion":"...","final_answer":"..."{close}.\n\nQuestion: {question}',
    "rewrite": "Write the question so that a search finds more, in one line.\n\nQuestion: {question}",
    "judge": 'Is the answer right? Reply as JSON {open}"correct":true|false{close}.\n\nQuestion: {question}\nTruth: {truth}\nAnswer: {answer}',
}


def ask(kind: str, **parts: Column) -> Column:
    return prompt(TEMPLATES[kind], open=F.lit("{"), close=F.lit("}"), **parts)
