"""Answers from contexts, and the multi-step loop over all open questions at once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .vector_search import ranked
from .walk import cut

UNKNOWN = "I don't know."


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(c, r"[^A-Za-z0-9\s]", " ")), r"\s+"), lambda t: t != ""))


def best_sentence(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(q_id, answer, overlap): of context(q_id, text, rank) the sentence that shares most words with the question.

    Ties go to the better rank, then to the earlier sentence; without a shared word the answer is unknown.
    """
    parts = context.select("q_id", "rank", F.posexplode(F.split("text", r"[.\n]")).alias("pos", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    scored = questions.select("q_id", words(F.col("question")).alias("qw")).join(parts, "q_id").withColumn("overlap", F.size(F.array_intersect("qw", words(F.col("s")))).cast("bigint"))
    best = ranked(scored, "q_id", [F.desc("overlap"), F.col("rank"), F.col("pos")], 1, rank="r")
    found = best.where("overlap > 0").select("q_id", F.col("s").alias("answer"), "overlap")
    return questions.select("q_id").join(found, "q_id", "left").select("q_id", F.coalesce("answer", F.lit(UNKNOWN)).alias("answer"), F.coalesce("overlap", F.lit(0)).alias("overlap"))


def next_question(question: Column, answer: Column) -> Column:
    """A rule in place of a planner: ask for the first capitalised word of the answer that the question lacks; null if there is none."""
    names = F.filter(F.regexp_extract_all(answer, F.lit(r"\b([A-Z][A-Za-z]{2,})"), F.lit(1)), lambda n: ~F.contains(F.lower(question), F.lower(n)))
    return F.when(F.size(names) > 0, F.concat(F.lit("What is "), F.get(names, F.lit(0)), F.lit("?")))


def agentic(questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame], max_steps: int = 3) -> DataFrame:
    """(q_id, step, question, answer): rounds of retrieve, answer and plan.

    A question ends with an answer that says it isn't known, without a next question, with one it has asked before, or
    after max_steps.  retrieve(q_id, question) gives context(q_id, text, rank).
    """
    active = questions.select("q_id", "question", F.array(text.question_form(F.col("question"))).alias("asked"))
    trace = []
    for step in range(1, max_steps + 1):
        got = cut(active.join(best_sentence(active, retrieve(active.select("q_id", "question"))).select("q_id", "answer"), "q_id"))
        trace.append(got.select("q_id", F.lit(step).cast("bigint").alias("step"), "question", "answer"))
        onward = got.where(~text.is_stop(F.col("answer"))).withColumn("next", next_question(F.col("question"), F.col("answer")))
        onward = onward.where(F.col("next").isNotNull() & ~F.array_contains("asked", text.question_form(F.col("next"))))
        active = onward.select("q_id", F.col("next").alias("question"), F.concat("asked", F.array(text.question_form(F.col("next")))).alias("asked"))
        if step == max_steps or active.isEmpty():
            break
    return reduce(DataFrame.unionAll, trace)


def agentic_chunks(trace: DataFrame) -> DataFrame:
    """(q_id, chunks): the distinct chunks of all steps of trace(q_id, step, chunks)."""
    return trace.groupBy("q_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("chunks")))).alias("chunks"))


def cached_answers(questions: DataFrame, context: DataFrame, cache: DataFrame, answerer: Callable[[DataFrame, DataFrame], DataFrame] = best_sentence) -> tuple[DataFrame, DataFrame]:
    """Answers (q_id, answer) and the cache(key, answer) with the new ones; a question with the same chunks, in any order, is answered once.

    context(q_id, chunk_id, text, rank).
    """
    chunks = context.groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_set("chunk_id")), "|").alias("c"))
    keyed = questions.join(chunks, "q_id", "left").withColumn("key", F.md5(F.concat_ws("||", "question", F.coalesce("c", F.lit(""))))).drop("c")
    known = keyed.join(cache.select("key", "answer").dropDuplicates(["key"]), "key").select("q_id", "key", "answer")
    missing = keyed.join(cache.select("key"), "key", "left_anti")
    once = missing.groupBy("key").agg(F.min_by(F.struct("q_id", "question"), "q_id").alias("q")).select("key", "q.*")
    new = answerer(once.select("q_id", "question"), context).join(once.select("q_id", "key"), "q_id").select("key", "answer")
    return known.select("q_id", "answer").unionByName(missing.join(new, "key").select("q_id", "answer")), cache.select("key", "answer").unionByName(new)
