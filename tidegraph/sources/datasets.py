"""Question sets and corpora in the shapes that are published as JSON.

A loader gives questions(q_id, question, answers, text).  Names are looked up by substring, in registry order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MULTIHOP = "question string, answer string, type string, context string"
TWO_PHASE = "specific_question string, ground_truth array<string>, phase_1_data array<string>, phase_2_data array<string>"
NOISE = "query string, answer string, positive string, negative string, positive_wrong string"


def _numbered(df: DataFrame, num: int | None) -> DataFrame:
    """q_id by the order of the files; the first num.

    Rows are numbered inside their partition, and a sum over the partitions (a row for each) gives where each begins.
    """
    at = df.withColumn("__m", F.monotonically_increasing_id()).withColumn("__p", F.shiftright("__m", 33))
    size = at.groupBy("__p").agg(F.count("*").alias("n"))
    base = size.select("__p", (F.sum("n").over(Window.orderBy("__p")) - F.col("n")).alias("__base"))
    out = at.join(base, "__p").withColumn("q_id", F.col("__base") + F.col("__m") - F.shiftleft("__p", 33)).drop("__m", "__p", "__base")
    return out.where(F.col("q_id") < num) if num else out


def _context(c: str) -> F.Column:
    """[[title, sentences]] to "title: body" lines, one for each title; sentences may be a list or a string."""
    pairs = F.from_json(c, "array<array<string>>")
    body = lambda p: F.coalesce(F.array_join(F.transform(F.from_json(F.get(p, F.lit(1)), "array<string>"), lambda s: F.trim(s)), " "), F.get(p, F.lit(1)), F.lit(""))
    title = lambda p: F.coalesce(F.get(p, F.lit(0)), F.lit(""))
    return F.transform(pairs, lambda p: F.struct(title(p).alias("title"), F.trim(body(p)).alias("body")))


def read_multihop(spark: SparkSession, path: str, num: int | None = None, q_type: str | None = None) -> DataFrame:
    rows = spark.read.schema(MULTIHOP).option("multiLine", True).json(path)
    rows = rows if q_type is None else rows.where(F.col("type") == q_type)
    parts = F.transform(_context("context"), lambda p: F.when(p["title"] == "", p["body"]).when(p["body"] == "", p["title"]).otherwise(F.concat(p["title"], F.lit(": "), p["body"])))
    return _numbered(rows, num).select("q_id", "question", F.array("answer").alias("answers"), F.array_join(F.filter(parts, lambda t: t != ""), "\n\n").alias("text"))


def read_corpus(spark: SparkSession, path: str, num: int | None = None) -> DataFrame:
    """(title, body): contexts of the first num questions, the first body of each title, no empty ones."""
    rows = _numbered(spark.read.schema(MULTIHOP).option("multiLine", True).json(path), num)
    return first_by_title(rows.select("q_id", F.posexplode(_context("context")).alias("pos", "c")).select("q_id", "pos", "c.title", "c.body"))


def first_by_title(rows: DataFrame) -> DataFrame:
    """rows(q_id, pos, title, body): the first body of each title by question and place."""
    w = Window.partitionBy("title").orderBy("q_id", "pos")
    return rows.where(F.coalesce("body", F.lit("")) != "").withColumn("r", F.row_number().over(w)).where("r = 1").select("title", "body")


def read_two_phase(spark: SparkSession, path: str, limit: int | None = None, update: bool = False) -> DataFrame:
    rows = _numbered(spark.read.schema(TWO_PHASE).option("multiLine", True).json(path), limit)
    return rows.select("q_id", F.col("specific_question").alias("question"), F.col("ground_truth").alias("answers"), F.array_join("phase_2_data" if update else "phase_1_data", "\n\n").alias("text"))


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects one after another, each on a line or over several; split where a line ends outside of all braces and brackets of texts."""
    lines = spark.read.text(path, wholetext=True)
    objects = F.filter(F.split(F.concat(F.lit("\n"), "value"), r"(?<=[}])[ \t]*\r?\n(?=\s*[{])"), lambda t: F.trim(t) != "")
    return lines.select(F.posexplode(objects).alias("__i", "__t")).select(F.from_json(F.trim("__t"), schema).alias("x")).select("x.*")


def read_noise(spark: SparkSession, path: str, variant: str = "", num: int | None = None, pack: int | None = None) -> DataFrame:
    """Question sets with positive and negative passages.

    variant _fact: both kinds; _int: nested lists of positives joined by blanks, and with `pack` packed to that many words; _refine: the
    passages of all questions in one list, one a row, so they don't belong to the row's question; else positives.
    """
    rows = _numbered(read_objects(spark, path, NOISE), num)
    flat = lambda c: F.transform(F.from_json(c, "array<string>"), lambda x: F.coalesce(F.array_join(F.from_json(x, "array<string>"), " "), x))
    texts = F.concat(flat("positive"), flat("negative")) if variant == "_fact" else flat("positive")
    base = rows.select("q_id", F.col("query").alias("question"), F.coalesce(F.from_json("answer", "array<string>"), F.array("answer")).alias("answers"), texts.alias("texts"))
    if variant == "_refine":
        every = rows.select("q_id", F.posexplode(F.concat(flat("positive"), flat("negative"))).alias("pos", "text"))
        order = every.groupBy("q_id").agg(F.count("*").alias("n"))
        start = order.select("q_id", (F.sum("n").over(Window.orderBy("q_id")) - F.col("n")).alias("at"))
        passages = every.join(start, "q_id").select((F.col("at") + F.col("pos")).alias("q_id"), "text")
        return base.select("q_id", "question", "answers").join(passages, "q_id", "full_outer")
    if variant == "_int" and pack:
        from .chunking import packed

        one = base.select("q_id", F.posexplode("texts").alias("pos", "text"))
        joined = packed(one, "q_id", "pos", pack).groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pack", "text"))), lambda s: s["text"]), "\n\n").alias("text"))
        return base.select("q_id", "question", "answers").join(joined, "q_id", "left")
    return base.select("q_id", "question", "answers", F.array_join("texts", "\n\n").alias("text"))


def noise_counts(rate: float, total: int, n_positive: Column, n_negative: Column) -> tuple[Column, Column]:
    """(positives, negatives) of a mix of `total` passages, ceil(total * rate) of them negative, as far as there are; what lacks comes from the other kind."""
    want = F.lit(total if rate == 1 else -(-int(round(total * rate * 1_000_000)) // 1_000_000))
    few = want > n_negative
    negative = F.when(F.lit(rate == 1), F.lit(total)).when(few, n_negative).when(F.lit(total) - want > n_positive, F.lit(total) - n_positive).otherwise(want)
    return F.lit(total) - negative, negative


def noise_mix(passages: DataFrame, rate: float, total: int, seed: str = "noise", variant: str = "", correct_rate: float = 0.0) -> DataFrame:
    """passages(q_id, kind positive|negative|positive_wrong, pos, text): a mix of `total`, (q_id, kind, text).

    Default: the first positives and negatives by noise_counts.  _int: pos is the round of a nested positive list, rounds are taken in turn up to
    the positives wanted, one of each list at least.  _fact: a seeded choice of positions gives wrong passages, ceil(total * correct_rate) others right ones.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.col("q_id").cast("string"), F.col("pos").cast("string"), F.lit("")))
    n_neg = -(-int(round(total * rate * 1_000_000)) // 1_000_000)
    numbered = passages.withColumn("r", F.row_number().over(Window.partitionBy("q_id", "kind").orderBy("pos", "text")))
    if variant == "_fact":
        n_right = -(-int(round(total * correct_rate * 1_000_000)) // 1_000_000)
        n_wrong = total - n_neg - n_right
        order = F.row_number().over(Window.partitionBy("q_id", "kind").orderBy(hashed, "pos"))
        p = numbered.withColumn("o", order)
        keep = ((F.col("kind") == "positive_wrong") & (F.col("o") <= n_wrong)) | ((F.col("kind") == "positive") & (F.col("o") > n_wrong) & (F.col("o") <= n_wrong + n_right)) | ((F.col("kind") == "negative") & (F.col("r") <= n_neg))
        return p.where(keep).select("q_id", "kind", "text")
    w = Window.partitionBy("q_id")
    counted = numbered.where(F.col("kind") != "positive_wrong").withColumns({"np": F.count_if(F.col("kind") == "positive").over(w), "nn": F.count_if(F.col("kind") == "negative").over(w), "first": F.count_if((F.col("kind") == "positive") & (F.col("pos") == 0)).over(w)})
    if variant == "_int":
        taken = F.least(F.col("np"), F.greatest(F.col("first"), F.lit(total - n_neg)))
        want = F.when(F.col("kind") == "positive", taken).otherwise(F.greatest(F.lit(total) - taken, F.lit(0)))
    else:
        pos, neg = noise_counts(rate, total, F.col("np"), F.col("nn"))
        want = F.when(F.col("kind") == "positive", pos).otherwise(neg)
    return counted.where(F.col("r") <= want).select("q_id", "kind", "text")


def sample_rows(df: DataFrame, key: str, num: int, seed: int = 2000) -> DataFrame:
    """num rows in the order of a seeded hash; all of them if there are no more."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(num)


REGISTRY: list[tuple[str, Callable]] = [("hotpot", read_multihop), ("2wiki", read_multihop), ("specific", read_two_phase), ("rgb", read_noise), ("en", read_noise)]


def _resolved(name: str) -> Callable | None:
    return next((f for key, f in REGISTRY if key in name.lower()), None)


def load(spark: SparkSession, name: str, path: str, start: int = 0, end: int | None = None, **how) -> DataFrame:
    """Questions start..end of the data set whose registered name is part of `name`; each has to have answers.

    Texts are cut along where each belongs to a question; where texts and questions differ in number, all texts stay.
    """
    reader = _resolved(name)
    if reader is None:
        raise ValueError(f"no loader for {name}")
    rows = reader(spark, path, **how)
    if not rows.where(F.col("question").isNotNull() & F.col("answers").isNull()).isEmpty():
        raise ValueError(f"{name}: questions without answers")
    inside = (F.col("q_id") >= start) & (F.lit(True) if end is None else F.col("q_id") < end)
    if rows.where(F.col("question").isNull()).isEmpty():
        return rows.where(inside)
    return rows.withColumns({c: F.when(inside, F.col(c)) for c in ("question", "answers")})


#: Data sets that have a corpus apart from their questions.
CORPORA: list[tuple[str, Callable]] = [("hotpot", read_corpus), ("2wiki", read_corpus)]


def load_corpus(spark: SparkSession, name: str, path: str, limit: int = 300) -> DataFrame:
    """(title, body) of the first `limit` questions' contexts; without a corpus reader the questions' texts stand in."""
    reader = next((f for key, f in CORPORA if key in name.lower()), None)
    if reader is not None:
        return reader(spark, path, limit)
    return load(spark, name, path, 0, limit).where("text is not null").select(F.col("q_id").cast("string").alias("title"), F.col("text").alias("body"))


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """A JSON array, or with lines one object a line."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Plain "key: value" settings of a YAML file, nested keys joined by dots; comments and blank lines are passed over."""
    out, stack = {}, []
    for line in (r["value"] for r in spark.read.text(path).collect()):  # a settings file
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#") or ":" not in bare:
            continue
        depth = len(bare) - len(bare.lstrip())
        key, _, value = bare.strip().partition(":")
        stack = [(d, k) for d, k in stack if d < depth]
        if value.strip():
            out[".".join([*(k for _, k in stack), key])] = value.strip().strip("\"'")
        else:
            stack.append((depth, key))
    return out


def unfinished(questions: DataFrame, done: DataFrame) -> DataFrame:
    return questions.join(done.select("question").distinct(), "question", "left_anti")


def log_numbers(lines: DataFrame, marker: str, num: int = 1, start: str | None = None) -> DataFrame:
    """(line, numbers): of log lines(line, value) that hold the marker, the first num numbers from it on, or from `start` on."""
    at = F.locate(start or marker, F.col("value"))
    rest = F.expr("substring(value, __at)")
    found = lines.where(F.contains("value", F.lit(marker))).withColumn("__at", F.greatest(at, F.lit(1)))
    return found.select("line", F.slice(F.transform(F.regexp_extract_all(rest, F.lit(r"(\d+\.?\d*)"), F.lit(1)), lambda x: x.cast("double")), 1, num).alias("numbers"))


def log_texts(lines: DataFrame, start: str, end: str | None = None) -> DataFrame:
    """(line, text): what stands between two marks of a log line that holds the first; without an end, the rest of the line."""
    rest = F.expr("substring(value, __at)")
    found = lines.where(F.contains("value", F.lit(start))).withColumn("__at", F.locate(start, F.col("value")) + len(start))
    return found.select("line", (F.substring_index(rest, end, 1) if end else rest).alias("text"))
