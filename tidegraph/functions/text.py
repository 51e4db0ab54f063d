"""Text scalars: names, answers, questions, ids, escaping, templates."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Forms of companies, honorifics and phrases that the results depend on.
COMPANY_FORMS = "inc|corp|co|ltd|llc|group|foundation|incorporated|corporation|limited"
HONORIFICS = ("dr", "mr", "mrs", "ms", "prof", "sir", "madam")
UNKNOWN_PHRASES = ("i don't know", "cannot answer", "not enough information")
STOP_PHRASES = ("unknown", "i don't know", "not found")
MARKS_AT_ENDS = r"^[.,:;!?()\[\]{}\"]+|[.,:;!?()\[\]{}\"]+$"
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "y", "1"), ("false", "no", "n", "0")


def stripped(c: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_name(c: Column) -> Column:
    """Lower case without company forms, punctuation and doubled blanks; a form takes the blanks after it along."""
    x = F.regexp_replace(F.lower(F.trim(c)), rf"[,.\s]+\b({COMPANY_FORMS})\b[,.\s]*", "")
    x = F.regexp_replace(F.regexp_replace(x, r"[,.\s]+$", ""), r"[^a-z0-9\s]", " ")
    return collapsed(x)


def name_tokens(c: Column) -> Column:
    """Words of the normalised name, without honorifics and single characters."""
    return F.filter(F.split(normalize_name(c), " "), lambda t: (F.length(t) > 1) & ~t.isin(*HONORIFICS))


def normalize_type(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 where either has none."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / either)


def desc_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalize_name(F.coalesce(c, F.lit(""))), " "), lambda t: t != ""))


def desc_similarity(a: Column, b: Column, cosine: Column, low: float = 0.15, high: float = 0.65) -> Column:
    """Jaccard below `low`; half of it plus a half above `high`; half of it plus half the cosine between. 0 if either is empty."""
    j = jaccard(desc_tokens(a), desc_tokens(b))
    mixed = F.when(j < low, j).when(j > high, 0.5 * j + 0.5).when(cosine.isNull(), j).otherwise(0.5 * j + 0.5 * cosine)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0)).otherwise(mixed)


def subsequence(short: Column, long: Column) -> Column:
    """Every token of `short` occurs in `long` in this order."""
    n = F.aggregate(long, F.lit(0), lambda i, t: F.when((i < F.size(short)) & (F.get(short, i) == t), i + 1).otherwise(i))
    return n == F.size(short)


def alias_by_rules(a: Column, b: Column) -> Column:
    """Alias of two token arrays, of which the one that is shorter in characters may stand for the other.

    Equal; the initials; as many tokens, each a prefix; a single token that is the last, or any of three characters or
    more; tokens in the same order.  The edit ratio is apart, see edit_ratio.
    """
    joined_a, joined_b = F.array_join(a, " "), F.array_join(b, " ")
    a_short = F.length(joined_a) < F.length(joined_b)
    s, g = F.when(a_short, a).otherwise(b), F.when(a_short, b).otherwise(a)
    initials = F.array_join(F.transform(g, lambda t: F.substring(t, 1, 1)), "")
    prefixes = (F.size(s) == F.size(g)) & F.forall(F.zip_with(s, g, lambda x, y: F.startswith(y, x)), lambda ok: ok)
    only = F.get(s, F.lit(0))
    single = (F.size(s) == 1) & (F.size(g) >= 2) & ((F.element_at(g, -1) == only) | ((F.length(only) >= 3) & F.array_contains(g, only)))
    ordered = (F.size(s) < F.size(g)) & subsequence(s, g)
    some = (F.size(s) > 0) & (F.size(g) > 0)
    return F.coalesce(some & ((joined_a == joined_b) | (F.array_join(s, " ") == initials) | prefixes | single | ordered), F.lit(False))


@lru_cache(1 << 16)
def _ratio(x: str, y: str) -> float:
    return SequenceMatcher(None, x, y).ratio()


@F.pandas_udf(DoubleType())
def edit_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matched characters over all of them, twice (difflib); 0 where either is null. Arrow batches: no expression computes it."""
    return pd.Series([0.0 if not x or not y else _ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def answer_form(c: Column) -> Column:
    """For exact match: lower case, articles dropped, all but letters, digits and _ of any script to blanks; a null is empty."""
    x = F.lower(F.coalesce(c, F.lit("")))
    for _ in range(2):  # neighbouring articles share the blank between them
        x = F.regexp_replace(x, r"(^|[^\p{L}\p{N}_])(?:a|an|the)($|[^\p{L}\p{N}_])", "$1 $2")
    return collapsed(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]", " "))


def containment_form(c: Column) -> Column:
    """For containment: quotes of any place dropped, hyphens and clause marks to blanks, closing marks dropped."""
    x = F.regexp_replace(stripped(F.lower(c)), "[\"'`]", "")
    x = F.regexp_replace(F.regexp_replace(x, "-", " "), "[.,，。;；:：]", " ")
    return stripped(F.regexp_replace(F.regexp_replace(x, r"[!?！？]+\z", ""), r"\s+", " "))


def is_unknown(c: Column) -> Column:
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (x == "") | F.reduce(F.array(*[F.contains(x, F.lit(p)) for p in UNKNOWN_PHRASES]), F.lit(False), lambda a, b: a | b)


def is_stop(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(STOP_PHRASES))


def question_form(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\?+$", ""))


def as_bool(c: Column) -> Column:
    """True or false words; null for anything else."""
    x = F.lower(F.trim(c.cast("string")))
    return F.when(x.isin(*TRUE_WORDS), True).when(x.isin(*FALSE_WORDS), False)


def escape_graph(c: Column) -> Column:
    return F.translate(c, '"', " ")


def escape_plain(c: Column) -> Column:
    return collapsed(F.translate(c, '"{}', ""))


def vertex_id(c: Column) -> Column:
    """A bigint from digits alone; null for anything else."""
    x = F.trim(c.cast("string"))
    return F.when(x.rlike(r"^-?[0-9]{1,18}$"), x.cast("bigint"))


def stable_id(*parts: Column) -> Column:
    """A bigint from the first 60 bits of an md5: the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("bigint")


def chunk_id(doc_id: Column, seq: Column) -> Column:
    return F.concat(F.lit("chunk_"), F.substring(F.md5(F.concat_ws(":", doc_id.cast("string"), seq.cast("string"))), 1, 12))


def entity_text(name: Column, kind: Column, desc: Column) -> Column:
    return F.concat(F.lit("Entity: "), name, F.lit(". Type: "), kind, F.lit(". Description: "), desc)


def fact_text(src: Column, rel: Column, tgt: Column) -> Column:
    return F.concat_ws(" ", src, rel, tgt)


def bare_words(query: Column) -> Column:
    """Words between blanks without the marks at their ends; one of marks alone becomes empty."""
    return F.transform(F.filter(F.split(query, r"\s+"), lambda t: t != ""), lambda t: F.regexp_replace(t, MARKS_AT_ENDS, ""))


def is_upper(word: Column) -> Column:
    """A capital at the head, or capitals as the only letters with a case."""
    return word.rlike(r"^\p{Lu}") | word.rlike(r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$")


def heuristic_entities(query: Column, most: int = 6) -> Column:
    """Segments between double quotes (a query without any is one), then capitalised words; distinct, at most `most`. Where there are none, the first words."""
    segments = F.filter(F.transform(F.split(query, '"'), stripped), lambda t: t != "")
    words = bare_words(query)
    found = F.array_distinct(F.concat(segments, F.filter(words, lambda t: (t != "") & is_upper(t))))
    return F.when(F.size(found) > 0, F.slice(found, 1, most)).otherwise(F.array_distinct(F.slice(words, 1, most)))


def render_context(chunk: Column, text: Column) -> Column:
    return F.concat(F.lit("["), chunk, F.lit("] "), text)


def path_triples(c: Column) -> Column:
    """Triples (head, relation, tail) of a path text of one or two steps, "a -r-> b <-s- c", each in its edge's direction; null for anything else."""
    n, r = r"(.+)", r"(.+?)(?<! )"  # a relation doesn't end with a blank
    right, left = f" -{r}-> ", f" <-{r}- "

    def triple(pattern: str, head: int, rel: int, tail: int) -> Column:
        return F.struct(*[F.regexp_extract(c, pattern, g).alias(k) for k, g in (("head", head), ("relation", rel), ("tail", tail))])

    out = F.lit(None).cast("array<struct<head:string,relation:string,tail:string>>")
    shapes = [((left, right), ((3, 2, 1), (3, 4, 5))), ((left, left), ((3, 2, 1), (5, 4, 3))), ((right, right), ((1, 2, 3), (3, 4, 5))), ((right, left), ((1, 2, 3), (5, 4, 3))), ((right,), ((1, 2, 3),)), ((left,), ((3, 2, 1),))]
    for arrows, triples in reversed(shapes):  # the first shape that fits counts
        pattern = "^" + n + "".join(a + n for a in arrows) + "$"
        out = F.when(c.rlike(pattern), F.array(*[triple(pattern, *t) for t in triples])).otherwise(out)
    return out


def plain_path(c: Column) -> Column:
    """Path text without the markup of names and relations: ({name: x})-[r:{relationship: y}] to (x)-[y]."""
    x = F.regexp_replace(c, r"\{name: ([^}]*)\}", "$1")
    return F.regexp_replace(x, r"\[[A-Za-z_]*:?\{relationship: ([^}]*)\}\]", "[$1]")


def sorted_texts(c: Column) -> Column:
    """Nested lists of texts as one sorted list, empty ones dropped."""
    return F.array_sort(F.filter(F.transform(F.flatten(c), lambda t: F.trim(t)), lambda t: t != ""))
