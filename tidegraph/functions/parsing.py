"""Model output to columns: fenced or noisy JSON, query entities, answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTRACTION = "entities array<struct<id:string,type:string,desc:string>>, relations array<struct<src:string,tgt:string,rel:string>>"


def json_body(raw: Column) -> Column:
    """What stands from the first { to the last }, fences off; null where there is none."""
    x = F.regexp_replace(F.trim(raw), r"(?i)^```(?:json)?\s*|\s*```$", "")
    first, last = F.instr(x, "{"), F.length(x) - F.instr(F.reverse(x), "}") + 1
    return F.when((first > 0) & F.contains(x, F.lit("}")) & (last > first), F.substring(x, first, last - first + 1))


def extraction(raw: Column) -> Column:
    """Entities and relations of an extraction answer; both empty where it can't be read."""
    got = F.from_json(json_body(raw), EXTRACTION)
    empty_e = F.array().cast("array<struct<id:string,type:string,desc:string>>")
    empty_r = F.array().cast("array<struct<src:string,tgt:string,rel:string>>")
    return F.struct(F.coalesce(got["entities"], empty_e).alias("entities"), F.coalesce(got["relations"], empty_r).alias("relations"))


def valid_relations(entities: Column, relations: Column) -> Column:
    """Relations whose both ends are among the entities of the same chunk."""
    ids = F.transform(entities, lambda e: e["id"])
    return F.filter(relations, lambda r: F.array_contains(ids, r["src"]) & F.array_contains(ids, r["tgt"]))


def query_relations(raw: Column) -> Column:
    """The relations of a query answer, under any of three keys; a string is split at ; and ,."""
    body = json_body(raw)
    text = F.coalesce(*[F.get_json_object(body, f"$.{k}") for k in ("relations", "relationship", "relationships")])
    listed = F.from_json(text, "array<string>")
    named = F.transform(listed, lambda x: F.coalesce(F.get_json_object(x, "$.rel"), F.get_json_object(x, "$.relation"), F.get_json_object(x, "$.text"), x))
    return F.filter(F.transform(F.coalesce(F.when(F.startswith(text, F.lit("[")), named), F.split(text, "[;,]"), F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")


def query_entities(raw: Column) -> Column:
    """The entities of a query answer as (id, type, desc); those without an id go, plain texts are ids."""
    listed = F.from_json(F.get_json_object(json_body(raw), "$.entities"), "array<string>")
    name = lambda x: F.trim(F.coalesce(F.get_json_object(x, "$.id"), F.get_json_object(x, "$.name"), F.when(~F.startswith(x, F.lit("{")), x), F.lit("")))
    part = lambda x, k: F.coalesce(F.get_json_object(x, f"$.{k}"), F.lit("")).alias(k)
    got = F.transform(listed, lambda x: F.struct(name(x).alias("id"), part(x, "type"), part(x, "desc")))
    return F.coalesce(F.filter(got, lambda e: e["id"] != ""), F.array().cast("array<struct<id:string,type:string,desc:string>>"))


def final_answer(raw: Column) -> Column:
    """final_answer or answer of the JSON; else what follows "answer:"; else the text."""
    body = json_body(raw)
    marked = F.nullif(F.trim(F.regexp_extract(raw, r"(?i)(?:final_)?answer\s*[:：]\s*(.+)", 1)), F.lit(""))
    return F.coalesce(F.get_json_object(body, "$.final_answer"), F.get_json_object(body, "$.answer"), marked, F.trim(raw))
