"""Text, JSON and answer scalars, alignment, sources and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsing, text
from ..operators import alignment, evaluate, pairs, store
from ..sources import chunking, datasets
from . import fixtures as X
from .registry import query, table

_FORMS = text.COMPANY_FORMS
_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '[,.\s]+\b({_FORMS})\b[,.\s]*', '', 'g'), '[,.\s]+$', ''), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_HON = ", ".join(f"'{h}'" for h in text.HONORIFICS)
_TOK = lambda c: f"list_filter(string_split({_NORM(c)}, ' '), lambda t: length(t) > 1 AND t NOT IN ({_HON}))"
_DTOK = lambda c: f"list_distinct(list_filter(string_split({_NORM(c)}, ' '), lambda t: t <> ''))"


@query("normalize_name", X.with_(["entities"], f"SELECT uid, {_NORM('name')} AS norm, lower(trim(type)) AS type_norm FROM entities"))
def normalize_name(spark, d):
    return X.entities(spark, d).select("uid", text.normalize_name(F.col("name")).alias("norm"), text.normalize_type(F.col("type")).alias("type_norm"))


@query("tokenize_name", X.with_(["entities"], f"SELECT uid, array_to_string({_TOK('name')}, '|') AS tokens FROM entities"))
def tokenize_name(spark, d):
    return X.entities(spark, d).select("uid", F.array_join(text.name_tokens(F.col("name")), "|").alias("tokens"))


_PAIRS = """SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_type AS x, b.p_type AS y, a.p_name AS an, b.p_name AS bn FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey"""


def _part_pairs(spark, d, value, prepare, score, out, **how):
    return pairs.valued_pairs(table(spark, d, "part"), "p_partkey", value, ["p_brand", "p_size"], prepare, score, out, **how)


_J = lambda x, y: f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({x}, {y})) / CAST(len(list_distinct(list_concat({x}, {y}))) AS DOUBLE) END)"


@query("jaccard_desc", f"SELECT a, b, round({_J('tx', 'ty')}, 6) AS j FROM (SELECT a, b, {_DTOK('x')} AS tx, {_DTOK('y')} AS ty FROM ({_PAIRS}))")
def jaccard_desc(spark, d):
    return _part_pairs(spark, d, "p_type", text.desc_tokens, lambda x, y: F.round(text.jaccard(x, y), 6), "j")


@query("desc_similarity", f"""SELECT a, b, round(CASE WHEN coalesce(x, '') = '' OR coalesce(y, '') = '' THEN 0.0 WHEN j < 0.15::DOUBLE THEN j WHEN j > 0.65::DOUBLE THEN 0.5 * j + 0.5 ELSE 0.5 * j + 0.5 * 0.8::DOUBLE END, 6) AS sim FROM (
  SELECT a, b, x, y, {_J('tx', 'ty')} AS j FROM (SELECT a, b, x, y, {_DTOK('x')} AS tx, {_DTOK('y')} AS ty FROM ({_PAIRS})))""")
def desc_similarity(spark, d):
    return _part_pairs(spark, d, "p_type", lambda v: v, lambda x, y: F.round(text.desc_similarity(x, y, F.lit(0.8)), 6), "sim")


def _alias(a: str, b: str) -> str:
    """The alias rules over two token lists, the shorter of which is picked by a lateral selection."""
    return f"""(SELECT len(s) > 0 AND len(g) > 0 AND (array_to_string(s, ' ') = array_to_string(g, ' ') OR array_to_string(s, ' ') = array_to_string(list_transform(g, lambda t: t[1]), '')
  OR (len(s) = len(g) AND len(list_filter(range(1, len(s) + 1), lambda i: starts_with(g[i], s[i]))) = len(s))
  OR (len(s) = 1 AND len(g) >= 2 AND (g[len(g)] = s[1] OR (length(s[1]) >= 3 AND list_contains(g, s[1]))))
  OR (len(s) < len(g) AND list_reduce(g, lambda n, t: CASE WHEN n < len(s) AND s[n + 1] = t THEN n + 1 ELSE n END, 0::BIGINT) = len(s)))
  FROM (SELECT CASE WHEN length(array_to_string({a}, ' ')) < length(array_to_string({b}, ' ')) THEN {a} ELSE {b} END AS s, CASE WHEN length(array_to_string({a}, ' ')) < length(array_to_string({b}, ' ')) THEN {b} ELSE {a} END AS g))"""


@query("alias_pairs", f"""SELECT a, b FROM (SELECT a, b, {_TOK('an')} AS tx, {_TOK('bn')} AS ty FROM ({_PAIRS})) WHERE {_alias('tx', 'ty')}""")
def alias_pairs(spark, d):
    return _part_pairs(spark, d, "p_name", text.name_tokens, text.alias_by_rules, "alias", keep=True).select("a", "b")


_STRIP = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
_BARE = lambda c: rf"""list_transform(list_filter(regexp_split_to_array({c}, '\s+'), lambda t: t <> ''), lambda t: regexp_replace(t, '^[.,:;!?()\[\]{{}}"]+|[.,:;!?()\[\]{{}}"]+$', '', 'g'))"""
_UPPER = lambda t: rf"(regexp_matches({t}, '^\p{{Lu}}') OR regexp_matches({t}, '^[^\p{{Ll}}\p{{Lt}}]*\p{{Lu}}[^\p{{Ll}}\p{{Lt}}]*$'))"
_HEUR = lambda keys, src: f"""SELECT {keys}, array_to_string(CASE WHEN len(f) > 0 THEN list_slice(f, 1, 6) ELSE list_slice(w, 1, 6) END, '|') AS entities FROM (SELECT {keys}, w, list_filter(l, lambda x, i: list_position(l, x) = i) AS f FROM (
  SELECT {keys}, w, list_concat(list_filter(list_transform(string_split(text, '"'), lambda t: {_STRIP('t')}), lambda t: t <> ''), list_filter(w, lambda t: t <> '' AND {_UPPER('t')})) AS l FROM (SELECT {keys}, text, {_BARE('text')} AS w FROM {src})))"""  # noqa: E731


@query("heuristic_entities", _HEUR("conv_id, turn", "conversations"))
def heuristic_entities(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(text.heuristic_entities(F.col("text")), "|").alias("entities"))


_ODD = ["Ask José and Élise about Zoë", 'who is "Ada Lovelace"?', "3D-Druck über ÄRZTE (NASA)", "what is 東京", "«Olá» São Paulo, (Brasil)!", "quoted \"x y\" and \"x y\" twice", "A b C d E f G h I"]


@query("heuristic_scripts", "SELECT md5(text) AS id, entities FROM (" + _HEUR("text", "(SELECT text FROM documents WHERE text IS NOT NULL UNION ALL SELECT unnest([" + ", ".join("'" + x + "'" for x in _ODD) + "]))") + ")")
def heuristic_scripts(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("text").unionAll(spark.createDataFrame([(x,) for x in _ODD], "text string"))
    return t.select(F.md5("text").alias("id"), F.array_join(text.heuristic_entities(F.col("text")), "|").alias("entities"))


_TRIPLES = """SELECT p_partkey AS ent_id, p_name AS name, p_brand AS type, p_type AS "desc" FROM part"""


def _triples(spark, d):
    p = table(spark, d, "part")
    return p.select(p.p_partkey.alias("ent_id"), p.p_name.alias("name"), p.p_brand.alias("type"), p.p_type.alias("desc"))


_ID = lambda *c: f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(c)})), 1, 15) AS BIGINT)"


@query("edit_ratio")
def edit_ratio(spark, d):
    return _part_pairs(spark, d, "p_name", lambda v: v, lambda x, y: F.round(text.edit_ratio(x, y), 6), "ratio")


@query("exact_dedup", f"""SELECT {_ID('name', 'type', '"desc"')} AS uid, count(*) AS n FROM ({_TRIPLES}) GROUP BY ALL""")
def exact_dedup(spark, d):
    return alignment.exact_cache(_triples(spark, d)).groupBy("uid").agg(F.count("*").alias("n"))


@query("name_cache_checked", f"""SELECT ent_id, key, CASE WHEN ent_id = p OR ({_J('da', 'db')} >= 0.3::DOUBLE AND "desc" <> '' AND pd <> '') THEN p ELSE ent_id END AS primary_id FROM (SELECT *, {_DTOK('"desc"')} AS da, {_DTOK('pd')} AS db FROM (
  SELECT ent_id, key, "desc", min(ent_id) OVER w AS p, first("desc") OVER w AS pd FROM (SELECT p_partkey AS ent_id, {_NORM("split_part(p_name, ' ', 1)")} || '|' || lower(trim(p_brand)) AS key, p_type AS "desc" FROM part) WINDOW w AS (PARTITION BY key ORDER BY ent_id)))""")
def name_cache_checked(spark, d):
    """Parts of a brand whose first word is the same, where descriptions are at least 0.3 alike; the oracle's similarity above 0.65 is over 0.3 either way."""
    p = table(spark, d, "part")
    return alignment.name_cache(p.select(p.p_partkey.alias("ent_id"), F.split("p_name", " ")[0].alias("name"), p.p_brand.alias("type"), p.p_type.alias("desc")))


@query("name_cache", f"""SELECT ent_id, key, min(ent_id) OVER (PARTITION BY key) AS primary_id FROM (SELECT ent_id, {_NORM('name')} || '|' || lower(trim(type)) AS key FROM ({_TRIPLES}))""")
def name_cache(spark, d):
    return alignment.name_cache(_triples(spark, d), floor=None)


def _entities_with_vectors(spark, d):
    """Labels' rows as entities: name and type by label, description by parity, the row's vector."""
    c = X.chunks(spark, d)
    return c.select("vec_id", F.concat(F.lit("Name "), (F.col("vec_id") % 40).cast("string"), F.when(F.col("vec_id") % 3 == 0, ", Inc.").otherwise("")).alias("name"), F.when(F.col("vec_id") % 7 == 0, "").otherwise(F.concat(F.lit("T"), F.col("label").cast("string"))).alias("type"), F.concat(F.lit("row of label "), F.col("label").cast("string"), F.when(F.col("vec_id") % 2 == 0, " even").otherwise(" odd")).alias("desc"), "vec")


_EV = """SELECT vec_id, 'Name ' || (vec_id % 40) || CASE WHEN vec_id % 3 = 0 THEN ', Inc.' ELSE '' END AS name, CASE WHEN vec_id % 7 = 0 THEN '' ELSE 'T' || label END AS type, 'row of label ' || label || CASE WHEN vec_id % 2 = 0 THEN ' even' ELSE ' odd' END AS "desc", vec FROM chunks"""
_CAND = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ent_id ORDER BY cos DESC, uid) AS rank FROM (
  SELECT a.vec_id AS ent_id, a.name, a.type, a."desc", b.vec_id AS uid, b.name AS iname, b.type AS itype, b."desc" AS idesc,
    round(list_inner_product(a.vec, b.vec) / (sqrt(list_inner_product(a.vec, a.vec)) * sqrt(list_inner_product(b.vec, b.vec))), 6) AS cos FROM ev a JOIN ev b ON a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0)) WHERE rank <= 50"""
_FLAG = f"""SELECT *, na = nb AS name_eq, lower(trim(type)) = lower(trim(itype)) AS type_eq, {_alias('ta', 'tb')} AS alias,
  {_J('da', 'db')} AS j FROM (SELECT *, {_NORM('name')} AS na, {_NORM('iname')} AS nb, {_TOK('name')} AS ta, {_TOK('iname')} AS tb, {_DTOK('"desc"')} AS da, {_DTOK('idesc')} AS db FROM cand)"""
_PICK = """SELECT *, round(CASE WHEN j < 0.15::DOUBLE THEN j WHEN j > 0.65::DOUBLE THEN 0.5 * j + 0.5 ELSE 0.5 * j + 0.5 * cos END, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY ent_id ORDER BY CASE WHEN name_eq AND type_eq THEN 0 WHEN type_eq AND alias THEN 1 ELSE 2 END, rank) AS pick FROM flag) WHERE pick = 1"""
_CASC = f"""SELECT ent_id, decision, match_uid, CASE WHEN starts_with(decision, 'reuse') THEN match_uid ELSE {_ID('name', 'type', '"desc"')} END AS uid,
  CASE decision WHEN 'new_possible_same_as' THEN 'possible_same_as' WHEN 'new_alias_of' THEN 'alias_of' END AS link FROM (SELECT *, uid AS match_uid,
  CASE WHEN cos >= 0.92 THEN 'reuse_vector' WHEN name_eq AND type_eq AND d >= 0.6 THEN 'reuse_exact' WHEN name_eq AND type_eq THEN 'new_possible_same_as' WHEN name_eq AND lower(trim(type)) = '' AND NOT type_eq AND d >= 0.5 THEN 'reuse_untyped' WHEN type_eq AND alias THEN 'new_alias_of' ELSE 'new' END AS decision FROM pick)"""


def _cascade(spark, d):
    e = _entities_with_vectors(spark, d)
    batch = e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "ent_id")
    index = e.where("vec_id % 100 <> 0").withColumnRenamed("vec_id", "uid")
    return alignment.cascade(alignment.candidates(batch, index, 50), ratio=None)  # the edit ratio has no SQL form


@query("alignment_cascade", X.with_(["chunks"], _CASC, {"ev": _EV, "cand": _CAND, "flag": _FLAG, "pick": _PICK}))
def alignment_cascade(spark, d):
    return _cascade(spark, d)


@query("alignment_batch")
def alignment_batch(spark, d):
    e = _entities_with_vectors(spark, d)
    return alignment.align(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "ent_id"), e.where("vec_id % 100 <> 0").withColumnRenamed("vec_id", "uid")).drop("vec")


@query("alignment_links", X.with_(["chunks"], f"SELECT DISTINCT uid AS src, match_uid AS dst, link AS relation FROM ({_CASC}) WHERE link IS NOT NULL", {"ev": _EV, "cand": _CAND, "flag": _FLAG, "pick": _PICK}))
def alignment_links(spark, d):
    return alignment.link_edges(_cascade(spark, d).withColumnRenamed("uid", "aligned_uid")).select("src", "dst", "relation")


# --- model output

_RAW = """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN '```json' || chr(10) || j || chr(10) || '```' WHEN 1 THEN 'Here: ' || j || ' done' WHEN 2 THEN j ELSE 'no json, {broken' END AS raw FROM (
  SELECT p_partkey, '{"entities":[{"id":"' || p_name || '","type":"part","desc":"' || p_type || '"},{"id":"' || p_brand || '","type":"brand","desc":""}],"relations":[{"src":"' || p_name || '","tgt":"' || p_brand || '","rel":"MADE_BY"},{"src":"' || p_name || '","tgt":"nobody","rel":"X"}]}' AS j FROM part)"""


def _raw(spark, d):
    p = table(spark, d, "part")
    j = F.format_string('{"entities":[{"id":"%s","type":"part","desc":"%s"},{"id":"%s","type":"brand","desc":""}],"relations":[{"src":"%s","tgt":"%s","rel":"MADE_BY"},{"src":"%s","tgt":"nobody","rel":"X"}]}', "p_name", "p_type", "p_brand", "p_name", "p_brand", "p_name")
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), j, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here: "), j, F.lit(" done"))).when(k == 2, j).otherwise("no json, {broken")
    return p.select(F.col("p_partkey").alias("id"), raw.alias("raw"))


@query("llm_json_parse", f"SELECT id, CAST(CASE WHEN id % 4 = 3 THEN 0 ELSE 2 END AS BIGINT) AS n_entities, CASE WHEN id % 4 = 3 THEN NULL ELSE (SELECT p_name FROM part WHERE p_partkey = id) END AS first_id FROM ({_RAW})")
def llm_json_parse(spark, d):
    x = _raw(spark, d).select("id", parsing.extraction(F.col("raw")).alias("x"))
    return x.select("id", F.size("x.entities").cast("bigint").alias("n_entities"), F.get("x.entities", F.lit(0))["id"].alias("first_id"))


@query("relation_semijoin", "SELECT p_partkey AS id, p_name AS src, p_brand AS tgt, 'MADE_BY' AS rel FROM part WHERE p_partkey % 4 <> 3")
def relation_semijoin(spark, d):
    x = _raw(spark, d).select("id", parsing.extraction(F.col("raw")).alias("x"))
    return x.select("id", F.explode(parsing.valid_relations(F.col("x.entities"), F.col("x.relations"))).alias("r")).select("id", "r.src", "r.tgt", "r.rel")


@query("query_relations", "SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'owns|' || s_name WHEN 1 THEN 'sells|' || s_name ELSE 'knows|' || s_name END AS relations FROM supplier")
def query_relations(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey") % 3
    raw = F.when(k == 0, F.format_string('{"relations": "owns; %s"}', "s_name")).when(k == 1, F.format_string('{"relationship": ["sells", "%s"]}', "s_name")).otherwise(F.format_string('{"relationships": [{"rel": "knows"}, {"relation": "%s"}]}', "s_name"))
    return s.select(F.col("s_suppkey").alias("id"), F.array_join(parsing.query_relations(raw), "|").alias("relations"))


@query("answer_parse", "SELECT c_custkey AS id, c_name AS answer FROM customer")
def answer_parse(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, F.format_string('```json\n{"final_answer": "%s"}\n```', "c_name")).when(k == 1, F.format_string('{"answer": "%s"}', "c_name")).when(k == 2, F.format_string("Final_Answer: %s", "c_name")).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return c.select(F.col("c_custkey").alias("id"), parsing.final_answer(raw).alias("answer"))


@query("bool_coercion", "SELECT DISTINCT r_name AS x, CAST(NULL AS BOOLEAN) AS b FROM region UNION ALL SELECT * FROM (VALUES ('Yes', true), ('n', false), ('1', true), ('0', false))")
def bool_coercion(spark, d):
    words = spark.createDataFrame([("Yes",), ("n",), ("1",), ("0",)], "x string")
    return table(spark, d, "region").select(F.col("r_name").alias("x")).distinct().unionAll(words).select("x", text.as_bool(F.col("x")).alias("b"))


@query("unknown_answers", "SELECT conv_id, turn, lower(trim(text)) = '' OR contains(lower(text), 'i don''t know') OR contains(lower(text), 'cannot answer') OR contains(lower(text), 'not enough information') AS unknown, regexp_matches(lower(text), 'unknown|i don''t know|not found') AS stop, lower(regexp_replace(trim(text), '\\?+$', '')) AS form FROM conversations")
def unknown_answers(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", text.is_unknown(t).alias("unknown"), text.is_stop(t).alias("stop"), text.question_form(t).alias("form"))


@query("escaping", r"""SELECT page_id, md5(replace(html, '"', ' ')) AS graph, md5(trim(regexp_replace(translate(html, '"{}', ''), '\s+', ' ', 'g'))) AS plain, try_cast(CASE WHEN regexp_matches(v, '^-?[0-9]{1,18}$') THEN v END AS BIGINT) AS vid
  FROM (SELECT *, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN ' ' || page_id ELSE page_id || 'x' END AS raw, trim(raw) AS v FROM pages)""")
def escaping(spark, d):
    k = F.col("page_id") % 3
    raw = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit(" "), F.col("page_id").cast("string"))).otherwise(F.concat(F.col("page_id").cast("string"), F.lit("x")))
    return table(spark, d, "pages").select("page_id", F.md5(text.escape_graph(F.col("html"))).alias("graph"), F.md5(text.escape_plain(F.col("html"))).alias("plain"), text.vertex_id(raw).alias("vid"))


@query("stable_ids", f"""SELECT s_suppkey, {_ID('s_name', "'supplier'")} AS uid, 'Entity: ' || s_name || '. Type: supplier. Description: d' AS template FROM supplier""")
def stable_ids(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", text.stable_id(F.col("s_name"), F.lit("supplier")).alias("uid"), text.entity_text(F.col("s_name"), F.lit("supplier"), F.lit("d")).alias("template"))


@query("context_assembly", X.with_([], "SELECT conv_id, md5(string_agg('[' || turn || '] ' || text, chr(10) || chr(10) ORDER BY turn)) AS context FROM conversations GROUP BY conv_id"))
def context_assembly(spark, d):
    c = table(spark, d, "conversations")
    items = F.array_sort(F.collect_list(F.struct("turn", text.render_context(F.col("turn").cast("string"), F.col("text")).alias("t"))))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(items, lambda s: s["t"]), "\n\n")).alias("context"))


# --- evaluation

_ART = r"'(^|[^\p{L}\p{N}_])(?:a|an|the)($|[^\p{L}\p{N}_])', '\1 \2', 'g'"
_AF = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), {_ART}), {_ART}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_CF = lambda c: _STRIP(rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_STRIP(f"lower({c})")}, '["''`]', '', 'g'), '-', ' ', 'g'), '[.,，。;；:：]', ' ', 'g'), '[!?！？]+\z', ''), '\s+', ' ', 'g')""")
_ANSWERS = [("東京", "大阪"), ("東京。", "東京"), ("The Café, a b!", "café b"), ("New-York's", "new york s"), ("snake_case", "snake case"), ("", "the"), ("Straße", "strasse"), ("it is New-York.", "new york"), ('say "hello world" now', "hello world"), ("rock 'n' roll?!", "rock n roll")]
_ANSWER_ROWS = "(SELECT * FROM (VALUES " + ", ".join("({}, '{}', '{}')".format(i, a.replace("'", "''"), b.replace("'", "''")) for i, (a, b) in enumerate(_ANSWERS)) + ") t(q_id, predict, gt))"


def _answer_rows(spark):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_ANSWERS)], "q_id long, predict string, gt string")


@query("answer_normalize", f"SELECT kind, id, {_AF('text')} AS em_form, {_CF('text')} AS containment_form FROM (SELECT 'turn' AS kind, conv_id * 1000 + turn AS id, text FROM conversations UNION ALL SELECT 'doc', doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'odd', q_id, predict FROM {_ANSWER_ROWS})")
def answer_normalize(spark, d):
    c = table(spark, d, "conversations").select(F.lit("turn").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    t = table(spark, d, "documents").where("text is not null").select(F.lit("doc"), "doc_id", "text")
    both = c.unionAll(t).unionAll(_answer_rows(spark).select(F.lit("odd"), "q_id", "predict"))
    return both.select("kind", "id", text.answer_form(F.col("text")).alias("em_form"), text.containment_form(F.col("text")).alias("containment_form"))


@query("exact_match", X.with_(["qa"], f"SELECT q_id, CAST({_AF('predict')} = {_AF('gt')} AS INTEGER) AS em FROM qa UNION ALL SELECT -1 - s_suppkey, CAST({_AF('s_name')} = {_AF('upper(s_name)')} AS INTEGER) FROM supplier UNION ALL SELECT -1000000 - q_id, CAST({_AF('predict')} = {_AF('gt')} AS INTEGER) FROM {_ANSWER_ROWS}"))
def exact_match(spark, d):
    q = X.qa(spark, d)
    s = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("q_id"), F.col("s_name").alias("predict"), F.upper("s_name").alias("gt"))
    odd = _answer_rows(spark).withColumn("q_id", -1000000 - F.col("q_id"))
    return evaluate.answers(q.unionAll(s).unionAll(odd)).select("q_id", "em")


_WORDS = lambda c: rf"list_filter(regexp_split_to_array(trim(lower({c})), '\s+'), lambda w: w <> '')"


@query("rouge_l", X.with_(["qa"], f"""SELECT q_id, CASE WHEN n = 0 THEN 0.0 ELSE round(n / CAST(len(b) AS DOUBLE), 4) END AS rouge_l FROM (
  SELECT q_id, b, CAST(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE list_reduce(a, lambda above, x: list_reduce(range(1, len(b) + 1), lambda row, j: list_append(row, CASE WHEN b[j] = x THEN above[j] + 1 ELSE greatest(above[j + 1], row[-1]) END), [0::BIGINT]), list_transform(range(len(b) + 1), lambda i: 0::BIGINT))[-1] END AS DOUBLE) AS n FROM (
  SELECT q_id, {_WORDS('predict')} AS a, {_WORDS('gt')} AS b FROM qa))"""))
def rouge_l(spark, d):
    return evaluate.answers(X.qa(spark, d)).select("q_id", "rouge_l")


_IN = lambda p, a: f"contains({_CF(p)}, {_CF(a)})"


@query("containment_accuracy", f"""SELECT *, first AND second AS correct FROM (SELECT p_partkey AS q_id, {_IN('p_type', 'p_brand')} OR {_IN('p_type', "'steel'")} AS first, {_IN('p_type', "'ANODIZED'")} OR {_IN('p_type', "'plated'")} AS second FROM part
  UNION ALL SELECT -1 - q_id, {_IN('predict', 'gt')}, {_IN('predict', "''")} FROM {_ANSWER_ROWS})""")
def containment_accuracy(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("q_id"), F.col("p_type").alias("predict"), F.array(F.array("p_brand", F.lit("steel")), F.array(F.lit("ANODIZED"), F.lit("plated"))).alias("truths"))
    odd = _answer_rows(spark).select((-1 - F.col("q_id")).alias("q_id"), "predict", F.array(F.array("gt"), F.array(F.lit(""))).alias("truths"))
    return evaluate.containment(p.unionAll(odd)).select("q_id", (F.get("flags", F.lit(0)) == 1).alias("first"), (F.get("flags", F.lit(1)) == 1).alias("second"), "correct")


_HITS = "SELECT o_custkey AS q_id, CAST(o_orderkey AS VARCHAR) AS chunk_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, o_orderpriority = '1-URGENT' AS rel FROM orders"


def _order_hits(spark, d):
    from ..operators.vector_search import ranked

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("q_id"), F.col("o_orderkey").cast("string").alias("chunk_id"), "o_totalprice", "o_orderkey", "o_orderpriority")
    hits = ranked(o, "q_id", [F.desc("o_totalprice"), F.col("o_orderkey")])
    return evaluate.retrieval(hits.select("q_id", "chunk_id", "rank"), o.where("o_orderpriority = '1-URGENT'").select("q_id", "chunk_id"))


_RET = f"SELECT q_id, CAST(bool_or(rel) AS INTEGER) AS hit, round(coalesce(1.0::DOUBLE / min(CASE WHEN rel THEN rank END), 0.0), 6) AS rr FROM ({_HITS}) GROUP BY q_id"


@query("hit_rate", f"SELECT q_id, hit FROM ({_RET})")
def hit_rate(spark, d):
    return _order_hits(spark, d).select("q_id", "hit")


@query("mrr", f"SELECT count(*) AS questions, round(avg(CAST(hit AS DOUBLE)), 4) AS hit, round(avg(rr), 4) AS rr FROM ({_RET})")
def mrr(spark, d):
    return evaluate.report(_order_hits(spark, d), ["hit", "rr"])


@query("semantic_score", "SELECT CAST(a.label AS BIGINT) AS q_id, max(round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6)) AS semantic FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id AND a.vec_id % 100 = 0 GROUP BY a.label")
def semantic_score(spark, d):
    c = X.chunks(spark, d)
    a = c.where("vec_id % 100 = 0").select(F.col("label").alias("q_id"), F.col("vec").alias("pvec"), F.col("vec_id").alias("a"))
    b = c.select(F.col("label").alias("q_id"), F.col("vec").alias("rvec"), F.col("vec_id").alias("b"))
    return evaluate.semantic(a.join(b, "q_id").where("a < b"))


@query("phase_accuracy", "SELECT o_orderpriority AS phase, count(*) AS questions, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS accuracy FROM orders GROUP BY ALL")
def phase_accuracy(spark, d):
    return evaluate.phases(table(spark, d, "orders").select(F.col("o_orderpriority").alias("phase"), F.col("o_orderkey").alias("q_id"), (F.col("o_orderstatus") == "F").alias("correct")))


@query("path_cleanup", r"""SELECT s_suppkey, '(' || s_name || ')-[SUPPLIES]->(' || s_nationkey || ')' AS path, s_name || '|a' AS texts FROM supplier""")
def path_cleanup(spark, d):
    s = table(spark, d, "supplier")
    raw = F.concat(F.lit("({name: "), "s_name", F.lit("})-[e:{relationship: SUPPLIES}]->({name: "), F.col("s_nationkey").cast("string"), F.lit("})"))
    names = F.array(F.array(F.concat(F.lit(" "), "s_name"), F.lit("")), F.array(F.concat(F.lit("a "))))
    return s.select("s_suppkey", text.plain_path(raw).alias("path"), F.array_join(text.sorted_texts(names), "|").alias("texts"))


# --- sources


@query("unexpired_rows", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 14 DAY")
def unexpired_rows(spark, d):
    return store.unexpired(table(spark, d, "events"), "ts", F.lit("2024-01-30 00:00:00").cast("timestamp")).select("event_id")


@query("corpus_dedup", "SELECT url AS title, html_md5 FROM (SELECT split_part(url, '/', 3) AS url, md5(html) AS html_md5, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS r FROM pages WHERE html <> '') WHERE r = 1")
def corpus_dedup(spark, d):
    p = table(spark, d, "pages").select(F.col("page_id").alias("q_id"), F.lit(0).alias("pos"), F.element_at(F.split("url", "/"), 3).alias("title"), F.col("html").alias("body"))
    return datasets.first_by_title(p).select("title", F.md5("body").alias("html_md5"))


@query("two_phase_scan", "SELECT CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS phase, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def two_phase_scan(spark, d):
    t = table(spark, d, "documents")
    return t.groupBy(F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).alias("phase")).agg(F.count("*").alias("docs"), F.sum(F.length("text")).alias("chars"))


@query("chunk_fixed", """SELECT 'chunk_' || substr(md5(doc_id || ':' || seq), 1, 12) AS chunk_id, doc_id, seq, md5(substr(text, seq * 700 + 1, 800)) AS body FROM (
  SELECT doc_id, text, unnest(range(CAST(greatest(1, ceil((length(text) - 100) / 700.0)) AS BIGINT))) AS seq FROM documents WHERE length(text) > 0)""")
def chunk_fixed(spark, d):
    return chunking.fixed(table(spark, d, "documents")).select("chunk_id", "doc_id", "seq", F.md5("text").alias("body"))


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return chunking.recursive(table(spark, d, "documents"))


@query("qa_resume_antijoin", "SELECT DISTINCT text AS question FROM conversations WHERE role = 'user' AND text NOT IN (SELECT text FROM conversations WHERE role = 'user' AND conv_id % 2 = 0)")
def qa_resume_antijoin(spark, d):
    q = table(spark, d, "conversations").where("role = 'user'").select(F.col("text").alias("question"), "conv_id")
    return datasets.unfinished(q, q.where("conv_id % 2 = 0")).select("question").distinct()


@query("batch_merge", "SELECT conv_id, turn FROM conversations")
def batch_merge(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    return c.where("conv_id % 2 = 0").unionByName(c.where("conv_id % 2 = 1"))


@query("cache_append", "SELECT DISTINCT md5(text) AS key FROM conversations WHERE md5(text) NOT IN (SELECT md5(text) FROM conversations WHERE turn = 0)")
def cache_append(spark, d):
    c = table(spark, d, "conversations").select(F.md5("text").alias("key"), "turn")
    return store.append_absent(c.where("turn = 0"), c, ["key"]).select("key")


@query("seeded_sample", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey || ':2000'), c_custkey LIMIT 100")
def seeded_sample(spark, d):
    return datasets.sample_rows(table(spark, d, "customer"), "c_custkey", 100).select("c_custkey")


@query("compact_packs")
def compact_packs(spark, d):
    return chunking.packed(table(spark, d, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", 100)


@query("batch_fetch", "SELECT e.event_id, e.user_id AS doc_id, coalesce(md5(t.text), '') AS body FROM events e LEFT JOIN documents t ON e.user_id = t.doc_id")
def batch_fetch(spark, d):
    e, t = table(spark, d, "events"), table(spark, d, "documents")
    return e.join(t.select("doc_id", F.md5("text").alias("m")), e.user_id == t.doc_id, "left").select("event_id", F.col("user_id").alias("doc_id"), F.coalesce("m", F.lit("")).alias("body"))


@query("efficiency_ratio", "SELECT o_orderpriority AS system, round(avg(o_totalprice), 4) AS per_q, round(avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders WHERE o_orderpriority = '1-URGENT'), 4) AS ratio FROM orders GROUP BY o_orderpriority")
def efficiency_ratio(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("system")).agg(F.avg("o_totalprice").alias("m"))
    base = o.where("system = '1-URGENT'").select("m").scalar()
    return o.select("system", F.round("m", 4).alias("per_q"), F.round(F.col("m") / base, 4).alias("ratio"))
