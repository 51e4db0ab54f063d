"""Hand-computed cases of the engine's own operators."""

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import metrics, parsing, text, vector
from tidegraph.operators import alignment, cache, evaluate, fusion, graph, pairs, ranking, store, vector_search, walk
from tidegraph.plans import fixtures
from tidegraph.sources import chunking, datasets


def one(spark, expression, schema="x string", *row):
    return spark.createDataFrame([row], schema).select(expression.alias("v")).first()["v"]


def lists(spark, dense, graph_list):
    a = spark.createDataFrame([(1, c, i + 1, s) for i, (c, s) in enumerate(dense)], "q_id long, chunk_id string, rank long, score double")
    b = spark.createDataFrame([(1, c, i + 1, s) for i, (c, s) in enumerate(graph_list)], "q_id long, chunk_id string, rank long, score double")
    return a, b


def test_reciprocal_rank(spark):
    a, b = lists(spark, [("a", 1.0), ("b", 0.9), ("c", 0.8)], [("b", 1.0), ("d", 0.5)])
    got = [(r["chunk_id"], r["score"]) for r in fusion.rrf(a, b).orderBy("rank").collect()]
    assert got == [("b", 0.032522), ("a", 0.016393), ("d", 0.016129), ("c", 0.015873)]


def test_weighted(spark):
    a, b = lists(spark, [("a", 0.9), ("b", 0.5)], [("b", 2.0), ("d", 1.0)])
    covered = spark.createDataFrame([(1, "b", 2)], "q_id long, chunk_id string, n_entities long")
    got = {r["chunk_id"]: r["score"] for r in fusion.weighted(a, b, covered).collect()}
    assert got == {"b": 3.9, "a": 0.5, "d": 0.0}


def test_dual(spark):
    a, b = lists(spark, [("a", 1.0), ("b", 0.9), ("c", 0.8)], [("b", 1.0), ("d", 0.5), ("e", 0.4)])
    assert [r["chunk_id"] for r in fusion.dual(a, b).orderBy("rank").collect()] == ["b", "a", "d", "c", "e"]


@pytest.fixture
def small_graph(spark):
    mentions = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 2), ("c2", 3)], "chunk_id string, uid long")
    edges = spark.createDataFrame([(1, 2, "r", "c1"), (2, 3, "r", "c2")], "src long, dst long, relation string, source_chunk string")
    seeds = spark.createDataFrame([(1, "e", 1, 1.0)], "q_id long, ent_id string, uid long, weight double")
    near = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5)], "uid long, sim double")
    return mentions, edges, seeds, near


def test_walks(spark, small_graph):
    mentions, edges, seeds, near = small_graph
    chunks, nodes = walk.beam_walk(seeds, mentions, edges, near)
    assert {r["chunk_id"]: r["score"] for r in chunks.collect()} == {"c1": 3.0, "c2": 1.5}
    assert {r["uid"]: r["score"] for r in nodes.collect()} == {1: 1.0, 2: 0.5, 3: 0.25}
    assert {r["chunk_id"]: r["score"] for r in walk.fact_walk(seeds.drop("ent_id"), mentions, edges).collect()} == {"c1": 2.25, "c2": 1.125}
    vertices = mentions.select(F.col("uid").alias("vid"), F.col("chunk_id").alias("source_chunk"))
    assert {r["chunk_id"]: r["score"] for r in walk.two_hop(seeds, vertices, edges, near)[0].collect()} == {"c1": 2.3, "c2": 1.1}


def test_fact_walk_by_brute_force(spark):
    """150 questions (more than a mask and a row hold), several weights each, against a search of each question by itself."""
    draw = random.Random(5)
    edges = [(draw.randrange(60), draw.randrange(60), "r", draw.choice([None, f"c{draw.randrange(25)}"])) for _ in range(75)]
    mentions = [(f"c{draw.randrange(25)}", draw.randrange(60)) for _ in range(50)]
    seeds = sorted({(q, draw.randrange(64), draw.choice([1.0, 0.7, 0.25])) for q in range(150) for _ in range(draw.randrange(1, 5))})
    near, share = defaultdict(set), defaultdict(float)
    for a, b, _, c in edges:
        near[a].add(b)
        near[b].add(a)
        for uid in (a, b):
            if c is not None:
                share[uid, c] += 0.5
    for c, uid in set(mentions):
        share[uid, c] += 1.0
    expect: dict = defaultdict(float)
    for q in range(150):
        frontier, met = {(u, w) for k, u, w in seeds if k == q}, set()
        for hop in range(4):
            met |= {u for u, _ in frontier}
            for u, w in frontier:
                for (uid, c), x in share.items():
                    if uid == u:
                        expect[q, c] += w * 0.5**hop * x
            frontier = {(v, w) for u, w in frontier for v in near[u] if v not in met}
    got = walk.fact_walk(
        spark.createDataFrame(seeds, "q_id long, uid long, weight double"),
        spark.createDataFrame(mentions, "chunk_id string, uid long"),
        spark.createDataFrame(edges, "src long, dst long, relation string, source_chunk string"),
        max_hops=4,
        top_chunks=None,
    ).collect()
    assert {(r["q_id"], r["chunk_id"]): r["score"] for r in got} == pytest.approx(expect, abs=2e-6)


def test_beam_keeps_the_likest(spark):
    edges = spark.createDataFrame([(0, i, "r", f"c{i}") for i in range(1, 9)], "src long, dst long, relation string, source_chunk string")
    mentions = spark.createDataFrame([("c0", 0)], "chunk_id string, uid long")
    seeds = spark.createDataFrame([(1, "e", 0, 1.0)], "q_id long, ent_id string, uid long, weight double")
    near = spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "uid long, sim double")
    _, nodes = walk.beam_walk(seeds, mentions, edges, near, max_hops=2)
    assert {r["uid"] for r in nodes.collect()} == {0, 2, 3, 4, 5, 6}


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_promotion_fires_once(spark):
    log = spark.createDataFrame([("x", at(i), i) for i in range(4)] + [("y", at(0), 9)], "chunk_id string, ts timestamp, event_id long")
    assert [(r["chunk_id"], r["event_id"]) for r in cache.promotions(log).collect()] == [("x", 2)]


def test_eviction_prefers_chunks_without_hits(spark):
    state = spark.createDataFrame([("a", at(0), at(1), 1), ("b", at(0), at(2), 0), ("c", at(0), at(3), 2)], "chunk_id string, created_at timestamp, last_access timestamp, hits long")
    assert [r["chunk_id"] for r in cache.evictions(state, 2).collect()] == ["b"]
    assert cache.evictions(state, 3).count() == 0
    assert {r["chunk_id"] for r in cache.prune(state, F.lit(at(4)), 2, 5).collect()} == {"b", "c"}


def test_idle_as_long_as_the_limit_is_kept(spark):
    state = spark.createDataFrame([("a", at(0), at(0), 1)], "chunk_id string, created_at timestamp, last_access timestamp, hits long")
    assert cache.expired(state, F.lit(at(10)), 10).count() == 0 and cache.expired(state, F.lit(at(11)), 10).count() == 1
    assert cache.expired(state, F.lit(at(99)), 0).count() == 0


def test_eviction_drops_refcounts_and_edges(spark, small_graph):
    mentions, edges, _, _ = small_graph
    nodes, kept = cache.after_eviction(mentions, edges, spark.createDataFrame([("c1",)], "chunk_id string"))
    assert {r["uid"]: r["ref_count"] for r in nodes.collect()} == {2: 1, 3: 1} and kept.count() == 1


def test_names(spark):
    norm = lambda s: one(spark, text.normalize_name(F.col("x")), "x string", s)
    assert norm("Apple, Inc.") == "apple" and norm("apple, inc. foo") == "applefoo"
    assert one(spark, text.name_tokens(F.col("x")), "x string", "Dr. Ada B Lovelace") == ["ada", "lovelace"]


@pytest.mark.parametrize("a,b,same", [("international business machines", "ibm", True), ("ada lovelace", "ada lovelace", True), ("a", "ada", False), ("robert smith", "rob smi", True), ("ada king lovelace", "lovelace", True), ("ada king lovelace", "ada lovelace", True), ("ada lovelace", "lovelace ada", False), ("", "ada", False), ("big ben", "tower", False)])
def test_alias_rules(spark, a, b, same):
    got = one(spark, text.alias_by_rules(text.name_tokens(F.col("a")), text.name_tokens(F.col("b"))), "a string, b string", a, b)
    assert got is same


def test_description_band(spark):
    got = one(spark, text.desc_similarity(F.col("a"), F.col("b"), F.lit(0.4)), "a string, b string", "ceo of tesla", "ceo of spacex")
    assert abs(got - (0.25 + 0.5 * 0.4)) < 1e-9
    assert one(spark, text.desc_similarity(F.col("a"), F.col("b"), F.lit(0.4)), "a string, b string", "", "x") == 0.0


def test_medians_and_norms(spark):
    rows = spark.createDataFrame([(1, w) for w in (0.1, 0.2, 0.3, 0.4)], "q_id long, w double")
    assert ranking.upper_median(rows, "q_id", "w").first()["median"] == 0.3
    norm = lambda *x: sorted(r["n"] for r in ranking.minmax(spark.createDataFrame([(1, v) for v in x], "q_id long, s double"), "s", "n").collect())
    assert norm(2.0, -1.0) == [0.5, 0.5] and norm(1.0, 3.0, -1.0) == [-1.0, 0.0, 1.0] and norm(-2.0, 0.0) == [-2.0, 0.0]


def test_forms_of_any_script(spark):
    em = lambda a, b: one(spark, metrics.exact_match(F.col("a"), F.col("b")), "a string, b string", a, b)
    assert em("東京", "大阪") == 0 and em("東京。", "東京") == 1 and em(None, "the") == 1 and em("The Café!", "café") == 1
    assert one(spark, text.containment_form(F.col("x")), "x string", ' "It\'s" New-York, `now`?! ') == "its new york now"
    assert one(spark, metrics.contains_all(F.col("x"), F.array(F.array(F.lit("new york")))), "x string", "it is New-York.") == [1]
    assert one(spark, text.heuristic_entities(F.col("x")), "x string", "Ask José and Élise about Zoë") == ["Ask José and Élise about Zoë", "Ask", "José", "Élise", "Zoë"]
    assert one(spark, text.heuristic_entities(F.col("x")), "x string", ' "" . ') == ["."] and one(spark, text.heuristic_entities(F.col("x")), "x string", '" " "') == [""]


@pytest.mark.parametrize("path,expect", [
    ("a -r-> b", [("a", "r", "b")]), ("a <-r- b", [("b", "r", "a")]), ("a <-r- b -s-> c", [("b", "r", "a"), ("b", "s", "c")]), ("a <-r- b <-s- c", [("b", "r", "a"), ("c", "s", "b")]),
    ("a -r-> b -s-> c", [("a", "r", "b"), ("b", "s", "c")]), ("a -r-> b <-s- c", [("a", "r", "b"), ("c", "s", "b")]), ("a", None),
])
def test_paths_to_triples(spark, path, expect):
    got = one(spark, text.path_triples(F.col("x")), "x string", path)
    assert (None if got is None else [tuple(t) for t in got]) == expect


def test_edit_ratio_is_the_library_s(spark):
    from difflib import SequenceMatcher

    pairs = [("ada lovelace", "ada lovelase"), ("abc", "abc"), ("", "a"), (None, "a"), ("kitten", "sitting"), ("日本", "日本語"), ("abab", "baba")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.edit_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    for r in got:
        assert r["r"] == (SequenceMatcher(None, r["a"], r["b"]).ratio() if r["a"] and r["b"] else 0.0)


def test_alignment_caches_names_within_a_batch(spark):
    rows = [(1, "Tower Inc", "place", "tall", [0.7, 0.7]), (2, "tower", "Place", "something else", [1.0, 0.1]), (3, "Bridge", "place", "long", [0.7, 0.7])]
    batch = spark.createDataFrame(rows, "ent_id long, name string, type string, desc string, vec array<double>")
    got = {r["ent_id"]: r for r in alignment.align(batch, index_rows(spark)).collect()}
    assert got[1]["aligned_uid"] == got[2]["aligned_uid"] != got[3]["aligned_uid"] and got[2]["decision"] == "cached"
    more = alignment.extended(index_rows(spark), spark.createDataFrame(list(map(tuple, got.values())), alignment.align(batch, index_rows(spark)).schema))
    assert more.count() == 4


def test_top_k_within_shards_and_groups(spark):
    import random

    r = random.Random(1)
    rows = [(f"c{i}", [r.gauss(0, 1) for _ in range(5)], i % 3) for i in range(400)]
    q = spark.createDataFrame([(i, rows[i][1], i % 3) for i in range(0, 400, 40)], "q_id long, qvec array<double>, label long")
    c = spark.createDataFrame(rows, "chunk_id string, vec array<double>, label long")
    kept = vector_search.LEAST_ROWS, vector_search.QUERY_BLOCK
    vector_search.LEAST_ROWS, vector_search.QUERY_BLOCK = 100, 4
    try:
        got = vector_search.top_k(q, c, 5, own=F.concat(F.lit("c"), F.col("q_id").cast("string")), within="label").collect()
    finally:
        vector_search.LEAST_ROWS, vector_search.QUERY_BLOCK = kept

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5), 6)

    for i in range(0, 400, 40):
        best = sorted(((-cos(rows[i][1], v), k) for k, v, g in rows if g == i % 3 and k != f"c{i}"))[:5]
        assert [(x["chunk_id"], x["score"]) for x in sorted(got, key=lambda x: x["rank"]) if x["q_id"] == i] == [(k, -s) for s, k in best]


def test_retrieval_metrics(spark):
    hits = spark.createDataFrame([(1, "x", 1), (1, "a", 2), (2, "y", 1)], "q_id long, chunk_id string, rank long")
    got = {r["q_id"]: (r["hit"], r["rr"]) for r in evaluate.retrieval(hits, spark.createDataFrame([(1, "a")], "q_id long, chunk_id string")).collect()}
    assert got == {1: (1, 0.5), 2: (0, 0.0)}


def test_containment(spark):
    qa = spark.createDataFrame([(1, "cat and mat", [["cat"], ["MAT", "mat"]]), (2, "cat", [["dog"]])], "q_id long, predict string, truths array<array<string>>")
    got = {r["q_id"]: (r["flags"], r["correct"]) for r in evaluate.containment(qa).collect()}
    assert got == {1: ([1, 1], True), 2: ([0], False)}


def test_rouge_and_match(spark):
    assert metrics.lcs("a b c d".split(), "b x d".split()) == 2 and metrics.lcs([], ["a"]) == 0
    qa = spark.createDataFrame([(1, "The cat, sat", "cat sat"), (2, "", "a")], "q_id long, predict string, gt string")
    got = {r["q_id"]: (r["em"], r["rouge_l"]) for r in evaluate.answers(qa).collect()}
    assert got == {1: (1, 0.5), 2: (1, 0.0)}


@pytest.mark.parametrize("raw,answer", [('```json\n{"final_answer": "x"}\n```', "x"), ('pre {"answer": "y"} post', "y"), ("Answer: z", "z"), ("final_answer：w", "w"), (" raw ", "raw"), ("{broken", "{broken")])
def test_answer_parsing(spark, raw, answer):
    assert one(spark, parsing.final_answer(F.col("x")), "x string", raw) == answer


def test_extraction_drops_dangling_relations(spark):
    raw = '{"entities":[{"id":"a","type":"t","desc":""},{"id":"b","type":"t","desc":""}],"relations":[{"src":"a","tgt":"b","rel":"r"},{"src":"a","tgt":"z","rel":"r"}]}'
    df = spark.createDataFrame([(raw,), ("nothing",)], "x string").select(parsing.extraction(F.col("x")).alias("e"))
    got = df.select(parsing.valid_relations(F.col("e.entities"), F.col("e.relations")).alias("r")).collect()
    assert [len(r["r"]) for r in got] == [1, 0]


def index_rows(spark):
    return spark.createDataFrame([(10, "Apple Inc", "org", "maker of phones", [1.0, 0.0]), (11, "Ada Lovelace", "person", "wrote the first program", [0.0, 1.0])], "uid long, name string, type string, desc string, vec array<double>")


@pytest.mark.parametrize("row,decision", [
    (("Anything", "x", "y", [1.0, 0.1]), "reuse_vector"),
    (("Apple", "org", "maker of phones", [0.7, 0.7]), "reuse_exact"),
    (("Apple", "org", "a fruit seller", [0.7, 0.7]), "new_possible_same_as"),
    (("Apple", "", "maker of phones", [0.75, 0.7]), "reuse_untyped"),
    (("Lovelace", "person", "someone else", [0.7, 0.7]), "new_alias_of"),
    (("Tower", "place", "tall", [0.7, 0.7]), "new"),
])
def test_cascade_branches(spark, row, decision):
    batch = spark.createDataFrame([(1, *row)], "ent_id long, name string, type string, desc string, vec array<double>")
    got = alignment.align(batch, index_rows(spark)).first()
    assert got["decision"] == decision and (got["link"] is not None) == ("_of" in decision or "same_as" in decision)


def test_alignment_gives_equal_triples_one_uid(spark):
    batch = spark.createDataFrame([(i, "New Name", "t", "d", [0.5, 0.5]) for i in range(3)], "ent_id long, name string, type string, desc string, vec array<double>")
    got = alignment.align(batch, index_rows(spark).limit(0)).collect()
    assert len(got) == 3 and len({r["aligned_uid"] for r in got}) == 1 and {r["decision"] for r in got} == {"new"}


def test_node_merge_takes_the_first_non_empty(spark):
    m = spark.createDataFrame([("c1", 1, "", "t", "", 1), ("c2", 1, "n", "u", "d", 2), ("c2", 1, "n", "u", "d", 3), ("", 2, "", "", "", 4)], "chunk_id string, uid long, name string, type string, desc string, seq long")
    got = {r["uid"]: r for r in graph.merge_nodes(m).collect()}
    assert (got[1]["name"], got[1]["type"], got[1]["desc"], got[1]["ref_count"], got[1]["source_chunks"]) == ("n", "t", "d", 2, ["c1", "c2"])
    assert got[2]["ref_count"] == 0


def test_delete_keeps_what_is_still_reached(spark, small_graph):
    _, edges, _, _ = small_graph
    vertices = spark.createDataFrame([(1,), (2,), (3,), (9,)], "vid long")
    left, kept = graph.delete_triplet(edges, vertices, spark.createDataFrame([(1, 2, "r")], "src long, dst long, relation string"))
    assert left.count() == 1 and {r["vid"] for r in kept.collect()} == {2, 3, 9}


def test_versions_and_upserts(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "vid long, name string")
    new = spark.createDataFrame([(2, "c", 5), (2, "d", 6), (3, "e", 1)], "vid long, name string, write_seq long")
    state = store.upsert(old, new, ["vid"]).drop("write_seq")
    path = str(tmp_path / "t")
    assert store.save_version(old, path) == 1 and store.save_version(state, path) == 2
    assert {tuple(r) for r in store.load_version(spark, path).collect()} == {(1, "a"), (2, "d"), (3, "e")}
    assert store.load_version(spark, path, 1).count() == 2


def test_splitter():
    whole = "para one. " * 50 + "\n\n" + "para two. " * 90 + "\n\n" + "x" * 1000
    got = chunking.split_text(whole)
    assert all(0 < len(c) <= 800 for c in got) and sum(c.count("x") for c in got) >= 1000
    assert chunking.split_text("short") == ["short"] and chunking.split_text("") == []


def test_fixed_chunks_cover_the_text(spark):
    t = "".join(chr(97 + i % 26) for i in range(2000))
    rows = chunking.fixed(spark.createDataFrame([(1, t), (2, "")], "doc_id long, text string")).orderBy("seq").collect()
    assert [r["text"] for r in rows] == [t[i : i + 800] for i in range(0, 1900, 700)]


def test_packer_emits_over_full_packs_whole(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a b", "c d", "e", "f g h i j", "k"])], "g long, o long, text string")
    assert [r["text"] for r in chunking.packed(rows, "g", "o", 3).orderBy("pack").collect()] == ["a b c d", "e f g h i j", "k"]


def test_loaders(spark, tmp_path):
    import json

    hop = [{"question": "q1", "answer": "a1", "type": "x", "context": [["T", ["s1 ", "s2"]], ["U", []]]}, {"question": "q2", "answer": "a2", "type": "y", "context": [["T", ["other"]], ["V", "plain"]]}]
    (tmp_path / "hotpot.json").write_text(json.dumps(hop))
    path = str(tmp_path / "hotpot.json")
    got = datasets.load(spark, "HotpotQA", path).orderBy("q_id").collect()
    assert [(r["question"], r["answers"]) for r in got] == [("q1", ["a1"]), ("q2", ["a2"])] and got[0]["text"].startswith("T: s1 s2")
    assert [r["question"] for r in datasets.read_multihop(spark, path, q_type="y").collect()] == ["q2"]
    assert {(r["title"], r["body"]) for r in datasets.read_corpus(spark, path).collect()} == {("T", "s1 s2"), ("V", "plain")}
    two = [{"specific_question": "q", "ground_truth": ["g"], "phase_1_data": ["a", "b"], "phase_2_data": ["c"]}]
    (tmp_path / "specific.json").write_text(json.dumps(two))
    assert datasets.read_two_phase(spark, str(tmp_path / "specific.json")).first()["text"] == "a\n\nb"
    assert datasets.read_two_phase(spark, str(tmp_path / "specific.json"), update=True).first()["text"] == "c"
    with pytest.raises(ValueError):
        datasets.load(spark, "nothing", path)


def test_top_k_ties_go_to_the_smaller_key(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "q_id long, qvec array<double>")
    c = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0])], "chunk_id string, vec array<double>")
    assert [(r["chunk_id"], r["score"]) for r in vector_search.top_k(q, c, 3).orderBy("rank").collect()] == [("a", 1.0), ("b", 1.0), ("z", 0.0)]


def test_hashed_embedding_is_normalised(spark):
    v = one(spark, vector.hashed_embedding(F.col("x")), "x string", "a b b c")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and sum(one(spark, vector.hashed_embedding(F.col("x")), "x string", "")) == 0


def test_pairs_by_value(spark, monkeypatch):
    """A score is worked out once for two values of a group, also where a group is dealt out in blocks; null groups have no pairs, null values have."""
    draw = random.Random(3)
    rows = [(k, draw.choice(["x", "yy", "zzz", None]), draw.choice(["g", "h", None])) for k in range(120)]
    table = spark.createDataFrame(rows, "k long, v string, g string")
    expect = sorted((a, b, len(v or "") * 10 + len(w or "")) for a, v, g in rows for b, w, h in rows if g is not None and g == h and a < b)
    size = lambda v: F.length(F.coalesce(v, F.lit("")))
    done = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def score(x, y):
        done.add(1)
        return x * 10 + y

    got = pairs.valued_pairs(table, "k", "v", ["g"], size, score, "s")
    assert sorted(map(tuple, got.collect())) == expect and done.value <= 2 * 16
    monkeypatch.setattr(pairs, "BLOCK", 7)
    assert sorted(map(tuple, got.collect())) == expect
    assert sorted(map(tuple, pairs.valued_pairs(table, "k", "v", ["g"], size, lambda x, y: x * 10 + y, "s").collect())) == expect
    kept = pairs.valued_pairs(table, "k", "v", ["g"], size, lambda x, y: x == y, "s", keep=True)
    assert sorted((r["a"], r["b"]) for r in kept.collect()) == [(a, b) for a, b, s in expect if s // 10 == s % 10]


def test_fact_weights_that_add_up_to_nothing(spark):
    facts = spark.createDataFrame([(1, 2, 3, 0.0), (2, 2, 3, 0.5)], "q_id long, subj_uid long, obj_uid long, score double")
    nodes = spark.createDataFrame([(2, 1), (3, 1)], "uid long, ref_count long")
    got = {(r["q_id"], r["uid"]): r["weight"] for r in ranking.fact_weights(facts, nodes).collect()}
    assert got[2, 2] == got[2, 3] == 0.5 and all(got[1, u] != got[1, u] for u in (2, 3)), "0 / 0 is no number, as in the SQL"


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    return [x for x in plan.splitlines() if "Exchange" in x and "hashpartitioning" in x]


def test_what_is_made_of_a_chunk_stays_where_it_is(spark, tmp_path):
    """Shuffle: orders and line items are dealt out by chunk, and edges, mentions and what is made of both for a chunk are not dealt out again."""
    draw = random.Random(2)
    spark.createDataFrame([(i, draw.randrange(5)) for i in range(20)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(draw.randrange(20), draw.randrange(6), draw.randrange(3)) for _ in range(90)], "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    e, m = fixtures.kg_edges(spark, str(tmp_path)), fixtures.kg_mentions(spark, str(tmp_path))
    assert all("source_chunk" in x for x in exchanges(e)) and len(exchanges(e)) == 2
    assert all("source_chunk" in x or "chunk_id" in x for x in exchanges(graph.merge_edges(e.unionAll(e))))
    assert e.count() == e.distinct().count() and fixtures.kg_edges(spark, str(tmp_path), repeated=True).distinct().exceptAll(e).count() == 0
    assert {tuple(r) for r in m.collect()} == {(r["source_chunk"], u) for r in e.collect() for u in (r["src"], r["dst"])}


def test_paths_of_few_or_many_nodes(spark, monkeypatch):
    """A subject with `limit` short paths isn't followed further; nodes that are too many to be broadcast give the same."""
    draw = random.Random(7)
    edges = spark.createDataFrame([(draw.randrange(12), 20 + draw.randrange(9), draw.choice("rs")) for _ in range(60)] + [(99, 20, "r")], "src long, dst long, relation string")
    seeds = spark.createDataFrame([(1,), (2,), (99,)], "uid long")
    every = sorted(map(tuple, graph.paths(seeds, edges, 2).collect()))
    expect = [x for u in (1, 2, 99) for x in sorted((x for x in every if x[0] == u), key=lambda x: (x[2], x[1]))[:3]]
    assert {x[2] for x in expect if x[0] == 99} == {1, 2} and {x[2] for x in expect if x[0] == 1} == {1}
    for few in (10**6, 0):
        monkeypatch.setattr(graph, "FEW", few)
        assert sorted(map(tuple, graph.paths(seeds, edges, 2, limit=3).collect())) == sorted(expect)


def test_nodes_are_counted_apart(spark):
    rows = [("c1", None, "", "t", "", 1), ("c2", None, "n", "", "", 2), ("", 5, "m", "t", "d", 3), ("c1", 5, "k", "t", "", 1), ("c1", 5, "k", "t", "", 1)]
    got = {r["uid"]: tuple(r)[1:] for r in graph.merge_nodes(spark.createDataFrame(rows, "chunk_id string, uid long, name string, type string, desc string, seq long")).collect()}
    assert got == {None: ("n", "t", "", ["c1", "c2"], 2), 5: ("k", "t", "d", ["c1"], 1)}


def test_upsert_of_keys_alone_sorts_nothing(spark):
    old, new = spark.createDataFrame([(1, "a")], "k long, r string"), spark.createDataFrame([(1, "a", 3), (2, "b", 1), (2, "b", 4)], "k long, r string, write_seq long")
    got = store.upsert(old, new, ["k", "r"])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 3), (2, "b", 4)]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_walks_of_few_or_many_questions(spark, small_graph, monkeypatch):
    """Edges are dealt out by node only where a frontier is too large to be broadcast; both ways give the same."""
    mentions, edges, seeds, near = small_graph
    dealt = []
    steps = walk.steps
    monkeypatch.setattr(walk, "steps", lambda e: dealt.append(1) or steps(e))
    got = []
    for few in (walk.FEW, 0):
        monkeypatch.setattr(walk, "FEW", few)
        got.append([sorted(map(tuple, x.collect())) for x in walk.beam_walk(seeds, mentions, edges, near)])
        assert len(dealt) == (few == 0)
    assert got[0] == got[1] and got[0][1] == [(1, "e", 1, 1.0), (1, "e", 2, 0.5), (1, "e", 3, 0.25)]


def test_neighbouring_questions_share_a_block(spark):
    """Work of the walk without a beam: questions of parts of a graph that don't meet are not put into blocks that reach all parts."""
    got = walk._numbered(spark.range(400).select((F.col("id") * 7 % 400).alias("q_id")), 16).collect()
    blocks = defaultdict(list)
    for r in got:
        blocks[r["b"]].append((r["i"], r["q_id"]))
    assert len(got) == 400 and len(blocks) <= 400 // 16 + 4
    for own in blocks.values():
        assert [i for i, _ in sorted(own)] == list(range(len(own))) and len(own) <= 16
        assert max(q for _, q in own) - min(q for _, q in own) == len(own) - 1


def test_bounds_go_to_the_rows(spark):
    """Shuffle: scores of all pairs are scaled without being dealt out by question."""
    df = spark.createDataFrame([(1, 0.2), (1, 0.6), (1, -0.2), (2, -1.0), (3, 0.4), (None, 0.5), (None, 1.0)], "q_id long, score double")
    got = ranking.minmax_of_many(df, "score", "n")
    assert sorted(map(str, got.collect())) == sorted(map(str, ranking.minmax(df, "score", "n").collect()))
    assert len(exchanges(got)) == 1, "that of the bounds"
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
