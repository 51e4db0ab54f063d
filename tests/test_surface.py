"""Models behind columns, lookups, loaders, tiers and drivers on rows that can be followed by hand."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidegraph.functions import parsing, vector
from tidegraph.operators import answer, cache, fetch, graph, ingest, models, retrieve, store
from tidegraph.sources import datasets
from tidegraph.streaming import access


class Upper:
    def complete(self, prompts):
        if any(p == "bad" for p in prompts):
            raise RuntimeError
        return [p.upper() for p in prompts]

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def score(self, questions, texts):
        return [float(len(set(q.split()) & set(t.split()))) for q, t in zip(questions, texts, strict=True)]


def test_calls_are_repeated_with_growing_waits():
    tries = []

    def flaky(x):
        tries.append(x)
        if len(tries) < 3:
            raise RuntimeError
        return x

    assert models.with_retries(flaky, 7, wait=0) == 7 and len(tries) == 3
    assert models.with_retries(lambda: 1 / 0, retries=2, wait=0) is None


def test_models_see_each_input_once(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "bad"), (4, None)], "id long, p string")
    got, known = models.completed(df.where("p is not null"), "p", Upper(), batch=1, retries=1)
    assert {(r["id"], r["response"]) for r in got.collect()} == {(1, "AB"), (2, "AB"), (3, None)} and known.count() == 1
    again, known = models.completed(df.where("id < 3"), "p", None or Upper(), spark.createDataFrame([(r["key"], "kept") for r in known.collect()], "key string, response string"))
    assert {r["response"] for r in again.collect()} == {"kept"} and known.count() == 1
    vecs = models.embedded(df.where("id < 3"), "p", Upper())
    assert [r["vec"] for r in vecs.collect()] == [[2.0, 1.0]] * 2
    pairs = spark.createDataFrame([(1, "a", 1, "x y", "x"), (1, "b", 2, "x y", "x y"), (1, "c", 3, "x y", "z")], "q_id long, chunk_id string, o long, question string, text string")
    best = models.reranked(pairs, Upper(), 2).orderBy("rank").collect()
    assert [r["chunk_id"] for r in best] == ["b", "a"] and abs(best[1]["rerank_score"] - 1 / (1 + 2.718281828459045**-1)) < 1e-9


def test_prompts_and_rewrites(spark):
    df = spark.createDataFrame([("who?", "abc", "longer")], "q string, a string, b string")
    r = df.select(models.ask("question_entities", question=F.col("q")).alias("p"), models.rewritten(F.col("q"), F.col("a")).alias("a"), models.rewritten(F.col("q"), F.col("b")).alias("b")).first()
    assert r["p"].endswith("Question: who?") and '{"entities"' in r["p"] and (r["a"], r["b"]) == ("who?", "longer")
    assert set(models.TEMPLATES) == {"extract", "question_entities", "answer", "first_step", "next_step", "rewrite", "judge"}


def test_lookups(spark):
    chunks = spark.createDataFrame([("a", "ta"), ("b", "tb")], "chunk_id string, text string")
    lists = spark.createDataFrame([(1, ["b", "x", "a", "b"]), (2, [])], "q_id long, ids array<string>")
    assert {r["q_id"]: r["texts"] for r in fetch.texts_in_order(lists, chunks).collect()} == {1: ["tb", "", "ta", "tb"], 2: []}
    r = fetch.chunk_parts(spark.createDataFrame([("zz",)], "chunk_id string"), chunks).first()
    assert (r["text"], r["ts"], r["entity_uids"], r["entities"], r["relations"]) == ("", "", [], [], [])
    assert fetch.one(chunks, "chunk_id", "b", ["text"]).collect()[0]["text"] == "tb"


def test_query_entities(spark):
    got = spark.createDataFrame([('{"entities":[{"id":" A ","type":"t","desc":"d"},{"name":"B"},"C",{"id":""}]}',), ("no",)], "x string").select(parsing.query_entities(F.col("x")).alias("e")).collect()
    assert [tuple(e) for e in got[0]["e"]] == [("A", "t", "d"), ("B", "", ""), ("C", "", "")] and got[1]["e"] == []


def test_noise_loaders(spark, tmp_path):
    rows = [{"query": "q1", "answer": ["a"], "positive": ["p1", "p2"], "negative": ["n1"]}, {"query": "q2", "answer": ["b"], "positive": ["p3"], "negative": ["n2", "n3"]}]
    (tmp_path / "rgb_en.json").write_text(json.dumps(rows[0], indent=1) + "\n" + json.dumps(rows[1]) + "\n")
    path = str(tmp_path / "rgb_en.json")
    assert [r["text"] for r in datasets.read_noise(spark, path).orderBy("q_id").collect()] == ["p1\n\np2", "p3"]
    assert [r["text"] for r in datasets.read_noise(spark, path, "_fact").orderBy("q_id").collect()] == ["p1\n\np2\n\nn1", "p3\n\nn2\n\nn3"]
    refined = datasets.read_noise(spark, path, "_refine").orderBy("q_id").collect()
    assert [r["text"] for r in refined] == ["p1", "p2", "n1", "p3", "n2", "n3"] and [r["question"] for r in refined] == ["q1", "q2", None, None, None, None]
    cut = datasets.load(spark, "rgb_refine", path, 1, 2, variant="_refine").orderBy("q_id").collect()
    assert [r["text"] for r in cut] == ["p1", "p2", "n1", "p3", "n2", "n3"] and [r["question"] for r in cut][:3] == [None, "q2", None]
    (tmp_path / "int.json").write_text(json.dumps({"query": "q", "answer": [["a"]], "positive": [["x y", "z"], ["u v w"]], "negative": []}))
    assert datasets.read_noise(spark, str(tmp_path / "int.json"), "_int", pack=2).first()["text"] == "x y z\n\nu v w"
    corpus = datasets.load_corpus(spark, "rgb", path)
    assert {r["body"] for r in corpus.collect()} == {"p1\n\np2", "p3"}
    (tmp_path / "specific.json").write_text(json.dumps([{"specific_question": "q", "phase_1_data": ["a"]}]))
    with pytest.raises(ValueError):
        datasets.load(spark, "specific", str(tmp_path / "specific.json"))


@pytest.mark.parametrize("rate,total,variant,right,expect", [
    (0.4, 5, "", 0.0, {"positive": ["p0", "p1", "p2"], "negative": ["n0", "n1"]}), (1.0, 2, "", 0.0, {"positive": [], "negative": ["n0", "n1"]}),
    (0.8, 5, "", 0.0, {"positive": ["p0", "p1"], "negative": ["n0", "n1", "n2"]}), (0.0, 6, "", 0.0, {"positive": ["p0", "p1", "p2", "p3"], "negative": ["n0", "n1"]}),
])
def test_noise_mixer(spark, rate, total, variant, right, expect):
    rows = [(1, "positive", i, f"p{i}") for i in range(4)] + [(1, "negative", i, f"n{i}") for i in range(3)]
    got = datasets.noise_mix(spark.createDataFrame(rows, "q_id long, kind string, pos long, text string"), rate, total, variant=variant, correct_rate=right).collect()
    assert {k: sorted(r["text"] for r in got if r["kind"] == k) for k in expect} == expect


def test_noise_variants(spark):
    rows = [(1, "positive", 0, "a0"), (1, "positive", 0, "b0"), (1, "positive", 1, "a1"), (1, "positive", 2, "a2")] + [(1, "negative", i, f"n{i}") for i in range(9)]
    mixed = lambda n, rate: sorted(r["text"] for r in datasets.noise_mix(spark.createDataFrame(rows, "q_id long, kind string, pos long, text string"), rate, n, variant="_int").collect())
    assert mixed(4, 0.25) == ["a0", "a1", "b0", "n0"] and mixed(3, 1.0) == ["a0", "b0", "n0"]
    fact = [(1, k, i, f"{k}{i}") for k in ("positive", "positive_wrong") for i in range(5)] + [(1, "negative", i, f"n{i}") for i in range(5)]
    got = datasets.noise_mix(spark.createDataFrame(fact, "q_id long, kind string, pos long, text string"), 0.2, 5, variant="_fact", correct_rate=0.4).collect()
    wrong, good = ({r["text"][-1] for r in got if r["kind"] == k} for k in ("positive_wrong", "positive"))
    assert len(wrong) == 2 and len(good) == 2 and not wrong & good and [r["text"] for r in got if r["kind"] == "negative"] == ["n0"]


def test_settings_and_numbering(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("# x\na: 1\nstore:\n  path: '/p' # here\n  deep:\n    k: v\nb: two\n")
    assert datasets.read_settings(spark, str(tmp_path / "c.yaml")) == {"a": "1", "store.path": "/p", "store.deep.k": "v", "b": "two"}
    rows = datasets._numbered(spark.range(0, 50, 1, 7).select(F.col("id").alias("x")), None).collect()
    assert all(r["x"] == r["q_id"] for r in rows)


def test_aligned_graph(spark):
    got = spark.createDataFrame([("c", [("A", "t", "old"), ("A", "t", "new"), ("B", "t", "")], [("A", "B", "r"), ("A", "Z", "r"), ("A", "B", "")])], "chunk_id string, entities array<struct<id:string,type:string,desc:string>>, relations array<struct<src:string,tgt:string,rel:string>>")
    uids = spark.createDataFrame([("A", "t", "new", 1), ("A", "t", "old", 9), ("B", "t", "", 2)], "name string, type string, desc string, uid long")
    mentions, edges = ingest.aligned_graph(got, uids)
    assert {(r["uid"], r["name"]) for r in mentions.collect()} == {(1, "A"), (2, "B")}
    assert [(r["src"], r["dst"], r["relation"]) for r in edges.collect()] == [(1, 2, "r")]
    assert ingest.facts(edges).first()["fact_text"] == "A r B"
    meta = ingest.graph_meta(mentions, edges).first()
    assert meta["entity_uids"] == [1, 2] and len(meta["graph_meta"]["relations"]) == 1


def test_batches_meet_the_index_of_the_one_before(spark):
    chunks = spark.createDataFrame([("c1", "Ada met Babbage"), ("c2", "Ada built Engine")], "chunk_id string, text string")
    empty = spark.createDataFrame([], "uid bigint, name string, type string, desc string, vec array<double>")
    m1, _, index = ingest.index_batch(chunks.where("chunk_id = 'c1'"), empty, vector.hashed_embedding)
    m2, e2, index2 = ingest.index_batch(chunks.where("chunk_id = 'c2'"), index, vector.hashed_embedding)
    uid = lambda m: {r["name"]: r["uid"] for r in m.collect()}
    assert uid(m1)["Ada"] == uid(m2)["Ada"] and index.count() == 2 and index2.count() == 3 and e2.where("relation = 'NEXT_TO'").count() == 1


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, "n", "t", "d", [1.0])], "uid long, name string, type string, desc string, vec array<double>")
    for _ in range(2):
        store.append_entities(str(tmp_path / "i"), e)
    assert spark.read.parquet(str(tmp_path / "i")).count() == 1
    f = spark.createDataFrame([("a r b", "a", "b", "r", "c", 1, 2, [0.5])], "fact_text string, subj_name string, obj_name string, relation string, chunk_id string, subj_uid long, obj_uid long, vec array<double>")
    store.append_facts(f, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).first()["pk"] is not None
    with pytest.raises(Exception):
        store.merge_results(spark, [str(tmp_path / "none.json")], "a long").count()


def test_answers_are_kept_by_question_and_chunks(spark):
    q = spark.createDataFrame([(1, "who met Ada"), (2, "who met Ada"), (3, "other")], "q_id long, question string")
    c = spark.createDataFrame([(i, k, t, n) for i in (1, 2) for n, (k, t) in enumerate([("a", "Ada met Bob"), ("b", "rain")])], "q_id long, chunk_id string, text string, rank long")
    empty = spark.createDataFrame([], "key string, answer string")
    got, kept = answer.cached_answers(q, c, empty)
    assert {r["q_id"]: r["answer"] for r in got.collect()} == {1: "Ada met Bob", 2: "Ada met Bob", 3: answer.UNKNOWN} and kept.count() == 2
    from_cache, _ = answer.cached_answers(q, c, kept, lambda a, b: a.select("q_id", F.lit("asked again").alias("answer")))
    assert "asked again" not in {r["answer"] for r in from_cache.collect()}


def at(s):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_node_limit_and_counters(spark):
    state = spark.createDataFrame([(c, at(0), at(i), 1) for i, c in enumerate("abcd")], "chunk_id string, created_at timestamp, last_access timestamp, hits long")
    mentions = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3), ("d", 4), ("d", 1)], "chunk_id string, uid long")
    left = lambda n: {r["chunk_id"] for r in cache.prune(state, F.lit(at(9)), 0, 9, mentions, n).collect()}
    assert left(4) == set("abcd") and left(3) == set("cd") and left(2) == {"d"} and left(1) == set()
    hits = spark.createDataFrame([(q, 1) for q in range(7)] + [(0, 2)], "q_id long, uid long")
    assert {r["uid"]: (r["promotions"], r["left"]) for r in cache.entity_counters(hits).collect()} == {1: (2, 1), 2: (0, 1)}
    assert cache.capacity(5, 9) == 5 and cache.capacity(5, 9, grow=True) == 9
    assert [r["chunk_id"] for r in cache.first_residents(state, 2).collect()] == ["d", "c"]


def test_subgraphs_are_written_latest_wins(spark):
    mentions = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 2)], "chunk_id string, uid long")
    edges = spark.createDataFrame([(1, 2, "r", "c1"), (2, 2, "r", "c2")], "src long, dst long, relation string, source_chunk string")
    old_v, old_e = spark.createDataFrame([(2, "c0"), (9, "c9")], "vid long, source_chunk string"), spark.createDataFrame([(1, 2, "r", "c0")], edges.schema)
    v, e, n = cache.write_subgraphs(spark.createDataFrame([("c1",)], "chunk_id string"), mentions, edges, old_v, old_e)
    assert {tuple(r) for r in v.collect()} == {(1, "c1"), (2, "c1,c2"), (9, "c9")} and {r["source_chunk"] for r in e.collect()} == {"c1"}
    assert tuple(n.first()) == (1, 2, 1)
    v, e = cache.write_entities(spark.createDataFrame([(1,)], "uid long"), edges, old_v, old_e)
    assert {tuple(r) for r in v.collect()} == {(1, ""), (2, ""), (9, "c9")} and e.count() == 1


def test_kept_candidates_come_last(spark):
    c = spark.createDataFrame([(1, f"c{i}", i, "x y", t) for i, t in enumerate(["x", "z", "x y", "y z"], 1)], "q_id long, chunk_id string, rank long, question string, text string")
    keep = c.where("chunk_id in ('c2', 'c1')")
    assert [r["chunk_id"] for r in retrieve.rerank_others(c, keep, 3).orderBy("rank").collect()] == ["c3", "c1", "c2"]
    assert [r["chunk_id"] for r in retrieve.rerank_others(c, c, 3).orderBy("rank").collect()] == ["c1", "c2", "c3"]


def test_paths_are_cut_by_length_then_text(spark):
    edges = spark.createDataFrame([(1, i, "r", "c") for i in range(2, 6)], "src long, dst long, relation string, source_chunk string")
    got = graph.paths(spark.createDataFrame([(1,)], "uid long"), edges, 2, limit=3).collect()
    assert sorted(r["path"] for r in got) == ["1 -r-> 2", "1 -r-> 3", "1 -r-> 4"]


def test_stream_driver_and_pruner(spark, tmp_path):
    seen = []
    done = access.driven(5, lambda n: seen.append(("in", n)), lambda n: seen.append(("qa", n)), odd_only=True, noise=lambda n: seen.append(("noise", n)))
    assert done == [1, 3, 5] and ("noise", 2) in seen and ("qa", 2) not in seen and len(seen) == 10
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(f"c{i}", at(i), i) for i in range(6)]
    spark.createDataFrame(rows, "chunk_id string, ts timestamp, event_id long").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("chunk_id string, ts timestamp, event_id long").parquet(src)
    access.pruned(stream, out, F.lit(at(10)), 0, 4)
    assert {r["chunk_id"] for r in spark.read.parquet(f"{out}/version=1").collect()} == {"c2", "c3", "c4", "c5"}


def test_chunk_parts_as_counts(spark):
    meta = "struct<entities:array<struct<uid:bigint,name:string,type:string,desc:string>>,relations:array<struct<src_uid:bigint,tgt_uid:bigint,relation:string>>>"
    rows = [("a", "x", "t", [1, 2], ([(1, "n", "t", "d")], []), 7), ("b", None, None, None, None, 8)]
    chunks = spark.createDataFrame(rows, f"chunk_id string, text string, ts string, entity_uids array<bigint>, graph_meta {meta}, pk bigint")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string")
    got = {r[0]: tuple(r)[1:] for r in fetch.chunk_parts(ids, chunks, counts=True, keep=("pk",)).collect()}
    assert got == {"a": ("x", "t", 2, 1, 0, 7), "b": ("", "", 0, 0, 0, 8), "c": ("", "", 0, 0, 0, None)}
