"""Extraction and the multi-step loop on rows that can be followed by hand."""

import duckdb
from pyspark.sql import functions as F

from tidegraph.operators import answer, ingest


def test_rules_link_neighbours(spark):
    c = spark.createDataFrame([("c1", 'Then "Ada" met Ada, Babbage. of It'), ("c2", ""), ("c3", "lower only")], "chunk_id string, text string")
    got = {r["chunk_id"]: r for r in ingest.rule_extractor(c).collect()}
    assert [e["id"] for e in got["c1"]["entities"]] == ["Then", "Ada", "Babbage"]
    assert [(r["src"], r["tgt"]) for r in got["c1"]["relations"]] == [("Then", "Ada"), ("Ada", "Babbage")]
    assert got["c2"]["entities"] == [] and got["c3"]["relations"] == []
    mentions, edges = ingest.build(c)
    assert mentions.count() == 3 and edges.count() == 2


def test_loop_ends_on_repeats_unknowns_and_steps(spark):
    q = spark.createDataFrame([(1, "Who met Ada?"), (2, "nothing known here")], "q_id long, question string")
    context = spark.createDataFrame([(1, "Ada met Babbage. Babbage built an Engine", 1), (2, "unrelated words", 1)], "q_id long, text string, rank long")
    got = sorted((r["q_id"], r["step"], r["question"], r["answer"]) for r in answer.agentic(q, lambda x: context.join(x.select("q_id"), "q_id", "left_semi"), 5).collect())
    assert got[0] == (1, 1, "Who met Ada?", "Ada met Babbage")
    assert got[1][2] == "What is Babbage?" and got[-1] == (2, 1, "nothing known here", answer.UNKNOWN)
    assert len({g[2] for g in got}) == len(got)


def test_cached_answers(spark):
    p = spark.createDataFrame([("a",), ("b",)], "prompt string")
    cache = p.where("prompt = 'a'").select(F.md5("prompt").alias("key"), F.lit("x").alias("response"))
    assert {(r["prompt"], r["response"]) for r in ingest.answered_before(p, cache).collect()} == {("a", "x"), ("b", None)}


def test_rows_that_share_a_doc_id(spark, tmp_path):
    """Chunks whose ids are equal are counted once each, as the SQL counts them."""
    from tidegraph.plans import agents, catalogue

    rows = [(1, "Ada met Bob. Ada left."), (1, "Ada met Cyd."), (2, "Dan " * 400), (2, "Dan " * 400), (3, "nobody")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = agents.ingest_graph(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalogue.oracle_sql()["ingest_graph"]).fetchall()) == [(1, 3, 4), (2, 1, 6)]
