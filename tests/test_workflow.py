from pyspark.sql import functions as F

from docmill.operators import chunk, workflow
from tests.test_domain import corpus  # noqa: F401


def test_review_keeps_originals_and_reparses(spark):
    f = spark.createDataFrame([("a", "5", 5.0, None, None, 0.4, "needs_review"), ("b", "x", None, None, None, 0.4, "needs_review"), ("c", "y", None, None, None, 0.4, "needs_review"), ("d", "z", None, None, None, 0.4, "needs_review")], "field_id string, value_text string, value double, iso string, original_value_text string, confidence double, status string")
    d = spark.createDataFrame([("a", "correct", "1,234.5"), ("b", "confirm", None), ("c", "reject", None), ("d", "correct", " ")], "field_id string, decision string, new_value string")
    got = {r["field_id"]: r for r in workflow.review_fields(f, d).collect()}
    assert (got["a"]["value"], got["a"]["value_text"], got["a"]["original_value_text"], got["a"]["status"]) == (1234.5, "1,234.5", "5", "verified")
    assert [got[k]["status"] for k in "bcd"] == ["verified", "rejected", "needs_review"]


def test_ask_and_cache(spark, corpus):  # noqa: F811
    docs, fields, e, r = corpus
    q = spark.createDataFrame([(1, "What are the proved reserves of Jhanjra?"), (2, "Who won the football match?")], "question_id long, question string")
    c = chunk.embed(spark.createDataFrame([(1, "d1", 1, "Overburden removal at the pit")], "chunk_id long, document_id string, page_no int, text string"))
    p = chunk.embed(spark.createDataFrame([(9, "verified", None, "who won the football match", "They did [[c:1]].", 0.9, 0)], "qa_id long, status string, owner string, question string, answer string, confidence double, hit_count int"), text_col="question")
    a = {x["question_id"]: x for x in workflow.ask(q, e, r, fields, docs, c, p).collect()}
    assert (a[1]["mode"], a[1]["status"]) == ("rag", "answered") and (a[2]["mode"], a[2]["qa_id"]) == ("cache", 9)
    none = workflow.ask(q, e, r, fields, docs, c, p.where("qa_id = 0"))
    assert none.where("question_id = 2").first()["status"] == "insufficient"
    assert workflow.bump_hits(p, spark.createDataFrame([("cache", 9)], "mode string, qa_id long")).first()["hit_count"] == 1


def test_pairs_and_load(spark):
    f = spark.createDataFrame([("s", [("d1", "proved", 100.0, "2021"), ("d2", "proved", 110.0, "2023"), ("d1", "zero", 0.0, None)])], "signature string, evidence array<struct<document_id:string,category:string,value:double,as_on:string>>")
    g = {r["category"]: r for r in workflow.evidence_pairs(f).collect()}
    assert abs(g["proved"]["change"] - 0.1) < 1e-9 and g["zero"]["change"] is None and g["zero"]["scale"] == 110.0
    c = spark.range(1, 101).select(F.col("id").cast("double").alias("ms"), (F.col("id") != 7).alias("ok"))
    r = workflow.load_summary(c, 10).first()
    assert (r["per_second"], r["p95"], r["errors"]) == (10.0, 95.0, 1)
