"""Extraction, graph, anomalies, retrieval, topics, audit and reports on small domain fixtures."""

import datetime as dt
import json
import re

import pytest
from pyspark.sql import functions as F

from docmill.operators import anomalies, audit, chunk, extract, graph, metrics, relational, reports, retrieval, topics
from docmill.operators.classify import classify
from docmill.sources import files

RESERVE = """Eastern Coalfields Limited
Geological Reserve Status Report
Mine : Jhanjra Underground Project   Block : Jhanjra Block-II
Principal Seam : R-VII
Average Grade : G6
Reserves as on : 01.04.2021
Proved reserve 182.40 million tonnes
Indicated reserve 64.10 million tonnes
Inferred reserve 21.70 million tonnes
Total geological reserve 268.20 million tonnes
"""


def pages_of(spark, rows):
    """rows: (document_id, doc_type, text, source_kind)."""
    schema = "document_id string, doc_type string, page_no int, text string, source_kind string, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double,ocr_conf:double>>"
    return spark.createDataFrame([(d, t, 1, x, k, []) for d, t, x, k in rows], schema)


def test_classify(spark):
    texts = [RESERVE, "Lok Sabha starred question no. 312 to be answered on 01.02.2024", "Monthly production MIS statement, OB removal", "Safety inspection note. Risk rating: high", "Borehole log: collar RL 210, core recovery 92 %", "nothing here"]
    got = [r["doc_type"] for r in classify(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()]
    assert got == ["geological_reserve_status", "parliamentary_qa_response", "monthly_production_mis", "inspection_report", "borehole_log_summary", "unknown"]


def test_extraction(spark):
    f = {r["field_key"]: r for r in extract.extract_fields(pages_of(spark, [("d", "geological_reserve_status", RESERVE, "text")]), this_year=2026).where("extractor like 'rule:%'").collect()}
    assert [f[k]["value"] for k in ("proved_reserve", "indicated_reserve", "inferred_reserve", "total_geological_reserve")] == [182.4, 64.1, 21.7, 268.2]
    assert (f["principal_seam"]["value_text"], f["average_grade"]["value_text"], f["reserves_as_on"]["iso"]) == ("R-VII", "G6", "2021-04-01")
    assert f["mine_name"]["value_text"] == "Jhanjra Underground Project"
    assert f["proved_reserve"]["status"] == "auto_accepted"


def test_recognised_text_scores_lower(spark):
    get = lambda kind: extract.extract_by_rules(pages_of(spark, [("d", "geological_reserve_status", RESERVE, kind)])).where("field_key = 'proved_reserve'").first()["confidence"]
    assert get("ocr") < get("text")


def test_sum_check_lowers_confidence(spark):
    bad = RESERVE.replace("268.20", "300.00")
    f = extract.extract_fields(pages_of(spark, [("d", "geological_reserve_status", bad, "text")]), this_year=2026).where("field_key = 'proved_reserve'").first()
    assert f["confidence"] == round(0.93 * 0.8, 3) and f["status"] == "needs_review" and f["notes"]


def test_mentions(spark):
    m = {(r["field_key"], r["value_text"]) for r in extract.extract_mentions(pages_of(spark, [("d", "x", "Seam III at BH-12/A of ECL, grade G6 g6\nMine : Gevra OCP Date : 1", "text")])).collect()}
    assert {("mention_seam", "Seam III"), ("mention_borehole_id", "BH-12/A"), ("mention_subsidiary", "ECL"), ("mention_grade", "G6"), ("mention_mine", "Gevra OCP")} <= m


@pytest.fixture
def corpus(spark):
    docs = spark.createDataFrame([("d1", "geological_reserve_status", dt.date(2021, 4, 1), None, 1, "a.pdf"), ("d2", "geological_reserve_status", dt.date(2023, 4, 1), None, 2, "b.pdf")], "document_id string, doc_type string, doc_date date, subsidiary_id string, created_at int, filename string")
    rows = []
    for d, day, proved in (("d1", "2021-04-01", 182.4), ("d2", "2023-04-01", 176.5)):
        total = proved + 64.1 + 21.7
        for k, v, iso in (("mine_name", "Jhanjra Underground Project", None), ("block_name", "Jhanjra Block-II", None), ("principal_seam", "R-VII", None), ("average_grade", "G6", None), ("reserves_as_on", day, day)):
            rows.append((f"{d}:{k}", d, k, v, None, None, iso, 0.9, 1, "auto_accepted", k))
        for k, v in (("proved_reserve", proved), ("indicated_reserve", 64.1), ("inferred_reserve", 21.7), ("total_geological_reserve", total)):
            rows.append((f"{d}:{k}", d, k, str(v), v, "million_tonnes", None, 0.93, 1, "auto_accepted", k))
    rows.append(("d1:x", "d1", "mention_mine", "Elsewhere", None, None, None, 0.55, 1, "needs_review", "x"))
    fields = spark.createDataFrame(rows, "field_id string, document_id string, field_key string, value_text string, value double, unit string, iso string, confidence double, page_no int, status string, source_snippet string")
    e, r = graph.build_graph(docs, fields)
    return docs, fields, e.cache(), r.cache()


def test_graph(corpus):
    docs, fields, e, r = corpus
    kinds = {x["kind"]: x["count"] for x in e.groupBy("kind").count().collect()}
    assert kinds == {"report": 2, "mine": 1, "block": 1, "seam": 1, "mineral": 1, "reserve": 8}
    assert r.where("predicate = 'has_reserve'").count() == 8
    assert {str(x["valid_from"]) for x in r.where("predicate = 'has_reserve'").collect()} == {"2021-04-01", "2023-04-01"}
    again = graph.build_graph(docs, fields)
    assert sorted(x["id"] for x in again[0].collect()) == sorted(x["id"] for x in e.collect())
    assert e.where("name = 'Elsewhere'").count() == 0
    block = e.where("kind = 'block'").select("id")
    assert graph.neighbours(r, e.select("id", "kind"), block, ["has_reserve"], dt.date(2022, 1, 1)).count() == 4
    assert graph.touched(r.where("document_id = 'd1'"), e).count() >= 6


def test_revision_not_contradiction_and_merge_is_idempotent(spark, corpus):
    _, _, e, r = corpus
    found = anomalies.detect(anomalies.facts(e, r)).cache()
    assert [x["kind"] for x in found.collect()] == ["revision"]
    assert "182.4" in found.first()["detail"] and "176.5" in found.first()["detail"]
    empty = spark.createDataFrame([], "signature string, status string, detail string")
    first = anomalies.merge(empty, found, ["detail"])
    assert [x["change"] for x in first.collect()] == ["created"]
    again = anomalies.merge(first.drop("change"), found, ["detail"])
    assert [x["change"] for x in again.collect()] == ["updated"]
    assert [x["change"] for x in anomalies.merge(first.drop("change"), found.limit(0), ["detail"]).collect()] == ["auto_resolved"]


def test_other_detectors(spark):
    rows = [("n1", "reserve", "a", "A", "proved", "mt", -1.0, "x", "d1", "f"), ("n2", "reserve", "b", "B", "proved", "mt", 5.0, "x", "d1", "f"), ("n3", "reserve", "b", "B", "proved", "mt", 9.0, "x", "d2", "f")]
    rows += [(f"s{i}", "reserve", "c", "C", k, "mt", v, "x", "d1", "f") for i, (k, v) in enumerate((("proved", 1.0), ("indicated", 1.0), ("inferred", 1.0), ("total", 9.0)))]
    rows += [(f"t{i}", "production_figure", "e", "E", "m", "", v, f"{i}", "d1", "f") for i, v in enumerate([10.0] * 12 + [10.1, 99.0])]
    f = spark.createDataFrame(rows, "node string, kind string, anchor string, anchor_name string, category string, unit string, value double, as_on string, document_id string, field_id string")
    kinds = {}
    for x in anomalies.detect(f).collect():
        kinds.setdefault(x["kind"], []).append(x["anchor"])
    assert kinds["out_of_range"] == ["a"] and kinds["contradiction"] == ["b"] and kinds["sum_mismatch"] == ["c"] and kinds["trend_break"] == ["e"]


def test_answers(spark, corpus):
    docs, fields, e, r = corpus
    q = spark.createDataFrame([("q1", "What are the proved reserves of Jhanjra?"), ("q2", "Who won the football match?")], "question_id string, question string")
    ev = retrieval.fact_evidence(retrieval.match_entities(q, e), e, r, fields, docs)
    a = {x["question_id"]: x for x in retrieval.compose(ev, q).collect()}
    assert a["q1"]["status"] == "answered" and a["q1"]["confidence"] >= 0.75 and "[[c:1]]" in a["q1"]["answer"]
    assert a["q2"]["status"] == "insufficient"
    weak = spark.createDataFrame([("q1", "passage", "t", 0.55)], "question_id string, kind string, text string, score double")
    assert retrieval.compose(weak, q.where("question_id = 'q1'")).first()["status"] == "insufficient"


def test_cache(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "question_id long, embedding array<double>")
    p = spark.createDataFrame([(7, "verified", None, [0.99, 0.05]), (8, "answered", None, [0.0, 1.0])], "qa_id long, status string, owner string, embedding array<double>")
    assert [(r["question_id"], r["qa_id"]) for r in retrieval.cached(q, p).collect()] == [(1, 7)]


def chunk_plain(text, target=600, overlap=90):
    out, buf = [], ""
    for u in [u.strip() for u in re.split(r"(?<=[.!?])\s+|\n{2,}", text.strip()) if u.strip()]:
        if buf and len(buf) + 1 + len(u) > target:
            out.append(buf)
            buf = f"{buf[-overlap:]} {u}".strip()
        else:
            buf = f"{buf} {u}".strip()
    return [*out, buf] if buf else out


def test_chunks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {}
    for r in chunk.chunk_pages(docs, "doc_id", "text", None).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert all(got.get(r["doc_id"], []) == chunk_plain(r["text"]) for r in docs.collect())
    pages = spark.createDataFrame([("d", 2, "Two. " * 200), ("d", 1, "One. " * 200)], "document_id string, page_no int, text string")
    rows = chunk.chunk_pages(pages).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows))) and rows[0]["page_no"] == 1


def test_topics(spark):
    texts = ["conveyor belt fire safety conveyor", "conveyor belt idler inspection safety", "reserve block seam geology drilling", "reserve estimate block geology seam"]
    m, terms = topics.fit_topics(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", n_topics=2)
    best = {}
    for r in m.orderBy("weight").collect():
        best[r["id"]] = r["topic"]
    assert len(best) == 4 and best[0] == best[1] != best[2] == best[3]
    flat = [{t for t, _ in x} for x in terms]
    assert any("conveyor" in x for x in flat) and any("reserve" in x for x in flat)


def test_audit(spark):
    empty = spark.createDataFrame([], "seq long, actor string, action string, target_type string, target_id string, meta string, prev_hash string, entry_hash string")
    ev = spark.createDataFrame([("a", f"x{i}", "t", None, json.dumps({"n": i, "ü": "é"})) for i in range(150)], "actor string, action string, target_type string, target_id string, meta string")
    log = audit.append(empty, ev).cache()
    assert audit.verify(log).first()["ok"]
    bad = log.withColumn("meta", F.when(F.col("seq") == 77, F.lit("{}")).otherwise(F.col("meta")))
    r = audit.verify(bad).first()
    assert not r["ok"] and r["first_broken_seq"] == 77
    assert audit.verify(audit.rehash(bad)).first()["ok"]


def test_reports(spark, corpus):
    docs, fields, e, r = corpus
    block = e.where("kind = 'block'").first()["id"]
    d = reports.geological_reserve_status(block, e, r, fields, docs)
    md = reports.to_markdown(d)
    assert "Proved (measured)" in md and "[1]" in md and "**Sources**" in md and len(d.citations) == 4 and not d.unresolved
    back = reports.from_markdown(md)
    assert [b["type"] for b in back] == [b["type"] for b in d.blocks]
    assert "<sup class=\"cite\">" in reports.to_html(d)
    q = reports.parliamentary_qa("How much?", "Starred Question 1", e, fields, docs)
    assert q.citations
    v = spark.createDataFrame([], "report_id string, version_no int, author_kind string, body string, unresolved int")
    v = reports.add_version(reports.add_version(v, "r", "a\nb", "system", 1), "r", "a\nc", "human", 0)
    assert "+c" in reports.version_pair(v, "r", 1, 2)
    rep = spark.createDataFrame([("r", "draft")], "report_id string, status string")
    assert reports.finalise(rep, v, "r").first()["status"] == "final"
    with pytest.raises(ValueError):
        reports.finalise(rep, v.where("version_no = 1"), "r")
    cols = "array<struct<type:string,level:int,text:string,items:array<struct<label:string,value:string>>,columns:array<string>,rows:array<array<string>>>>"
    x = spark.createDataFrame([([("heading", 1, "T", None, None, None), ("kv", None, None, [("a", "b")], None, None), ("table", None, None, None, ["x"], [["1 [[c:1]]"]])],)], f"b {cols}")
    assert x.select(reports.markdown_column(F.col("b"))).first()[0] == "# T\n\n- **a:** b\n\n| x |\n| --- |\n| 1 [1] |\n"


def test_metrics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 101)] + [("b", 5.0)], "k string, v double")
    r = {x["k"]: x for x in metrics.percentiles(df, "v", ["k"], {"p50": 0.5, "p95": 0.95}).collect()}
    assert (r["a"]["p50"], r["a"]["p95"], r["b"]["p95"]) == (51.0, 95.0, 5.0)
    t = spark.createDataFrame([("d", "proved", "182.40", 182.4), ("d", "mine", "Nigahi OCP", None)], "document_id string, key string, value_text string, value double")
    p = spark.createDataFrame([("d", "proved_reserve", "182.4", 182.4), ("d", "mine_name", "Nigahi", None)], "document_id string, field_key string, value_text string, value double")
    a = spark.createDataFrame([("proved", 0, "proved_reserve"), ("mine", 0, "block_name"), ("mine", 1, "mine_name")], "key string, pos int, field_key string")
    assert {r["key"]: r["matched"] for r in metrics.score_fields(t, p, a).collect()} == {"proved": True, "mine": True}


def test_files_and_stream(spark, tmp_path):
    from docmill.streaming import ingest

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text(RESERVE)
    (src / "b.txt").write_text(RESERVE)
    ok, bad = files.read_files(spark, str(src))
    assert ok.count() == 2 and bad.count() == 0 and files.new_only(ok).count() == 1
    q = ingest.start(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    docs = spark.read.parquet(str(tmp_path / "out" / "documents"))
    assert [r["doc_type"] for r in docs.collect()] == ["geological_reserve_status"]
    assert spark.read.parquet(str(tmp_path / "out" / "fields")).where("field_key = 'proved_reserve'").count() == 1


def test_upsert_nulls(spark):
    old = spark.createDataFrame([(1, None, "a"), (None, 1, "b")], "x int, y int, v string")
    new = spark.createDataFrame([(1, None, "c"), (2, 2, "d")], "x int, y int, v string")
    assert sorted(r["v"] for r in relational.upsert(old, new, ["x", "y"]).collect()) == ["b", "c", "d"]


def test_percentiles_of_ties_and_null_keys(spark):
    rows = [(k, float(v)) for k in ("a", None) for v in [7.0] * 3000 + list(range(500)) + [1e9]] + [("one", 5.0), ("none", None)]
    got = {r["k"]: r for r in metrics.percentiles(spark.createDataFrame(rows, "k string, v double"), "v", ["k"], {"lo": 0.0, "mid": 0.5, "p99": 0.99, "top": 1.0}, accuracy=200).collect()}
    want = sorted(v for k, v in rows if k == "a")
    for k in ("a", None):
        assert [got[k][n] for n in ("lo", "mid", "p99", "top")] == [want[int(q * (len(want) - 1) + 0.5)] for q in (0.0, 0.5, 0.99, 1.0)]
    assert got["one"]["mid"] == 5.0 and "none" not in got


def test_attributes_merge_in_order(spark):
    docs = spark.createDataFrame([("d1", "x", None, None, 1, "a.pdf"), ("d2", "x", None, None, 2, "b.pdf"), ("d3", "x", None, None, 3, "c.pdf")], "document_id string, doc_type string, doc_date date, subsidiary_id string, created_at int, filename string")
    rows = [("d1", "borehole_id", "BH-1", 0.9), ("d2", "block_name", "BH-1", 0.95), ("d3", "mention_org", "M/s Eastern Coalfields Limited, Kolkata", 0.8), ("d3", "mine_name", "Pit", 0.8)]
    fields = spark.createDataFrame([(f"{d}:{k}", d, k, v, None, None, None, c, 1, "verified") for d, k, v, c in rows], "field_id string, document_id string, field_key string, value_text string, value double, unit string, iso string, confidence double, page_no int, status string")
    e, r = graph.build_graph(docs, fields, [("s9", "BCCL", "Bharat Coking Coal Limited"), ("s1", "ECL", "Eastern Coalfields Limited")])
    block = e.where("kind = 'block'").collect()
    assert len(block) == 1 and block[0]["attrs"] == {"is_borehole": "true"} and block[0]["confidence"] == 0.95 and block[0]["document_id"] == "d1"
    unit = e.where("kind = 'subsidiary'").first()
    assert (unit["key"], unit["owner"], unit["confidence"]) == ("sub:ECL", "s1", 0.8)
    assert e.where("kind = 'report'").agg(F.max("confidence")).first()[0] == 0.0
    assert {x["confidence"] for x in r.where("predicate = 'located_in'").collect()} == {0.8}


def test_report_lifecycle(spark, corpus):
    docs, fields, e, r = corpus
    block = e.where("kind = 'block'").first()["id"]
    build = lambda: reports.geological_reserve_status(block, e, r, fields, docs)
    reps = spark.createDataFrame([], "report_id string, title string, template string, owner string, status string")
    reps, v = reports.create(reps, spark.createDataFrame([], reports.VERSION), "r", "geological_reserve_status", build)
    v = reports.edit(reps, reports.rerender(reps, v, "r", build), "r", "# Mine\n\nA line", "shorter")
    h = reports.history(v).collect()
    assert [(x["version_no"], x["author_kind"]) for x in h] == [(1, "ai"), (2, "ai"), (3, "human")] and h[1]["added"] == h[1]["removed"] == 0 and h[2]["added"] > 0
    assert reports.version(v, "r", 3).first()["body"].endswith("A line")
    final = reports.finalise(reps, v, "r")
    for late in (lambda: reports.edit(final, v, "r", "x"), lambda: reports.rerender(final, v, "r", build), lambda: reports.create(reps, v, "q", "no such", build)):
        with pytest.raises(ValueError):
            late()


def test_asked_answers_are_stored(spark):
    from docmill.operators import workflow

    pairs = spark.createDataFrame([(9, "verified", "They did.", 0.9, 2)], "qa_id long, status string, answer string, confidence double, hit_count long")
    answers = spark.createDataFrame([(1, "cache", "They did.", "answered", 0.9, 9), (2, "rag", "No.", "insufficient", 0.2, None)], "question_id long, mode string, answer string, status string, confidence double, qa_id long")
    now, events = workflow.asked(pairs, answers, "2024-01-01", "ann")
    assert now.where("qa_id = 9").first()["hit_count"] == 3 and now.count() == 3 and now.where("status = 'insufficient'").count() == 1
    new = now.where("status = 'insufficient'").first()
    assert {x["action"]: (x["target_id"], json.loads(x["meta"]).get("mode")) for x in events.collect()} == {"query.cache_hit": ("9", None), "query.declined": (str(new["qa_id"]), "rag")}


def test_findings_scan_twice(spark, corpus):
    _, _, e, r = corpus
    f = anomalies.facts(e, r)
    stored, stats = anomalies.scan(spark.createDataFrame([], "signature string, status string, kind string, severity string, anchor string, title string, detail string"), f)
    assert stats.agg(F.sum("created")).first()[0] == 1
    _, again = anomalies.scan(stored.drop("change"), f)
    assert again.agg(F.sum("created")).first()[0] == 0 and again.agg(F.sum("updated")).first()[0] == 1


def nmf_plain(x, k, rounds):
    """Start by exact singular vectors, then the same updates, on the whole matrix."""
    import numpy as np

    u, s, vt = np.linalg.svd(x, full_matrices=False)
    w, h = np.full((len(x), k), x.mean()), np.full((k, x.shape[1]), x.mean())
    for i in range(k):
        parts = [(np.maximum(sign * u[:, i], 0), np.maximum(sign * vt[i], 0)) for sign in (1, -1)]
        a, b = max(parts, key=lambda p: np.linalg.norm(p[0]) * np.linalg.norm(p[1]))
        size = np.sqrt(s[i] * np.linalg.norm(a) * np.linalg.norm(b))
        for out, p in ((w[:, i], a), (h[i], b)):
            out[p > 1e-9] = size * p[p > 1e-9] / np.linalg.norm(p)
    for _ in range(rounds):
        w = w * (x @ h.T) / np.maximum(w @ (h @ h.T), 1e-12)
        h = h * (w.T @ x) / np.maximum((w.T @ w) @ h, 1e-12)
    return w, h


def test_nmf_equals_the_plain_one(spark):
    """On a matrix of low rank, of which the range finder finds all; then on one of full rank, by its error."""
    import numpy as np

    rng = np.random.default_rng(5)
    themes = np.zeros((2, 15))
    themes[0, :9], themes[1, 6:] = rng.random(9) + 0.2, rng.random(9) + 0.2
    low = (rng.random((12, 2)) + 0.1) @ themes
    full = rng.random((12, 15)) * (rng.random((12, 15)) < 0.5)
    for x, rounds in ((low, 3), (full, 3)):
        rows = [(i, f"t{j:02d}", float(x[i, j])) for i in range(12) for j in range(15) if x[i, j] > 0]
        w, h = topics.nmf(spark.createDataFrame(rows, "id int, term string, weight double").repartition(3), 2, rounds=rounds, tolerance=0.0)
        w, h = np.array([r["loads"] for r in w.orderBy("id").collect()]), np.array([r["h"] for r in h.orderBy("term").collect()]).T
        pw, ph = nmf_plain(x, 2, rounds)
        if x is low:
            assert np.allclose(w @ h, pw @ ph, atol=1e-6) and np.allclose(np.sort(h, axis=0), np.sort(ph, axis=0), rtol=1e-4)
        assert np.linalg.norm(x - w @ h) <= 1.03 * np.linalg.norm(x - pw @ ph)


def test_terms_are_counted_within_rows(spark):
    rows = [(1, "Mines and mining: the mine, the MINE  conveyor belt belt belt"), (2, None), (3, ""), (4, "a bb !!"), (5, "Überraschung conveyor_belt conveyor belt")]
    from collections import Counter

    from docmill.functions import text as T

    df = spark.createDataFrame(rows, "id int, text string")
    want = {}
    for r in df.select("id", T.topic_tokens(F.coalesce("text", F.lit(""))).alias("w")).collect():
        w = [x for x in r["w"] if all(c in "abcdefghijklmnopqrstuvwxyz_" for c in x)]
        want |= {(r["id"], t): n for t, n in Counter([*w, *map(" ".join, zip(w, w[1:], strict=False))]).items()}
    assert {(r["id"], r["term"]): r["tf"] for r in topics.terms_of(df.repartition(2), "id").collect()} == want



def test_large_texts_are_chunked_in_proportion():
    import time

    def took(n):
        text = "A sentence of some words here. " * n
        began = time.perf_counter()
        assert len(chunk.chunk_text(text)) > n // 30
        return time.perf_counter() - began

    took(2_000)
    assert took(400_000) < 5


def test_page_dispatch_and_suffixes(spark, tmp_path):
    for name in ("a.PDF", "b.txt", "c.docx", "d.JPEG"):
        (tmp_path / name).write_text("x" * 30)
    ok, _ = files.read_files(spark, str(tmp_path))
    assert {(r["filename"], r["kind"]) for r in ok.collect()} == {("a.PDF", "pdf"), ("b.txt", "text"), ("d.JPEG", "image")}
    one, _ = files.read_files(spark, str(tmp_path / "c.docx"), suffixes=["docx"])
    assert one.count() == 1
