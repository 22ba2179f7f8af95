"""The vector index, topics by density, name matching, layout, embedders and reports of all things."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.operators import anomalies, chunk, density, graph, layout, matching, reports, vector_index, workflow
from docmill.sources.store import Store
from tests.test_domain import corpus  # noqa: F401

VECTORS = "id long, embedding array<double>, owner string"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


@pytest.fixture(scope="module")
def themed(spark):
    """Forty themes of vectors, some copies, and some rows that are no vectors."""
    rng = np.random.default_rng(3)
    x = unit(unit(rng.normal(size=(40, 24)))[rng.integers(0, 40, 1500)] + 0.12 * rng.normal(size=(1500, 24)))
    x[1400:] = x[5]
    rows = [(i, v.tolist(), None if i % 3 else "s1") for i, v in enumerate(x)]
    rows += [(2000, None, None), (2001, [], None), (2002, [0.0] * 24, None), (2003, [1.0] * 7, None), (2004, [float("nan")] * 24, None), (2005, [None] * 24, None)]
    return x, spark.createDataFrame(rows, VECTORS).repartition(5).cache()


def test_index_recall_and_exact_ways(spark, themed):
    x, df = themed
    index = vector_index.build(Store(spark, "t"), df, "id")
    assert (index.rows, index.dim) == (1500, 24) and 30 <= len(index.centroids) <= 39
    q = df.where("id % 20 = 0 or id > 1999").select(F.col("id").alias("qid"), "embedding")
    ids = [i for i in range(0, 1500, 20)]
    cos = x[ids] @ x.T
    want = {i: sorted(range(1500), key=lambda j, c=c: (-round(c[j], 12), j))[:10] for i, c in zip(ids, cos, strict=True)}

    def found(df):
        out = {}
        for r in df.orderBy("qid", "rank").collect():
            out.setdefault(r["qid"], []).append(r["id"])
        return out

    few = found(vector_index.search(index, q, 10, "qid", probes=6))
    assert few.keys() == want.keys()
    hits = sum(len(set(few[i]) & set(want[i])) if i not in range(1400, 1500) else 10 for i in ids)
    assert hits / (10 * len(ids)) >= 0.95
    exact = {r["qid"]: r for r in vector_index.search_exact(index, q, 10, "qid", rounded=False).groupBy("qid").agg(F.min("score").alias("low"), F.count("*").alias("n")).collect()}
    for i, c in zip(ids, cos, strict=True):
        assert exact[i]["n"] == 10 and exact[i]["low"] == pytest.approx(np.sort(c)[-10], abs=1e-9)
    above = vector_index.search_above(index, q, 0.9, "qid", k=2000).groupBy("qid").count().collect()
    assert {r["qid"]: r["count"] for r in above} == {i: int((c >= 0.9 - 1e-12).sum()) for i, c in zip(ids, cos, strict=True)}


def test_index_reads_few_lists_and_keeps_scope(spark, themed):
    x, df = themed
    index = vector_index.build(Store(spark, "t"), df, "id", owner_col="owner")
    one = df.where("id = 40").select(F.col("id").alias("qid"), "embedding")
    lists = vector_index._probes(index, vector_index._queries(index, one, "qid", "embedding"), lambda a, r, _: np.flatnonzero((r >= 0) & (a - r <= np.arccos(0.95))))
    assert 1 <= lists.count() <= len(index.centroids) // 2
    got = vector_index.search_exact(index, one, 30, "qid", owner="other").collect()
    assert len(got) == 30 and all(r["id"] % 3 for r in got)


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    index = vector_index.build(Store(spark, "t"), empty, "id")
    assert vector_index.search_exact(index, spark.createDataFrame([(1, [0.5])], "qid long, embedding array<double>"), 3, "qid").count() == 0


def test_odd_vectors_do_not_end_a_search(spark, themed):
    _, df = themed
    got = chunk.nearest_for_all(df.where("id in (0, 2001, 2003)").select(F.col("id").alias("qid"), "embedding"), df, 2, "qid", "id").collect()
    assert sorted((r["qid"], r["rank"]) for r in got) == [(0, 1), (0, 2), (2003, 1)]


def test_density_finds_planted_clusters(spark):
    rng = np.random.default_rng(11)
    centers = unit(rng.normal(size=(3, 32)))
    x = np.concatenate([unit(c + 0.08 * rng.normal(size=(n, 32))) for c, n in zip(centers, (40, 25, 60), strict=True)] + [unit(rng.normal(size=(20, 32)))])
    x[100:125] = x[100]  # copies inside the third
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)]
    got = {r["id"]: r["topic"] for r in density.clusters(spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3), "id", k=5, least=0.7).collect()}
    assert [{got[i] for i in r} for r in (range(40), range(40, 65), range(65, 125))] == [{0}, {40}, {65}]
    assert {got[i] for i in [*range(125, 145), 500]} == {density.OUTLIER}


def test_names_by_automaton(spark, monkeypatch):
    texts = [(1, "The Gevra mine, GEVRA again"), (2, None), (3, ""), (4, "xayb"), (4, "xayb"), (5, "Gev")]
    names = [(1, "gevra"), (2, "Gevra Mine"), (3, ""), (4, None), (5, "a"), (6, "A"), (7, "ay"), (8, "evr")]
    want = sorted({(i, k) for i, t in texts for k, n in names if t and n and n.lower() in t.lower()})
    for shard in (4_000_000, 3):
        monkeypatch.setattr(matching, "SHARD_CHARS", shard)
        t, n = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(names, "k int, name string")
        assert sorted(map(tuple, matching.contained_names(t, n, "id", "text", "k", "name").collect())) == want
        assert matching.contained_names(t, n.limit(0), "id", "text", "k", "name").count() == 0
    assert list(matching.matches(["A gevra", "none"], ["Gevra", ""])) == [{"Gevra"}, set()] and list(matching.matches(["x"], [])) == [set()]


def crossings(at, edges):
    e = sorted((at[a], at[b]) for a, b in edges)
    return sum(1 for i, (a, b) in enumerate(e) for c, d in e[i + 1 :] if a < c and b > d)


def test_layout_takes_crossings_out(spark):
    rng = np.random.default_rng(2)
    mines = rng.permutation(12)
    v = [(f"s{i}", "subsidiary", f"S{i}") for i in range(4)] + [(f"m{i:02d}", "mine", f"M{i:02d}") for i in range(12)] + [("q", "thing", None)]
    e = [(f"m{m:02d}", f"s{i % 4}") for i, m in enumerate(mines)] + [("q", "s0"), ("q", "q")]
    vs, es = spark.createDataFrame(v, "id string, kind string, name string"), spark.createDataFrame(e, "src string, dst string")
    rows = layout.layered(vs, es, rounds=2).collect()
    at = {r["id"]: r["place"] for r in rows}
    assert len(rows) == 17 and {r["tier"] for r in rows if r["id"] == "q"} == {len(layout.TIERS)}
    for kind, n in (("s", 4), ("m", 12)):
        assert sorted(p for i, p in at.items() if i[0] == kind) == list(range(n))
    named = {i: k for k, i in enumerate(sorted(x[0] for x in v if x[1] == "mine"))} | {f"s{i}": i for i in range(4)}
    own = [x for x in e if x[0][0] == "m"]
    assert crossings(at, own) == 0 < crossings(named, own)


def test_last_used_model_is_called_once_a_text():
    calls = []

    def model(texts):
        calls.append(list(texts))
        return np.array([[float(len(t))] for t in texts])

    m = chunk.LastUsed(model, size=2)
    assert m(["a", "bb", "a"]).ravel().tolist() == [1, 2, 1] and calls == [["a", "bb"]]
    m(["a"])
    m(["ccc"])  # bb was used longest ago and is forgotten
    m(["a", "bb"])
    assert calls[1:] == [["ccc"], ["bb"]] and len(m.held) == 2 and m.asked == 4


def test_embedders(spark):
    f = chunk.embedder_of("hashing", dim=32)
    assert chunk.health(f, 32) == {"ok": True, "dim": 32, "error": None} and not chunk.health(f, 64)["ok"]
    assert chunk.health(lambda: lambda t: 1 / 0)["error"] == "division by zero"
    with pytest.raises(ValueError):
        chunk.embedder_of("none")

    def fails():
        return lambda texts: 1 / 0 if "bad" in texts else np.ones((len(texts), 2))

    df = spark.createDataFrame([(1, "bad")], "id int, text string").union(spark.createDataFrame([(2, "good")], "id int, text string"))
    got = {r["id"]: r["embedding"] for r in chunk.embed(df, fails, on_failure="null").collect()}
    assert got[1] is None and got[2] == [1.0, 1.0]


def test_reports_of_all_equal_those_of_one(spark, corpus):  # noqa: F811
    docs, fields, e, r = corpus
    anchors = e.where("kind in ('block', 'mine')")
    every = reports.entity_reports(anchors, e, r, fields, docs, "geological_reserve_status").withColumn("md", reports.markdown_column(F.col("blocks"))).withColumn("sources", reports.sources_column(F.col("citations"))).collect()
    assert len(every) == anchors.count() > 0
    for x in every:
        one = reports.to_markdown(reports.geological_reserve_status(x["anchor"], e, r, fields, docs))
        assert x["md"].strip() + ("\n\n" + x["sources"].strip() if x["sources"] else "") == one.strip()


def test_several_decisions_on_one_thing(spark):
    f = spark.createDataFrame([("a", "5", 5.0, None, None, 0.4, "needs_review")], "field_id string, value_text string, value double, iso string, original_value_text string, confidence double, status string")
    d = spark.createDataFrame([("a", "reject", None, 1), ("a", "correct", "7", 2), ("a", "confirm", None, 3)], "field_id string, decision string, new_value string, decided_at int")
    (r,) = workflow.review_fields(f, d).collect()
    assert (r["value"], r["original_value_text"], r["status"]) == (7.0, "5", "verified")
    s = spark.createDataFrame([("x", "open")], "signature string, status string")
    d = spark.createDataFrame([("x", "dismissed", 2), ("x", "resolved", 1)], "signature string, decision string, decided_at int")
    assert [x["status"] for x in anomalies.review(s, d).collect()] == ["dismissed"]


def test_a_document_that_goes_takes_its_own_with_it(spark, corpus):  # noqa: F811
    """Following a removed document gives the graph of the others."""
    docs, fields, _, _ = corpus
    ev = graph.evidence(docs, fields)
    built = graph.merge_nodes(ev[0]), graph.merge_edges(ev[1])
    first = docs.orderBy("document_id").first()["document_id"]
    left = docs.where(F.col("document_id") != first), fields.where(F.col("document_id") != first)
    (e, r), (n, _) = graph.follow(built, ev, docs.where(F.col("document_id") == first).select("document_id"), *left)
    e2, r2 = graph.build_graph(*left)
    key = lambda df: sorted(str(x) for x in df.select(*sorted(df.columns)).collect())
    assert key(e) == key(e2) and key(r) == key(r2) and not n.where(F.col("document_id") == first).count()


def test_evidence_by_file(spark):
    """Two uploads of one file are one piece of evidence."""
    rows = [(f"n{i}", "reserve", "a", "A", "proved", "million_tonnes", v, day, doc, f"f{i}", name, 2, "proved_reserve") for i, (v, day, doc, name) in enumerate([(1.0, "2020", "d1", "x.pdf"), (1.0, "2020", "d2", "x.pdf"), (2.0, "2021", "d3", "y.pdf")])]
    f = spark.createDataFrame(rows, "node string, kind string, anchor string, anchor_name string, category string, unit string, value double, as_on string, document_id string, field_id string, filename string, page_no int, field_key string")
    (r,) = anomalies.revisions_and_contradictions(f).collect()
    assert [(x["filename"], x["document_id"], x["page_no"]) for x in r["evidence"]] == [("x.pdf", "d1", 2), ("y.pdf", "d3", 2)]


def test_export_of_a_version(spark):
    rs = spark.createDataFrame([("r", "Report — One", "t", None, "draft")], "report_id string, title string, template string, owner string, status string")
    vs = spark.createDataFrame([("r", 1, "ai", "", "# First", 0), ("r", 2, "human", "", "# Second", 0)], reports.VERSION)
    assert tuple(reports.exported(rs, vs, "r", 1, "md").first()) == ("Report-One-v1.md", "# First")
    name, page = reports.exported(rs, vs, "r").first()
    assert name == "Report-One-v2.html" and "<h1>Second</h1>" in page
    for bad in ({"version_no": 3}, {"form": "pdf"}):
        with pytest.raises(ValueError):
            reports.exported(rs, vs, "r", **bad)
