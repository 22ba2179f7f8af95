"""Steps whose work or memory once grew faster than their input."""

import re

from pyspark.sql import functions as F

from docmill.operators import extract, graph
from docmill.operators import topics as topics_module
from docmill.plans import domain

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rules_run_once_and_over_all_tasks(spark):
    """The rules' fields were extracted a second time for a join, and a small file was one task."""
    fields = extract.extract_fields(domain.reserve_pages(spark, SF), this_year=2026)
    assert "Join" not in plan(fields)
    for pages in (domain.reserve_pages(spark, SF), domain.hole_pages(spark, SF)):
        assert pages.select("document_id", F.spark_partition_id().alias("p")).distinct().select("p").distinct().count() > 1


def test_fields_are_pivoted_once(spark):
    """Nodes and edges each extracted, ranked and pivoted all fields."""
    docs, fields = domain.documents(spark, SF), domain.accepted_fields(spark, SF)
    for side in graph.evidence(docs, fields, domain.UNITS):
        assert "Window" not in plan(side) and "Aggregate" not in plan(side)


def test_extraction_compiles(spark):
    """The rules' branches were more code than a stage may have, so that it ran uncompiled."""
    rows = extract.extract_by_rules(domain.reserve_pages(spark, SF))
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert rows.where("field_key = 'reserves_as_on'").count() > 0
        assert rows.groupBy("field_key").count().count() == 9
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")


def test_chain_in_ranges(spark, monkeypatch):
    """One task held and chained the whole log, once a reader of it."""
    from docmill.operators import audit

    rows = [(i * 3, f"u{i}", "aé", None if i % 2 else "t", None, '{"b": 1, "a": "\\u0000"}' if i % 3 else None, None, None) for i in range(50)]
    log = spark.createDataFrame(rows, audit.SCHEMA).repartition(5)
    monkeypatch.setattr(audit, "RANGE_ROWS", 7)
    done = audit.rehash(log)
    assert done.rdd.getNumPartitions() > 1 and "MapInPandas" not in plan(done)
    prev = None
    for r, (seq, actor, action, kind, target, meta, _, _) in zip(done.orderBy("seq").collect(), rows, strict=True):
        body = audit.canonical(actor, action, kind, target, audit.json.loads(meta) if meta else {}, prev or "")
        assert (r.seq, r.prev_hash, r.entry_hash) == (seq, prev, audit.entry_hash(body))
        prev = r.entry_hash
    assert audit.verify(done).first().ok


def test_probes_are_bounded():
    """All probes of a batch of queries, a vector a list, were held at once."""
    import pandas as pd

    from docmill.operators import vector_index

    got = list(vector_index._sliced(iter([pd.DataFrame({"q": range(100)}), pd.DataFrame({"q": []})]), 32))
    assert [len(x) for x in got] == [32, 32, 32, 4] and [q for x in got for q in x["q"]] == list(range(100))


def test_remembered_vectors_are_rows_of_their_own():
    """One remembered row kept the vectors of its whole batch in memory."""
    from docmill.operators import chunk

    model = chunk.LastUsed(chunk.hashing_embedder(8), 4)
    model([f"t{i}" for i in range(100)])
    assert all(v.base is None for v in model.held.values())


def test_names_of_copies(spark):
    """A task held every pair of a text and a copy's name."""
    from docmill.operators import matching

    docs = spark.createDataFrame([(i, "Same Words" if i % 2 else f"other {i}") for i in range(20)], "id long, text string")
    got = matching.contained_names(docs, docs.select(docs.id.alias("n"), docs.text.alias("name")), "id", "text", "n", "name")
    pairs = {(r.id, r.n) for r in got.collect()}
    want = {(i, j) for i in range(20) for j in range(20) if (("Same Words" if j % 2 else f"other {j}").lower() in ("Same Words" if i % 2 else f"other {i}").lower())}
    assert pairs == want and "name" in plan(got).split("Join")[0]


def test_words_stay_bounded():
    """The remembered words of a worker took most of its memory, long runs among them."""
    from docmill.llm.packing import _Words

    words = _Words(lambda w: [len(w)], "", 3)
    assert [len(words["x" * n]) for n in (1, 2, 3, 4, 65)] == [4] * 5
    assert len(words) + len(words.old) <= 6 and "x" * 65 not in words and "x" * 65 not in words.old


def test_equal_answers_meet_by_hash(spark, monkeypatch):
    """Every question was compared with every stored answer, and long vectors made blocks of gigabytes."""
    from docmill.operators import chunk, retrieval

    pairs = spark.createDataFrame([(9, "verified", "s1", [1.0, 0.0]), (4, "verified", None, [3.0, -0.0]), (2, "answered", None, [1.0, 0.0]), (5, "verified", None, [0.0, 0.0]), (6, "verified", None, [1.0, 1.0])], "qa_id long, status string, owner string, embedding array<float>")
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [1.0, 1.1]), (3, [0.0, 0.0]), (4, [0.0, 1.0]), (5, None)], "question_id long, embedding array<float>")
    asked, nearest = [], chunk.nearest_for_all
    monkeypatch.setattr(chunk, "nearest_for_all", lambda a, *x: asked.extend(r.question_id for r in a.collect()) or nearest(a, *x))
    got = {(r.question_id, r.qa_id, r.similarity) for r in retrieval.cached(q, pairs).collect()}
    assert got == {(1, 4, 1.0), (2, 6, 0.9989)} and sorted(asked) == [2, 3, 4, 5]


def test_blocks_are_bounded_by_components(spark):
    """A block held as many rows however long their vectors were."""
    from docmill.operators import chunk

    rows = spark.range(40).selectExpr("id", "transform(sequence(1, 1024), i -> double(pmod(i * i + i * (id + 3), 11) + 1)) AS embedding")
    near = chunk.nearest_for_all(rows.withColumnRenamed("id", "q"), rows, 1, "q", "id", block=8)
    assert [(r.q, r.score) for r in near.orderBy("q").collect()] == [(i, 1.0) for i in range(40)]
    assert "sequence(0, 19" in near._jdf.queryExecution().analyzed().toString()


def test_runs_of_rows():
    """Workers chunked and counted a whole batch of texts at once, however long these were."""
    from docmill.functions import text as T

    assert list(T.runs([1, 2, 3, 9, 0, 1], 4)) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(T.runs([], 4)) == [] and list(T.runs([0, 0], 4)) == [(0, 2)]


def test_chunks_and_terms_of_runs(spark, monkeypatch):
    """Rows of a later run keep their keys, pages and counts; runs of one row give what one run gives."""
    from docmill.operators import chunk, topics

    docs = spark.createDataFrame([(i, i % 3, None if i == 5 else f"seam {'coal ' * i}grade. " * (i + 1)) for i in range(20)], "document_id long, page_no int, text string").coalesce(1)
    made = lambda: (sorted(chunk.chunk_pages(docs, target=40, overlap=9).collect()), sorted(chunk.chunk_pages(docs, page_col=None, target=40, overlap=9).collect()), sorted(topics.terms_of(docs, "document_id").collect()))
    whole = made()
    monkeypatch.setattr(chunk, "CHUNKED", 100)
    monkeypatch.setattr(topics, "COUNTED", 7)
    assert made() == whole and sum(r.tf for r in whole[2] if r.id == 3 and r.term == "seam") == 4
    assert len(list(topics._counted("long", True)[0](iter([__import__("pyarrow").RecordBatch.from_pydict({"id": [1, 2], "w": [["coal"] * 5, ["seam"] * 6]})])))) == 2


def test_texts_of_new_words(monkeypatch):
    """Words that do not recur were each encoded alone; as whole texts they give the same ids."""
    from docmill.llm import packing, queries

    ids, plain = packing.Ids(*queries.tokenizer_path()), packing.Ids(*queries.tokenizer_path())
    monkeypatch.setattr(ids, "SEEN", 50, raising=False)
    monkeypatch.setattr(ids, "AS_THEY_ARE", 30, raising=False)
    texts = [packing.Ids.PROBE, "", " ", "\n\n a\t\tb ", "x" * 300, "<|endoftext|>"] + [" ".join(f"w{i * j}é{j}" for j in range(20)) for i in range(60)] + [packing.Ids.PROBE + " 　 tail  "] * 10
    whole, asked = ids.whole, []
    ids.whole = lambda t: asked.append(t) or whole(t)
    for t in texts:
        assert ids.encode(t) == plain.encode(t) == packing.np.array(plain.slow.encode(t, add_special_tokens=False).ids, "<u4").tobytes() == whole(t)
    assert 0 < len(asked) < len(texts)


def test_revisions_are_aggregated_once(spark):
    """A distinct count of dates made the detector aggregate all figures by date first, and shuffle them twice."""
    from docmill.operators import anomalies

    rows = [("a", "A", "proved", v, d, f"d{i}", f"n{i}") for i, (v, d) in enumerate([(1.0, "2001"), (9.0, None), (5.0, "2002")])] + [("b", "B", "proved", v, d, f"d{i}", f"n{i}") for i, (v, d) in enumerate([(1.0, "2001"), (9.0, None)])] + [("c", "C", "proved", v, None, f"d{i}", f"n{i}") for i, v in enumerate([1.0, 9.0])]
    f = spark.createDataFrame(rows, "anchor string, anchor_name string, category string, value double, as_on string, document_id string, node string")
    found = anomalies.revisions_and_contradictions(f)
    assert {(r.anchor, r.kind) for r in found.collect()} == {("a", "revision"), ("b", "contradiction"), ("c", "contradiction")}
    assert "distinct" not in plan(found).lower().replace("array_distinct", "")


def test_edges_of_one_document_are_not_shuffled(spark):
    """Every edge was shuffled with two hashes of 64 characters, once to be merged and twice for the keys of its ends."""
    from docmill.plans import queries

    edges = queries()["graph_relations"](spark, SF)
    assert "Join" not in plan(edges)
    assert "sha2" not in edges._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)[1]


def test_lone_sightings_merge_like_others(spark, monkeypatch):
    """A document told in two rows, one whose block is its hole, and one without an id give the graph that merging every sighting gives."""
    docs = spark.createDataFrame([("a", 2, "s1"), ("a", 1, "s1"), ("b", 3, "s1"), ("c", 4, None), (None, 5, None)], "document_id string, created_at int, subsidiary_id string")
    docs = docs.withColumns({"doc_type": F.lit("t"), "doc_date": F.lit("2020-01-02"), "filename": F.concat("document_id", F.lit(".pdf"))})
    said = [("block_name", "North 1", None), ("borehole_id", "North 1", None), ("mine_name", "Pit 1", None), ("principal_seam", "R-I", None), ("average_grade", "g7", None), ("proved_reserve", "5", 5.0), ("finding", "roof", None)]
    fields = spark.createDataFrame([(f"{d}:{k}", d, k, t, v, None, None, 0.8, 1, "verified") for d in "abc" for k, t, v in said], "field_id string, document_id string, field_key string, value_text string, value double, unit string, iso string, confidence double, page_no int, status string")
    shown = lambda pair: [sorted(str(r.asDict()) for r in t.collect()) for t in pair]
    nodes, edges = graph.sightings(docs, fields)
    assert nodes.where("alone").count() == 6 and edges.where("alone").select("document_id").distinct().count() == 2
    whole = shown((graph.merge_nodes(nodes.drop("alone")), graph.merge_edges(edges.drop("alone"))))
    assert shown(graph.build_graph(docs, fields)) == whole == shown((graph.merge_nodes((ev := graph.evidence(docs, fields))[0]), graph.merge_edges(ev[1])))
    assert len(whole[1]) == len({(r["src"], r["dst"], r["predicate"], r["valid_from"]) for r in graph.build_graph(docs, fields)[1].collect()})


def test_neighbours_sort_no_edges(spark, monkeypatch):
    """All edges were sorted at both ends, so that a task's memory grew with them."""
    from docmill.plans import queries

    shown = []
    for most in (graph.BROADCAST_KEYS, 0):
        monkeypatch.setattr(graph, "BROADCAST_KEYS", most)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            near = queries()["neighbors"](spark, SF)
            shown.append(sorted(near.collect()))
            p = near._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Sort" not in p and ("ShuffledHashJoin" in p) == (most == 0)
    assert shown[0] == shown[1] and shown[0]


def test_topics_keep_the_newest_tables_only(spark, monkeypatch):
    """Each round of NMF left both its tables, terms as texts, and its joins dealt all entries anew."""
    import os

    from docmill.operators import topics

    stores, joined = [], []
    monkeypatch.setattr(topics, "Store", lambda *a: stores.append(topics_store(*a)) or stores[-1])
    monkeypatch.setattr(topics, "_times", lambda entries, table, on, *a: joined.append(dealt_by(entries, on)) or times(entries, table, on, *a))
    docs = spark.createDataFrame([(i, f"mine seam coal{'abcde'[i % 5]} report {'roof bolt' if i % 2 else 'water pump'}") for i in range(20)], "id int, text string")
    members, terms = topics.fit_topics(docs, "id", n_topics=2)
    assert members.count() >= 20 and len(terms) == 2 and all(isinstance(t, str) for ts in terms for t, _ in ts)
    left = sorted(x.split("-")[0] for x in os.listdir(stores[0].path.removeprefix("file:")))
    assert left == ["df", "h", "w", "x"]
    assert len(joined) > 6 and all(joined)


topics_store, times = topics_module.Store, topics_module._times


def dealt_by(entries, on):
    """Whether the entries are dealt by the key on which they are joined."""
    return f"RepartitionByExpression [{on}#" in entries._jdf.queryExecution().analyzed().toString()


def test_questions_that_fall_together_are_told_apart(spark):
    """Different questions whose hashed vectors are equal, or nearly so, were answered by one another's answers."""
    from docmill.operators import chunk, workflow

    make = chunk.embedder_of("hashing", dim=8)
    said = ["what has north1", *[f"what has north{i}" for i in range(2, 4000) if make()([f"what has north{i}"]).tolist() == make()(["what has north1"]).tolist()][:2]]
    assert len(said) == 3
    none = lambda s: spark.createDataFrame([], s)
    pairs = chunk.embed(spark.createDataFrame([(7, "verified", None, "a", 0.9, said[1], 0), (9, "verified", None, "b", 0.9, said[0], 0)], "qa_id long, status string, owner string, answer string, confidence double, question_norm string, hit_count long"), make, "question_norm")
    q = spark.createDataFrame([(1, said[0].upper()), (2, said[1] + "?"), (3, said[2])], "question_id long, question string")
    tables = [none(s) for s in ("id string, kind string, key string, name string, owner string, attrs map<string,string>, field_id string, document_id string", "src string, dst string, predicate string", "field_id string, confidence double, page_no int, document_id string", "document_id string, filename string, subsidiary_id string", "chunk_id long, document_id string, page_no int, text string, embedding array<float>")]
    got = workflow.ask(q, *tables, pairs, embedder=make)
    assert {(r.question_id, r["mode"], r.qa_id) for r in got.collect()} == {(1, "cache", 9), (2, "cache", 7), (3, "rag", None)}
    longer = " ".join(f"word{i}" for i in range(30))
    q = spark.createDataFrame([(1, longer + " more")], "question_id long, question string")
    known = chunk.embed(pairs.drop("embedding").withColumn("question_norm", F.lit(longer)), chunk.embedder_of("hashing", dim=2048), "question_norm")
    assert [(r["mode"], r.qa_id) for r in workflow.ask(q, *tables, known, embedder=chunk.embedder_of("hashing", dim=2048)).collect()] == [("cache", 7)]


def test_each_side_of_the_graph_follows_alone(spark):
    """Both sides were stored and followed for either, with hashes of 256 bits as text; relations told by their ends follow like those told by ids."""
    docs = spark.createDataFrame([("a", 1, "s1"), ("b", 2, None), ("c", 3, "s1")], "document_id string, created_at int, subsidiary_id string")
    docs = docs.withColumns({"doc_type": F.lit("t"), "doc_date": F.lit("2020-01-02"), "filename": F.concat("document_id", F.lit(".pdf"))})
    said = [("block_name", "North 1", None), ("mine_name", "Pit 1", None), ("principal_seam", "R-I", None), ("average_grade", "g7", None), ("proved_reserve", "5", 5.0)]
    fields = spark.createDataFrame([(f"{d}:{k}", d, k, t, v, None, None, 0.8, 1, "verified") for d in "abc" for k, t, v in said], "field_id string, document_id string, field_key string, value_text string, value double, unit string, iso string, confidence double, page_no int, status string")
    changed = spark.createDataFrame([("a",), ("c",)], "document_id string")
    now = fields.where("document_id <> 'c'").withColumn("value_text", F.when((F.col("document_id") == "a") & (F.col("field_key") == "mine_name"), "Pit 2").otherwise(F.col("value_text")))
    shown = lambda t: sorted(str(r.asDict()) for r in t.collect())
    ev, (nodes, edges) = graph.evidence(docs, fields), graph.sightings(docs, fields)
    e, r = graph.build_graph(docs.where("document_id <> 'c'"), now, ends=True)
    assert {len(x.id) for t in (e, r) for x in t.collect()} == {32}
    (e2, none), (_, nothing) = graph.follow((graph.merge_nodes(ev[0]), None), (ev[0], None), changed, docs.where("document_id <> 'c'"), now)
    assert shown(e2) == shown(e) and none is None and nothing is None
    told = graph.merge_edges(edges, ends=True).drop("id", "src", "dst")
    (_, r2), _ = graph.follow((None, told), (None, edges), changed, docs.where("document_id <> 'c'"), now)
    assert shown(r2) == shown(r.drop("id", "src", "dst"))
    (_, r3), _ = graph.follow((graph.merge_nodes(ev[0]), graph.merge_edges(ev[1])), ev, changed, docs.where("document_id <> 'c'"), now)
    assert shown(r3) == shown(r.drop("src_node", "dst_node"))


def test_reports_store_no_more_than_they_read(spark, monkeypatch):
    """The reports of all blocks stored the whole graph, each edge with three hashes, and shuffled the edges of all things."""
    from docmill.operators import reports
    from docmill.plans import indexes

    made = {}

    class Kept(topics_store):
        def write(self, df, name="t", by=None):
            made[name] = super().write(df, name, by)
            return made[name]

    monkeypatch.setattr(indexes, "Store", Kept)
    monkeypatch.setattr(reports, "Store", Kept)
    assert indexes.every_report(spark, SF).count() > 0
    assert made["relations"].columns == ["src", "dst", "predicate"] and {"entities", "fields", "documents", "figures"} <= set(made)
    kind = made["entities"].select("id", "kind")
    ends = made["relations"].join(kind.toDF("src", "s"), "src").join(kind.toDF("dst", "t"), "dst").select("s", "t").distinct().collect()
    assert {(r.s, r.t) for r in ends} == {("block", t) for t in ("report", "mine", "seam", "reserve")} | {("mine", "subsidiary"), ("seam", "mineral")}


def test_pairs_of_names_are_not_merged_anew(spark):
    """All pairs of texts and copies' names were shuffled once more to be made distinct, though only names of several spellings can repeat one."""
    from docmill.operators import matching

    texts = spark.createDataFrame([(1, "Coal and seam"), (1, "coal SEAM"), (2, "seam"), (3, None)], "id long, text string")
    names = spark.createDataFrame([(7, "coal"), (7, "Seam"), (8, "seam"), (8, "SEAM"), (9, "SEAM"), (None, "coal"), (9, "")], "n long, name string")
    got = matching.contained_names(texts, names, "id", "text", "n", "name")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 7), (2, 7), (1, 8), (2, 8), (1, 9), (2, 9), (1, None)], key=str)
    assert plan(got).startswith("Union") and ", s#" in plan(got)


def test_fields_are_gathered_by_one_value(spark, monkeypatch):
    """A document's fields were pivoted by an aggregate a key, each handed every field."""
    kept = []
    monkeypatch.setattr(graph, "Store", type("Seen", (topics_store,), {"write": lambda self, df, *a: kept.append(plan(df)) or topics_store.write(self, df, *a)}))
    graph.sightings(domain.documents(spark, SF), domain.accepted_fields(spark, SF), domain.UNITS)
    made = [line for line in kept[0].splitlines() if re.search(r"Aggregate \[document_id#\d+\],", line)]
    assert len(made) == 1 and "collect_list" in made[0] and "first(" not in made[0]


def test_quality_extracts_once(spark, monkeypatch):
    """Fields were extracted once for the rates by type and once for the totals."""
    calls = []
    monkeypatch.setattr(domain, "Store", type("Seen", (topics_store,), {"write": lambda self, df, *a: calls.append(df.columns) or topics_store.write(self, df, *a)}))
    q = domain.extraction_quality(spark, SF)
    assert calls == [["document_id", "confidence", "status", "source_kind"]] and "regexp" not in plan(q).lower()
