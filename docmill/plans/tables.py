"""Queries over the stored tables for topics, review, sources, lists, versions, the audit log and scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import audit, chunk, metrics, relational, reports, retrieval, topics, workflow
from docmill.plans.driver import CHUNKS_SQL, TERMS_SQL
from docmill.plans.registry import Registry, read
from docmill.sources import files

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql

# ---------------------------------------------------------------- words and topics


def dated(spark: SparkSession, d: str) -> DataFrame:
    """Documents as the engine keeps them: a type by language, a date by id (none for every seventh), an owner by source."""
    x = read(spark, d, "documents")
    day = F.when(F.col("doc_id") % 7 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1000).cast("int")))
    return x.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("doc_type"), day.alias("doc_date"), F.when(F.col("source").isin("src1", "src2", "src3"), F.col("source")).alias("subsidiary_id"), "text")


_DATED = "d AS (SELECT doc_id AS document_id, lang AS doc_type, CASE WHEN doc_id % 7 <> 0 THEN DATE '2020-01-01' + CAST(doc_id % 1000 AS INTEGER) END AS doc_date, CASE WHEN source IN ('src1', 'src2', 'src3') THEN source END AS subsidiary_id FROM documents)"


@query(f"""WITH {_DATED}, k AS (SELECT document_id FROM d WHERE (subsidiary_id = 'src1' OR subsidiary_id IS NULL) AND doc_type = 'en' AND doc_date >= DATE '2020-06-01'),
n AS (SELECT term, count(*) AS n FROM {TERMS_SQL} SEMI JOIN k ON doc_id = document_id GROUP BY term ORDER BY n DESC, term LIMIT 40) SELECT term, n, round(n / max(n) OVER (), 3) AS weight FROM n""")
def scoped_word_cloud(spark, d):
    """Words of one type's documents of a unit and of none, from a day on."""
    docs = dated(spark, d)
    return topics.word_cloud(topics.scoped_chunks(docs.select("document_id", "text"), docs.drop("text"), "src1", "en", "2020-06-01"), limit=40)


def _loads(spark: SparkSession, d: str) -> DataFrame:
    """Made-up loads of 5 topics for every document, in thousandths so that both engines agree."""
    x = read(spark, d, "documents")
    return x.select(F.col("doc_id").alias("id"), F.array(*[(F.col("doc_id") * m % 997 * (F.col("doc_id") * m % 5) / 4000).cast("double") for m in (7, 11, 13, 17, 19)]).alias("loads"))


_LOADS = "l AS (" + " UNION ALL ".join(f"SELECT doc_id AS id, {k} AS topic, CAST(doc_id * {m} % 997 * (doc_id * {m} % 5) / 4000 AS DOUBLE) AS weight FROM documents" for k, m in enumerate((7, 11, 13, 17, 19))) + ")"
_MEMBERS = f"""{_LOADS}, t AS (SELECT topic, max(weight) AS m FROM l GROUP BY 1), i AS (SELECT id, l.topic, weight FROM l JOIN t ON l.topic = t.topic WHERE weight >= greatest(0.05, 0.4 * m)),
m AS (SELECT * FROM i UNION ALL SELECT id, arg_min(topic, struct_pack(a := -weight, b := topic)) AS topic, max(weight) FROM l ANTI JOIN i USING (id) GROUP BY id)"""


@query(f"WITH {_MEMBERS} SELECT id, CAST(topic AS INTEGER) AS topic, round(weight, 6) AS weight FROM m")
def topic_members(spark, d):
    """Documents of each topic, and orphans at their best topic."""
    return topics.members(_loads(spark, d)).select("id", F.col("topic").cast("int").alias("topic"), F.round("weight", 6).alias("weight"))


_TERMS = [[("seam", 0.9), ("coal", 0.5), ("block", 0.4), ("grade", 0.1)], [("safety", 0.8), ("fire", 0.7), ("belt", 0.6)], [("output", 0.5)], [("reserve", 0.4), ("proved", 0.3)], [("land", 0.2), ("water", 0.1)]]
_LABELS = "CASE topic " + " ".join(f"WHEN {i} THEN '{', '.join(t for t, _ in ts[:4])}'" for i, ts in enumerate(_TERMS)) + " END"


def _rebuilt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = dated(spark, d).drop("text")
    t, m = topics.rebuild(topics.members(_loads(spark, d)), _TERMS, docs, "r2", "2024-02-01 00:00:00")
    old, _ = topics.rebuild(topics.members(_loads(spark, d)).where("topic = 0"), _TERMS, docs, "r1", "2024-01-01 00:00:00")
    return old.unionByName(t), m, docs


@query(f"WITH {_DATED}, {_MEMBERS} SELECT CAST(topic AS INTEGER) AS topic, {_LABELS} AS label, count(*) AS doc_count, min(doc_date) AS first_seen, max(doc_date) AS last_seen FROM m JOIN d ON id = document_id GROUP BY topic")
def topics_by_size(spark, d):
    """Topics of the newest of two runs."""
    t, _, _ = _rebuilt(spark, d)
    return topics.by_size(t).select("topic", "label", "doc_count", "first_seen", "last_seen")


@query(f"WITH {_DATED}, {_MEMBERS} SELECT id AS document_id, doc_type, round(weight, 6) AS weight FROM m JOIN d ON id = document_id WHERE topic = 3")
def topic_documents(spark, d):
    _, m, docs = _rebuilt(spark, d)
    return topics.topic_documents(m, docs, 3).select("document_id", "doc_type", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_DATED}, {_MEMBERS}, n AS (SELECT CAST(topic AS INTEGER) AS series, coalesce(strftime(doc_date, '%Y-%m'), 'undated') AS bucket, count(*) AS n FROM m JOIN d ON id = document_id WHERE subsidiary_id = 'src2' OR subsidiary_id IS NULL GROUP BY ALL)
SELECT s.series, b.bucket, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT series FROM n) s CROSS JOIN (SELECT DISTINCT bucket FROM n) b LEFT JOIN n ON n.series = s.series AND n.bucket = b.bucket""")
def topic_trends(spark, d):
    t, m, docs = _rebuilt(spark, d)
    return topics.topic_trends(t, m, docs, "src2")


@query(f"""WITH {_MEMBERS}, k AS (SELECT topic, least(count(*), 6) AS k FROM m JOIN documents ON id = doc_id WHERE n_chars > 9000 GROUP BY 1)
SELECT CAST(t.topic AS INTEGER) AS topic, 'Recurring theme around: ' || CASE t.topic {" ".join(f"WHEN {i} THEN '{', '.join(x for x, _ in ts[:6])}'" for i, ts in enumerate(_TERMS))} END || '. Seen across ' || coalesce(k, 0) || ' document(s).' AS summary
FROM (SELECT DISTINCT topic FROM m) t LEFT JOIN k ON k.topic = t.topic""")
def topic_summaries(spark, d):
    """Summaries from snippets that are not empty."""
    t, m, _ = _rebuilt(spark, d)
    f = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.when(F.col("n_chars") > 9000, "s").otherwise("").alias("source_snippet"))
    return topics.summaries(topics.latest_run(t), m, f)


# ---------------------------------------------------------------- sources


@query("""SELECT doc_id, CASE WHEN lang = 'de' OR doc_id % 5 = 0 THEN 'pdf' WHEN lang = 'fr' OR doc_id % 5 = 1 THEN 'image' ELSE 'text' END AS kind,
  'docs/' || substr(sha256(text), 1, 2) || '/' || sha256(text) || '.' || CASE doc_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'jpg' WHEN 2 THEN 'txt' ELSE 'bin' END AS storage_key FROM documents""")
def stored_files(spark, d):
    """Kinds by MIME type or suffix, and content-addressed keys."""
    x = read(spark, d, "documents")
    ct = F.when(F.col("lang") == "de", "application/PDF").when(F.col("lang") == "fr", "image/webp")
    name = F.concat(F.lit("file"), F.when(F.col("doc_id") % 5 == 0, ".PDF").when(F.col("doc_id") % 5 == 1, ".Jpg").when(F.col("doc_id") % 5 == 2, ".txt").otherwise(""))
    return files.describe(x.select("doc_id", name.alias("filename"), ct.alias("content_type"), F.col("text").cast("binary").alias("content"))).select("doc_id", "kind", "storage_key")


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS page_no FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(page_no AS INTEGER) AS page_no, CASE WHEN length(trim(t)) >= 20 THEN 'pdf_text' ELSE 'ocr' END AS source_kind, CASE WHEN length(trim(t)) >= 20 THEN t ELSE 'recognised' END AS text FROM p""")
def layered_pages(spark, d):
    """A page of less than 20 characters goes to recognition; here lines are the pages."""
    layer = lambda kind, content: [{"page_no": i, "source_kind": "pdf_text", "text": t} for i, t in enumerate(content.decode("utf-8").split("\n"), 1)]
    decoder = files.layered_decoder(layer, lambda content, page_no: {"text": "recognised"})
    x = read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("pdf").alias("kind"), F.col("text").cast("binary").alias("content"))
    return files.pages(x, decoder).select("document_id", "page_no", "source_kind", "text")


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS pos FROM conversations),
l AS (SELECT conv_id, turn, pos % 3 AS line, string_agg(t, ' ' ORDER BY pos) AS t FROM w GROUP BY ALL)
SELECT CAST(conv_id AS VARCHAR) AS document_id, string_agg(t, chr(10) ORDER BY turn, line) AS text FROM l GROUP BY 1""")
def recognised_lines(spark, d):
    """Page texts from single words with their block, paragraph and line."""
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), F.lit(1).alias("page_no"), F.col("turn").alias("block"), F.lit(1).alias("par"), F.posexplode(F.split("text", " ")).alias("pos", "text"))
    return files.ocr_lines(c.withColumn("line", (F.col("pos") + 1) % 3)).select("document_id", "text")


@query("SELECT conv_id AS document_id, string_agg(text, ' ' ORDER BY turn) AS text, min_by(turn * 2, turn) AS embedding FROM conversations GROUP BY 1")
def one_blob(spark, d):
    """A document's chunks in order, and its first vector."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("chunk_index"), "text", (F.col("turn") * 2).alias("embedding"))
    return files.one_blob(c)


@query("SELECT 'doc' || doc_id AS document_id, 'k' || (doc_id % 3) AS key, 1.5 * doc_id AS value FROM documents WHERE doc_id < 1000000")
def truth_by_stem(spark, d):
    """Expected fields found by the stem of a document's file name."""
    x = read(spark, d, "documents")
    docs = x.select(F.concat(F.lit("doc"), "doc_id").alias("document_id"), F.concat(F.lit("in/some.where/report_"), "doc_id", F.lit(".v2.pdf")).alias("filename"))
    truth = x.select(F.concat(F.lit("report_"), "doc_id", F.lit(".v2")).alias("stem"), F.concat(F.lit("k"), F.col("doc_id") % 3).alias("key"), (F.col("doc_id") * 1.5).alias("value"))
    return files.with_truth(docs, truth).select("document_id", "key", "value")


@query("SELECT coalesce(a.k, b.k) AS code, coalesce(b.name, a.name) AS name FROM (SELECT n_nationkey AS k, n_name AS name FROM nation) a FULL JOIN (SELECT s_nationkey AS k, min(s_name) AS name FROM supplier GROUP BY 1) b ON a.k = b.k")
def seeded_units(spark, d):
    """Reference rows by their natural key."""
    old = read(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("name"))
    new = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("code")).agg(F.min("s_name").alias("name"))
    return files.seed(old, new, ["code"])


# ---------------------------------------------------------------- review, lists, dashboards


@query("""SELECT event_id AS field_id, CASE WHEN event_type = 'click' THEN 'verified' WHEN event_type = 'view' AND user_id % 4 <> 0 THEN 'verified' WHEN event_type = 'error' THEN 'rejected' ELSE 'needs_review' END AS status,
  CASE WHEN event_type = 'view' AND user_id % 4 <> 0 THEN CAST(user_id * 1000 AS DOUBLE) + 0.5 ELSE CAST(event_id AS DOUBLE) END AS value, CASE WHEN event_type = 'view' AND user_id % 4 <> 0 THEN CAST(event_id AS VARCHAR) END AS original FROM events""")
def reviewed_fields(spark, d):
    """Confirmed, corrected (the number read anew, the original kept) and rejected fields; a correction without a value is none."""
    e = read(spark, d, "events")
    f = e.select(F.col("event_id").cast("string").alias("field_id"), F.col("event_id").cast("string").alias("value_text"), F.col("event_id").cast("double").alias("value"), F.lit(None).cast("string").alias("iso"), F.lit(None).cast("string").alias("original_value_text"), F.lit(0.4).alias("confidence"), F.lit("needs_review").alias("status"))
    new = F.when(F.col("user_id") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(",000.5")))
    dec = e.select(F.col("event_id").cast("string").alias("field_id"), F.when(F.col("event_type") == "click", "confirm").when(F.col("event_type") == "view", "correct").when(F.col("event_type") == "error", "reject").otherwise("other").alias("decision"), new.alias("new_value"))
    return workflow.review_fields(f, dec).select(F.col("field_id").cast("long").alias("field_id"), "status", "value", F.col("original_value_text").alias("original"))


@query("SELECT c_custkey AS qa_id, c_nationkey + coalesce(n, 0) AS hit_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def cache_hits(spark, d):
    p = read(spark, d, "customer").select(F.col("c_custkey").alias("qa_id"), F.col("c_nationkey").cast("long").alias("hit_count"))
    a = read(spark, d, "orders").select(F.col("o_custkey").alias("qa_id"), F.when(F.col("o_orderstatus") == "F", "cache").otherwise("rag").alias("mode"))
    return workflow.bump_hits(p, a)


@query("SELECT c_custkey AS qa_id, CAST(CASE WHEN c_nationkey > 4 THEN c_nationkey END AS VARCHAR) AS hits FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY CASE WHEN c_nationkey > 4 THEN c_nationkey END DESC NULLS FIRST, CASE WHEN c_acctbal > 0 THEN c_acctbal END DESC NULLS FIRST, c_custkey LIMIT 25")
def cached_first(spark, d):
    """The cache's list: unknown counts lead."""
    c = read(spark, d, "customer")
    p = c.select(F.col("c_custkey").alias("qa_id"), F.when(F.col("c_mktsegment") == "BUILDING", "verified").otherwise("answered").alias("status"), F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("hit_count"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("verified_at"))
    return relational.cached_first(p).limit(25).select("qa_id", F.col("hit_count").cast("string").alias("hits"))


@query("SELECT o_custkey AS document_id, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey % 5 END, -o_totalprice, o_orderkey) AS fields FROM orders GROUP BY 1")
def fields_by_page(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 5).alias("page_no"), F.col("o_totalprice").alias("confidence"), F.col("o_orderkey").alias("field_key"))
    return relational.by_page(o).select("document_id", F.array_join(F.transform("fields", lambda x: x.cast("string")), ",").alias("fields"))


@query("SELECT c_custkey, c_name, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS total FROM customer WHERE c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 20 OFFSET 5")
def page_with_total(spark, d):
    """A page of rows by name, and the number of all."""
    c = read(spark, d, "customer").where("c_acctbal > 0")
    return relational.page_with_total(c, [F.asc("c_name"), F.asc("c_custkey")], 20, 5).select("c_custkey", "c_name", "total")


@query("SELECT event_type, count(*) AS n, (SELECT count(*) FROM events) AS total, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def event_shares(spark, d):
    n = relational.counts(read(spark, d, "events"), "event_type")
    return relational.sum_counts(n, "event_type").select("event_type", "n", "total", F.round("share", 6).alias("share"))


@query("""SELECT event_id AS document_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'ready' END AS status, CAST(json_extract_string(props, '$.k') AS BIGINT) AS fields_extracted, CAST(0 AS BIGINT) AS fields_needs_review,
  (SELECT count(*) FROM events WHERE event_type = 'error') AS failed FROM events ORDER BY ts DESC, event_id LIMIT 30""")
def ingestion_monitor(spark, d):
    e = read(spark, d, "events")
    docs = e.select(F.col("event_id").alias("document_id"), F.when(F.col("event_type") == "error", "failed").otherwise("ready").alias("status"), F.col("ts").alias("created_at"), F.concat(F.lit('{"pipeline": {"fields_extracted": '), F.get_json_object("props", "$.k"), F.lit("}}")).alias("meta"))
    return workflow.monitor(docs).select("document_id", "status", "fields_extracted", "fields_needs_review", "failed")


@query("""SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'values', count(*) FROM lineitem UNION ALL SELECT 'confirmed', count(*) FROM lineitem WHERE l_returnflag <> 'R'
UNION ALL SELECT 'entities', count(*) FROM part UNION ALL SELECT 'outputs', count(*) FROM orders UNION ALL SELECT 'trusted', count(*) FROM lineitem WHERE l_returnflag <> 'R' UNION ALL SELECT 'high', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def dashboard(spark, d):
    """The funnel and the key figures."""
    docs, li, o = read(spark, d, "documents"), read(spark, d, "lineitem"), read(spark, d, "orders")
    f = li.select(F.when(F.col("l_returnflag") == "R", "needs_review").when(F.col("l_returnflag") == "A", "verified").otherwise("auto_accepted").alias("status"))
    findings = o.select(F.when(F.col("o_orderpriority") == "1-URGENT", "high").otherwise("low").alias("severity"))
    return workflow.funnel(docs, f, read(spark, d, "part"), o).unionByName(workflow.kpis(f, findings, docs).where("name <> 'documents'"))


@query("""WITH e AS (SELECT l_partkey, l_returnflag AS category, l_quantity AS value, strftime(l_shipdate, '%Y-%m-%d') AS as_on FROM lineitem),
g AS (SELECT l_partkey, category, min_by(value, as_on || lpad(CAST(CAST(value AS INTEGER) AS VARCHAR), 3, '0')) AS old, max_by(value, as_on || lpad(CAST(CAST(value AS INTEGER) AS VARCHAR), 3, '0')) AS new FROM e GROUP BY 1, 2)
SELECT CAST(l_partkey AS VARCHAR) AS signature, category, old, new, round((new - old) / old, 6) AS change, max(greatest(old, new)) OVER (PARTITION BY l_partkey) AS scale FROM g""")
def evidence_pairs(spark, d):
    """First and last value of each figure in a finding, the change and the bar's scale."""
    e = F.struct(F.col("l_returnflag").alias("category"), F.col("l_quantity").alias("value"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("as_on"))
    f = read(spark, d, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("signature")).agg(F.collect_list(e).alias("evidence"))
    return workflow.evidence_pairs(f).withColumn("change", F.round("change", 6))


@query("SELECT CAST(o_custkey AS VARCHAR) AS document_id, count(*) AS citations, round(avg(o_totalprice), 4) AS confidence FROM orders GROUP BY 1")
def cited_documents(spark, d):
    o = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("document_id"), F.col("o_totalprice").alias("confidence"))
    return workflow.cited_documents(o).withColumn("confidence", F.round("confidence", 4))


@query("""WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM events)
SELECT n AS calls, n / 50.0 AS per_second, v[1 + CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT)] AS p50, v[1 + CAST(floor(0.99 * (n - 1) + 0.5) AS BIGINT)] AS p99, errors FROM s""")
def load_summary(spark, d):
    c = read(spark, d, "events").select(F.col("value").alias("ms"), (F.col("event_type") != "error").alias("ok"))
    return workflow.load_summary(c, 50).select("calls", "per_second", "p50", "p99", "errors")


@query("""SELECT doc_id AS document_id, CAST(o_orderkey AS VARCHAR) AS report_id FROM (SELECT doc_id, o_orderkey FROM documents LEFT JOIN (SELECT * FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1) ON o_custkey = doc_id + 1 WHERE lang <> 'es')""")
def reset_corpus(spark, d):
    """After a reset: documents of known names, and the newest report of each title."""
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("filename"))
    names = spark.createDataFrame([("en",), ("fr",), ("de",)], "filename string")
    reps = read(spark, d, "orders").select(F.col("o_custkey").alias("title"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("report_id"))
    kept, _, new = workflow.reset(docs, names, docs.select("document_id"), reps)
    return kept.join(new, F.col("title") == F.col("document_id") + 1, "left").select("document_id", F.col("report_id").cast("string").alias("report_id"))


@query("SELECT event_id AS signature, CASE WHEN user_id % 3 = 1 THEN 'dismissed' WHEN user_id % 3 = 2 THEN 'acknowledged' ELSE 'open' END AS status FROM events")
def reviewed_findings(spark, d):
    """Findings after review; nothing goes back to open."""
    from docmill.operators import anomalies

    e = read(spark, d, "events")
    stored = e.select(F.col("event_id").alias("signature"), F.lit("open").alias("status"))
    state = F.when(F.col("user_id") % 3 == 1, "dismissed").when(F.col("user_id") % 3 == 2, "acknowledged").otherwise("open")
    return anomalies.review(stored, e.select(F.col("event_id").alias("signature"), state.alias("decision")))


# ---------------------------------------------------------------- versions and the audit log


@query("""WITH v AS (SELECT o_custkey AS report_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS version_no, 'a' || chr(10) || o_orderstatus || chr(10) || o_orderpriority AS body, o_orderstatus AS s, o_orderpriority AS p FROM orders),
d AS (SELECT *, lag(s) OVER w AS s0, lag(p) OVER w AS p0 FROM v WINDOW w AS (PARTITION BY report_id ORDER BY version_no))
SELECT CAST(report_id AS VARCHAR) AS report_id, version_no, CASE WHEN s0 IS NULL THEN 3 ELSE CAST(s <> s0 AS INTEGER) + CAST(p <> p0 AS INTEGER) END AS added, CASE WHEN s0 IS NULL THEN 0 ELSE CAST(s <> s0 AS INTEGER) + CAST(p <> p0 AS INTEGER) END AS removed FROM d""")
def version_history(spark, d):
    """Lines that each version added and took away: customers are reports, their orders the versions."""
    from pyspark.sql import Window

    o = read(spark, d, "orders")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    v = o.select(F.col("o_custkey").cast("string").alias("report_id"), n.alias("version_no"), F.lit("ai").alias("author_kind"), F.concat_ws("\n", F.lit("a"), "o_orderstatus", "o_orderpriority").alias("body"), F.lit(0).alias("unresolved"))
    return reports.history(v).select("report_id", F.col("version_no").cast("long").alias("version_no"), "added", "removed")


@query("SELECT o_orderkey, 'Report-' || o_orderkey || '-' || replace(o_orderpriority, ' ', '-') || '-v1' AS stem FROM orders")
def file_stems(spark, d):
    """ASCII file stems of report titles."""
    o = read(spark, d, "orders")
    title = F.concat(F.lit("«Report» "), F.col("o_orderkey").cast("string"), F.lit(" — "), "o_orderpriority", F.lit(" (v1)"))
    return o.select("o_orderkey", reports.stem_column(title).alias("stem"))


def _log(spark: SparkSession, d: str) -> DataFrame:
    """A true chain of a thousand entries at most per actor, all actors' entries by seq."""
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor"), F.col("event_type").alias("action"), F.lit("t").alias("target_type"), F.lit(None).cast("string").alias("target_id"), F.col("props").alias("meta"), F.lit(None).cast("string").alias("prev_hash"), F.lit(None).cast("string").alias("entry_hash"))
    return audit.rehash(e)


@query("SELECT true AS ok, count(*) AS checked, CAST(NULL AS BIGINT) AS first_broken_seq, CAST(NULL AS VARCHAR) AS detail FROM events")
def audit_verify(spark, d):
    return audit.verify(_log(spark, d))


@query("""WITH b AS (SELECT min(event_id) AS seq FROM events WHERE event_type = 'error') SELECT false AS ok, (SELECT count(*) FROM events) AS checked, seq AS first_broken_seq, 'entry_hash mismatch at seq ' || seq AS detail FROM b""")
def audit_tampered(spark, d):
    """Bodies of all error entries were changed afterwards; the first of them is found."""
    log = _log(spark, d)
    return audit.verify(log.withColumn("meta", F.when(F.col("action") == "error", F.lit('{"forged": 1}')).otherwise(F.col("meta"))))


@query("""WITH x AS (SELECT event_id AS seq, row_number() OVER (ORDER BY event_id) AS n FROM events), cut AS (SELECT seq FROM x WHERE n % 100 <> 50), g AS (SELECT min(a.seq) AS seq FROM cut a WHERE a.seq > (SELECT seq FROM x WHERE n = 50))
SELECT false AS ok, (SELECT count(*) FROM cut) AS checked, seq AS first_broken_seq, 'prev_hash mismatch at seq ' || seq AS detail FROM g""")
def audit_cut(spark, d):
    """Every hundredth entry was cut out: the entry behind the first gap is found."""
    log = _log(spark, d)
    ids = read(spark, d, "events").agg(F.min("event_id")).first()[0]
    return audit.verify(log.where((F.col("seq") - ids + 1) % 100 != 50))


# ---------------------------------------------------------------- scalars


@query("""SELECT p_partkey, trim(regexp_replace(lower(replace(p_name, ' ', ' - ')), '[^a-z0-9_]+', ' ', 'g')) AS question, CASE p_size % 4 WHEN 0 THEN 'million_tonnes' WHEN 1 THEN 'lakh_cubic_metre' WHEN 2 THEN 'furlong' ELSE 'percent' END AS unit,
  p_size % 2 = 0 AS mine, p_size % 3 = 0 AS org, p_name || ' Top' AS cut, p_name || ' [[c:' || p_size || ']]' AS marked FROM part""")
def text_functions(spark, d):
    """Questions, units, mine and organisation words, labels, markers."""
    p = read(spark, d, "part")
    unit = F.when(F.col("p_size") % 4 == 0, " MT ").when(F.col("p_size") % 4 == 1, "Lakh CUM").when(F.col("p_size") % 4 == 2, "Furlong").otherwise("%")
    mine = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" KHADAN"))).otherwise(F.lit("no such"))
    org = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit(" Corporation"))).when(F.col("p_size") % 3 == 1, F.lit("A Ltd")).otherwise(F.col("p_name"))
    marked = F.concat("p_name", F.lit(" ["), F.col("p_size").cast("string"), F.lit("]"))
    return p.select("p_partkey", T.normalize_question(F.replace("p_name", F.lit(" "), F.lit(" - "))).alias("question"), T.canon_unit(unit).alias("unit"), T.looks_like_mine(mine).alias("mine"), T.plausible_org(org).alias("org"), T.before_label(F.concat("p_name", F.lit(" Top  Date : 1"))).alias("cut"), T.markers(marked).alias("marked"))


@query(f"SELECT doc_id, string_agg(term, ' ' ORDER BY term) AS normalized FROM {TERMS_SQL} GROUP BY 1")
def normalized_text(spark, d):
    """Texts as their concepts, here in alphabetical order (documents of none are left out)."""
    x = read(spark, d, "documents").select("doc_id", T.normalized_text(F.col("text")).alias("t")).where("t <> ''")
    return x.select("doc_id", F.array_join(F.array_sort(F.split("t", " ")), " ").alias("normalized"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month FROM orders""")
def parsed_dates(spark, d):
    """Days in six spellings, and months, as dates."""
    o = read(spark, d, "orders")
    kinds = ["d.M.yyyy", "dd-MM-yyyy", "yyyy/M/d", "d MMMM yyyy", "dd-MMM-yyyy", "yyyy-MM-dd"]
    raw = None
    for i, k in enumerate(kinds):
        shown = F.upper(F.date_format("o_orderdate", k)) if "MMM-" in k else F.date_format("o_orderdate", k)
        raw = F.when(F.col("o_orderkey") % len(kinds) == i, shown) if raw is None else raw.when(F.col("o_orderkey") % len(kinds) == i, shown)
    return o.select("o_orderkey", T.parse_date(raw).cast("string").alias("day"), T.parse_date(F.date_format("o_orderdate", "MMMM yyyy")).cast("string").alias("month"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'It is so [[c:1]].' ELSE 'It is so. [[c:1]]' || CASE WHEN c_custkey % 3 = 2 THEN ' [[c:2]]' ELSE '' END END AS answer, CASE WHEN c_custkey % 3 = 0 THEN 0.9 ELSE 0.765 END AS confidence FROM customer""")
def marked_answers(spark, d):
    """Written answers with citation markers; those without any get them, and less confidence."""
    c = read(spark, d, "customer")
    k = F.col("c_custkey") % 3
    text, conf = retrieval.with_markers(F.when(k == 0, "It is so [1].").otherwise("It is so."), F.lit(0.9), F.when(k == 0, 4).otherwise(k).cast("int"))
    return c.select("c_custkey", text.alias("answer"), conf.alias("confidence"))


@query("""SELECT a.p_partkey, a.p_brand = b.p_brand OR contains(a.p_name, b.p_name) OR contains(b.p_name, a.p_name) OR (length(a.p_name) > 0 AND list_has_all(string_split(lower(a.p_name), ' '), string_split(lower(b.p_name), ' '))) AS matched
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1""")
def text_matches(spark, d):
    """Names that are equal, within each other or token for token in each other; here brands stand in for equal texts."""
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    n = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("n2"), F.col("p_brand").alias("b2"))
    j = p.join(n, "p_partkey")
    return j.select("p_partkey", (metrics.text_matches(F.col("p_name"), F.col("n2")) | (F.col("p_brand") == F.col("b2"))).alias("matched"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal = floor(s_acctbal) THEN CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.2f', s_acctbal), '0$', '') END || ' million tonnes' AS shown FROM supplier")
def shown_quantities(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", V.format_quantity(F.col("s_acctbal"), F.lit("million_tonnes")).alias("shown"))


@query(CHUNKS_SQL.format(cols="md5(text) AS digest"))
def chunk_digests(spark, d):
    """Chunks of every document, by the digest of their texts."""
    return chunk.chunk_pages(read(spark, d, "documents"), "doc_id", "text", None).select("doc_id", "chunk_index", F.md5("text").alias("digest"))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_name ILIKE '%er#%1%' ORDER BY c_name, c_custkey LIMIT 1")
def anchor_by_name(spark, d):
    """The first thing whose name fits a pattern."""
    e = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit("block").alias("kind"), F.col("c_name").alias("name"))
    return reports.anchor_by_name(e, "ER#%1", ["block"]).select("id", "name")


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey % 2 = 0 THEN 'block' ELSE 'mine' END AS kind, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0 ORDER BY kind, name, id LIMIT 200")
def report_targets(spark, d):
    c = read(spark, d, "customer")
    e = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") % 2 == 0, "block").otherwise("mine").alias("kind"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("owner"))
    return reports.targets(e, ["block", "mine"], "BUILDING")


