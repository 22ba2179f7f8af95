"""Queries over the stored tables, one or more for every dataflow of the engine, each with its SQL where there is one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import anomalies, audit, chunk, classify, graph, metrics, relational, retrieval, topics, vector_index
from docmill.plans.registry import Registry, read
from docmill.sources.store import Store

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql
_t = read


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _map_sql(table: dict[str, str], x: str) -> str:
    return "CASE " + x + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {x} END"


_TOKENS_SQL = f"""(SELECT doc_id, {_map_sql(T.SYNONYMS, 't')} AS term FROM (
  SELECT doc_id, {_map_sql(T.ROMAN_HINDI, 't')} AS t FROM (
    SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z\\x{{0900}}-\\x{{097F}}]{{3,}}'))) AS t FROM documents)))"""
TERMS_SQL = f"(SELECT doc_id, term FROM {_TOKENS_SQL} WHERE length(term) >= 3 AND term NOT IN ({_quoted(T.STOPWORDS)}))"


@query(f"""WITH n AS (SELECT term, count(*) AS n FROM {TERMS_SQL} GROUP BY term ORDER BY n DESC, term LIMIT 60)
SELECT term, n, round(n / max(n) OVER (), 3) AS weight FROM n""")
def word_cloud(spark, d):
    return topics.word_cloud(_t(spark, d, "documents"))


def _case_scores() -> dict[str, str]:
    return {k: " + ".join(f"CASE WHEN contains(h, '{w}') THEN {n} ELSE 0 END" for w, n in ws) for k, ws in classify.RULES.items()}


@query(
    "WITH h AS (SELECT doc_id, lower(text) AS h FROM documents), s AS (SELECT doc_id, "
    + ", ".join(f"{e} AS s_{k}" for k, e in _case_scores().items())
    + " FROM h) SELECT doc_id, CASE WHEN greatest("
    + ", ".join(f"s_{k}" for k in classify.RULES)
    + ") < 3 THEN 'unknown' "
    + " ".join(f"WHEN s_{k} = greatest({', '.join(f's_{j}' for j in classify.RULES)}) THEN '{k}'" for k in classify.RULES)
    + " END AS doc_type, CAST(greatest("
    + ", ".join(f"s_{k}" for k in classify.RULES)
    + ") AS INTEGER) AS score FROM s"
)
def term_weighted_classify(spark, d):
    scores = classify.type_scores(F.lower("text"))
    x = _t(spark, d, "documents").select("doc_id", *[s.alias(f"s_{k}") for k, s in scores.items()])
    held = {k: F.col(f"s_{k}") for k in scores}
    return x.select("doc_id", classify.best_type(held).alias("doc_type"), F.greatest(*held.values()).cast("int").alias("score"))


@query("""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\\x{0900}-\\x{097F}]')) AS dev, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]')) AS words FROM documents)
SELECT doc_id, CAST(words AS INTEGER) AS words, CASE WHEN dev = 0 THEN 'en' WHEN dev / greatest(1, words) > 0.25 THEN 'hi' ELSE 'mixed' END AS language FROM c""")
def language_ratio(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(T.WORD)).alias("words"), T.detect_language(F.col("text")).alias("language"))


@query("SELECT sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1")
def sha_dedupe(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return x.groupBy("sha256").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def newest_per_key(spark, d):
    x = relational.newest(_t(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")])
    return x.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"))


@query("SELECT d.doc_id, d.source, l.quality, d.n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic = 0 ORDER BY l.quality, d.n_chars, d.doc_id LIMIT 300")
def review_queue(spark, d):
    j = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").where(V.equal_if_given(toxic=0, quality=None))
    return relational.page(j, [F.asc("quality"), F.asc("n_chars"), F.asc("doc_id")], 1000, cap="review").select("doc_id", "source", "quality", "n_chars")


@query("SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN (SELECT n_nationkey, n_name, nullif(n_regionkey, 0) AS owner FROM nation) n ON c.c_nationkey = n.n_nationkey WHERE n.owner = 2 OR n.owner IS NULL")
def row_scope(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", "n_name", F.nullif("n_regionkey", F.lit(0)).alias("owner")).where(V.scope(F.col("owner"), 2))
    return _t(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "n_name")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_name ILIKE '%Ring%' OR p_type ILIKE '%econ%'")
def substring_search(spark, d):
    p = _t(spark, d, "part")
    return p.where(V.like_any("Ring", F.col("p_name")) | V.like_any("econ", F.col("p_type"))).select("p_partkey", "p_name", "p_type")


_AS_OF = dt.datetime(1998, 6, 1)


@query("""SELECT o.o_orderkey, o.o_custkey, strftime(o.o_orderdate, '%Y-%m-%d') AS valid_from, strftime(max(l.l_shipdate), '%Y-%m-%d') AS valid_to
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderkey, o.o_custkey, o.o_orderdate
HAVING CAST(o.o_orderdate AS DATE) <= DATE '1998-06-01' AND (max(l.l_shipdate) IS NULL OR CAST(max(l.l_shipdate) AS DATE) >= DATE '1998-06-01')""")
def asof_valid_edges(spark, d):
    ship = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").cast("date").alias("valid_to"))
    e = _t(spark, d, "orders").join(ship, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("valid_from"), "valid_to")
    now = e.where(V.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(_AS_OF.date())))
    return now.select("o_orderkey", "o_custkey", F.col("valid_from").cast("string"), F.col("valid_to").cast("string"))


@query("""WITH e AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'placed' AS predicate FROM orders
UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'holds' FROM lineitem),
f AS (SELECT 'o' || o_orderkey AS id FROM orders WHERE o_totalprice > 400000)
SELECT vertex, other_id, direction, predicate FROM (SELECT src AS vertex, dst AS other_id, 'out' AS direction, predicate FROM e SEMI JOIN f ON e.src = f.id
UNION ALL SELECT dst, src, 'in', predicate FROM e SEMI JOIN f ON e.dst = f.id)""")
def neighbors(spark, d):
    o, li = _t(spark, d, "orders"), _t(spark, d, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = o.select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("placed").alias("predicate"))
    e = e.unionByName(li.select(name("o", "l_orderkey").alias("src"), name("p", "l_partkey").alias("dst"), F.lit("holds").alias("predicate")))
    at = o.where(F.col("o_totalprice") > 400_000).select(name("o", "o_orderkey").alias("id"))
    return graph.neighbours(e, None, at).select(F.col("at").alias("vertex"), "other_id", "direction", "predicate")


@query("SELECT c.c_custkey, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def two_hop(spark, d):
    c, n = _t(spark, d, "customer"), _t(spark, d, "nation")
    e = n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"), F.lit("in_region").alias("predicate"))
    e = e.unionByName(c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.lit("in_nation").alias("predicate")))
    start = c.select(F.col("c_custkey").alias("origin"), F.concat(F.lit("c"), "c_custkey").alias("id"))
    end = graph.hop(graph.hop(start, e, "in_nation"), e, "in_region")
    r = _t(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), "r_name")
    return end.join(r, "id").select(F.col("origin").alias("c_custkey"), "r_name")


@query("""WITH v AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION SELECT o_orderkey + 1000000000 FROM orders WHERE o_totalprice > 200000)
SELECT o_custkey AS src, o_orderkey + 1000000000 AS dst FROM orders WHERE o_custkey IN (SELECT id FROM v) AND o_orderkey + 1000000000 IN (SELECT id FROM v)""")
def induced_subgraph(spark, d):
    o = _t(spark, d, "orders").withColumn("dst", F.col("o_orderkey") + 1_000_000_000)
    v = _t(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id")).union(o.where("o_totalprice > 200000").select("dst"))
    return graph.induced(o.select(F.col("o_custkey").alias("src"), "dst"), v)


@query("""WITH e AS (SELECT o_custkey AS src, o_orderkey + 1000000000 AS dst FROM orders WHERE o_orderstatus = 'P')
SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey IN (SELECT src FROM e)""")
def touched_vertices(spark, d):
    e = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000).alias("dst"))
    return graph.touched(e, _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"))


_TOK = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: length(t) > 2))"


@query(f"""WITH b AS (SELECT item_id, unnest({_TOK.format("split_part(text, '.', 1)")}) AS t FROM benchmark),
p AS (SELECT p_partkey, unnest(list_filter({_TOK.format("p_name || ' ' || p_type")}, lambda t: t NOT IN ({_quoted(retrieval.GENERIC)}))) AS t FROM part),
s AS (SELECT item_id, doc_id FROM b JOIN (SELECT doc_id, unnest({_TOK.format("text")}) AS t FROM documents) x USING (t) GROUP BY ALL HAVING count(*) >= 6)
SELECT DISTINCT item_id, doc_id FROM s""")
def token_overlap_match(spark, d):
    b = _t(spark, d, "benchmark").select("item_id", F.explode(T.match_tokens(F.split("text", r"\.")[0])).alias("t"))
    x = _t(spark, d, "documents").select("doc_id", F.explode(T.match_tokens(F.col("text"))).alias("t"))
    # the questions' tokens are few; a token's documents are counted by partial sums, never paired with each other
    return b.join(x, "t").groupBy("item_id", "doc_id").agg(F.count("*").alias("n")).where("n >= 6").select("item_id", "doc_id")


_NEAR = "(SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0)"


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)), 4) AS score FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) DESC, vec_id LIMIT 8")
def vector_topk(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()["embedding"]
    return chunk.top_k(e, q, 8, "vec_id").select("vec_id", "score")


@query(f"SELECT query_id, vec_id, round(score, 4) AS score, score >= 0.9 AS hit FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM {_NEAR} WHERE query_id <> vec_id) WHERE n = 1")
def vector_cache_hit(spark, d):
    e = _t(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vector_index.build(Store(spark, "cache"), e, "vec_id")
    near = vector_index.search_exact(index, q, 2, "query_id").withColumnRenamed("id", "vec_id").where("query_id <> vec_id")
    return relational.newest(near, ["query_id"], [F.col("rank")]).select("query_id", "vec_id", "score", (F.col("score") >= retrieval.CACHE_HIT).alias("hit"))


_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
_UNITS = f"list_filter(string_split(regexp_replace(regexp_replace(trim(text, {_BLANK}), '([.!?])\\s+', '\\1' || chr(31), 'g'), '\\n{{2,}}', chr(31), 'g'), chr(31)), lambda u: trim(u, {_BLANK}) <> '')"
_LAST = "array_extract(string_split(acc, chr(30)), -1)"
#: Chunks by a fold over a document's sentences; finished chunks and the open one are parted by chr(30).
CHUNKS_SQL = (
    f"""WITH u AS (SELECT doc_id, list_prepend('', list_transform({_UNITS}, lambda u: trim(u, {_BLANK}))) AS us FROM documents),
c AS (SELECT doc_id, list_reduce(us, lambda acc, u: CASE WHEN {_LAST} = '' THEN acc || u WHEN length({_LAST}) + 1 + length(u) > 600 THEN acc || chr(30) || trim(trim(right({_LAST}, 90)) || ' ' || u) ELSE acc || ' ' || u END) AS acc FROM u),
x AS (SELECT doc_id, CAST(generate_subscripts(string_split(acc, chr(30)), 1) - 1 AS INTEGER) AS chunk_index, unnest(string_split(acc, chr(30))) AS text FROM c WHERE acc <> '')
SELECT doc_id, chunk_index, """.replace("{", "{{").replace("}", "}}")
    + "{cols} FROM x"
)


@query(CHUNKS_SQL.format(cols="text"))
def chunk_documents(spark, d):
    return chunk.chunk_pages(_t(spark, d, "documents"), "doc_id", "text", None)


@query(CHUNKS_SQL.format(cols="CAST(384 AS INTEGER) AS dim, CAST(1 AS DOUBLE) AS norm"))
def embed_chunks(spark, d):
    c = chunk.chunk_pages(_t(spark, d, "documents"), "doc_id", "text", None)
    return chunk.embed(c).select("doc_id", "chunk_index", F.size("embedding").alias("dim"), F.round(V.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm"))


@query("""WITH n AS (SELECT o_orderpriority AS series, strftime(o_orderdate, '%Y-%m') AS bucket, count(*) AS n FROM orders GROUP BY ALL)
SELECT s.series, b.bucket, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT series FROM n) s CROSS JOIN (SELECT DISTINCT bucket FROM n) b LEFT JOIN n ON n.series = s.series AND n.bucket = b.bucket""")
def monthly_trend(spark, d):
    return topics.monthly_trend(_t(spark, d, "orders"), "o_orderpriority", "o_orderdate")


_KINDS = ["click", "view", "signup", "purchase", "error"]


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS) + " FROM events GROUP BY 1")
def kind_severity_pivot(spark, d):
    return relational.matrix(_t(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "day", "event_type", _KINDS)


@query("SELECT CASE WHEN grouping(o_orderstatus) = 0 THEN 'o_orderstatus' WHEN grouping(o_orderpriority) = 0 THEN 'o_orderpriority' END AS dimension, CASE WHEN grouping(o_orderstatus) = 0 THEN o_orderstatus WHEN grouping(o_orderpriority) = 0 THEN o_orderpriority END AS value, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def anomaly_summary(spark, d):
    return relational.summary(_t(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("""SELECT event_id, event_type, value, CASE WHEN event_type = 'error' AND value <= 0 THEN 'not positive' WHEN value < 0 OR value > 150 THEN 'out of range' END AS reason FROM events
WHERE (event_type = 'error' AND value <= 0) OR value < 0 OR value > 150""")
def out_of_range(spark, d):
    reason = F.when((F.col("event_type") == "error") & (F.col("value") <= 0), "not positive").when(~F.col("value").between(0, 150), "out of range")
    return _t(spark, d, "events").select("event_id", "event_type", "value", reason.alias("reason")).where("reason is not null")


@query("""WITH g AS (SELECT DISTINCT a.l_partkey, a.l_suppkey FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
WHERE abs(a.l_quantity - b.l_quantity) > greatest(0.01, 0.02 * greatest(abs(a.l_quantity), abs(b.l_quantity))))
SELECT l.l_partkey, l.l_suppkey, CASE WHEN count(DISTINCT CAST(l_shipdate AS DATE)) > 1 THEN 'revision' ELSE 'contradiction' END AS kind, count(*) AS n, min(l_quantity) AS low, max(l_quantity) AS high
FROM lineitem l JOIN g ON l.l_partkey = g.l_partkey AND l.l_suppkey = g.l_suppkey GROUP BY ALL""")
def revision_contradiction(spark, d):
    g = _t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.count("*").alias("n"), F.count_distinct(F.col("l_shipdate").cast("date")).alias("days"))
    return g.where((F.col("n") > 1) & V.differs(F.col("low"), F.col("high"))).select("l_partkey", "l_suppkey", F.when(F.col("days") > 1, "revision").otherwise("contradiction").alias("kind"), "n", "low", "high")


@query("""WITH s AS (SELECT l_orderkey, sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(38, 6))) AS total FROM lineitem GROUP BY 1)
SELECT o.o_orderkey, o.o_totalprice, round(CAST(coalesce(s.total, 0) AS DOUBLE), 2) AS line_total FROM orders o LEFT JOIN s ON o.o_orderkey = s.l_orderkey
WHERE abs(o.o_totalprice - CAST(coalesce(s.total, 0) AS DOUBLE)) > greatest(0.01, 0.02 * greatest(abs(o.o_totalprice), abs(CAST(coalesce(s.total, 0) AS DOUBLE))))""")
def sum_mismatch(spark, d):
    price = (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).cast("decimal(38,6)")
    s = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(price).cast("double").alias("s"))
    j = _t(spark, d, "orders").join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    return j.where(V.differs(F.col("o_totalprice"), F.col("s"))).select("o_orderkey", "o_totalprice", F.round("s", 2).alias("line_total"))


@query("""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sd FROM events GROUP BY 1 HAVING count(*) >= 4)
SELECT e.event_id, e.event_type, e.value FROM events e JOIN g USING (event_type) WHERE g.sd > 0 AND abs(e.value - g.m) > 2.5 * g.sd""")
def trend_break(spark, d):
    return anomalies.outliers(_t(spark, d, "events").select("event_id", "event_type", "value"), ["event_type"]).select("event_id", "event_type", "value")


_STORED = "SELECT 'u' || user_id AS signature, CASE WHEN user_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, max(value) AS score FROM events WHERE day(ts) % 2 = 1 GROUP BY user_id"
_FOUND = "SELECT 'u' || user_id AS signature, max(value) AS score FROM events WHERE day(ts) % 2 = 0 GROUP BY user_id"


@query(f"""WITH s AS ({_STORED}), f AS ({_FOUND})
SELECT coalesce(s.signature, f.signature) AS signature,
CASE WHEN s.signature IS NULL THEN 'open' WHEN s.status = 'open' AND f.signature IS NULL THEN 'resolved' ELSE s.status END AS status,
CASE WHEN s.signature IS NULL THEN 'created' WHEN f.signature IS NOT NULL AND s.status = 'open' THEN 'updated' WHEN s.status = 'open' THEN 'auto_resolved' WHEN f.signature IS NOT NULL THEN 'kept' ELSE 'gone' END AS change,
CASE WHEN f.signature IS NOT NULL AND (s.signature IS NULL OR s.status = 'open') THEN f.score ELSE s.score END AS score
FROM s FULL JOIN f ON s.signature = f.signature""")
def merge_findings(spark, d):
    e = _t(spark, d, "events").withColumn("day", F.col("ts").cast("date")).withColumn("signature", F.concat(F.lit("u"), F.col("user_id").cast("string")))
    part = lambda n: e.where(F.dayofmonth("day") % 2 == n % 2).groupBy("user_id", "signature").agg(F.max("value").alias("score"))
    stored = part(1).withColumn("status", F.when(F.col("user_id") % 3 == 0, "resolved").otherwise("open"))
    return anomalies.merge(stored, part(2), ["score"])


@query("""SELECT d.source, count(*) AS n, count(l.doc_id) AS labelled, round(coalesce(avg(l.quality), 0), 6) AS mean_quality,
count(*) FILTER (d.n_chars > 1500 AND l.quality = 1) AS tp, count(*) FILTER (d.n_chars > 1500 AND l.quality = 0) AS fp, count(*) FILTER (d.n_chars <= 1500 AND l.quality = 1) AS fn,
round(coalesce(count(*) FILTER (d.n_chars > 1500 AND l.quality = 1) / nullif(count(*) FILTER (d.n_chars > 1500 AND l.quality IS NOT NULL), 0), 0), 6) AS precision
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def quality_metrics(spark, d):
    j = _t(spark, d, "documents").select("doc_id", "source", "n_chars").join(_t(spark, d, "labels"), "doc_id", "left")
    base = j.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.round(F.coalesce(F.avg("quality"), F.lit(0.0)), 6).alias("mean_quality"))
    p = metrics.prf(j.where("quality is not null"), ["source"], F.col("quality") == 1, F.col("n_chars") > 1500).select("source", "tp", "fp", "fn", F.round("precision", 6).alias("precision"))
    zero = {"tp": 0, "fp": 0, "fn": 0, "precision": 0.0}
    return base.join(p, "source", "left").na.fill(zero)


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, v[1 + CAST(floor(0.5 * (n - 1) + 0.5) AS BIGINT)] AS p50, v[1 + CAST(floor(0.95 * (n - 1) + 0.5) AS BIGINT)] AS p95, v[n] AS top FROM s""")
def latency_percentiles(spark, d):
    return metrics.percentiles(_t(spark, d, "events"), "value", ["event_type"], {"p50": 0.5, "p95": 0.95, "top": 1.0})


_ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _ALL))
def overview_counts(spark, d):
    return relational.overview({t: _t(spark, d, t) for t in _ALL})


@query("SELECT 'entity' AS what, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus) UNION ALL SELECT 'relation', l_returnflag, count(*) FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def graph_stats(spark, d):
    return graph.stats(_t(spark, d, "orders").withColumnRenamed("o_orderstatus", "kind"), _t(spark, d, "lineitem").withColumnRenamed("l_returnflag", "predicate"))


@query(f"""WITH tf AS (SELECT doc_id AS id, term, count(*) AS tf FROM {TERMS_SQL} WHERE regexp_full_match(term, '[a-z][a-z_]{{2,}}') GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) <= 0.9 * (SELECT n FROM n)),
w AS (SELECT id, term, tf * (ln((1.0 + (SELECT n FROM n)) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term)),
s AS (SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 4) AS weight FROM w)
SELECT id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS k FROM s) WHERE k <= 12""")
def tfidf_top_terms(spark, d):
    docs = _t(spark, d, "documents")
    w = topics.tfidf(topics.terms_of(docs, "doc_id", bigrams=False), docs.count()).withColumn("weight", F.round("weight", 4))
    win = Window.partitionBy("id").orderBy(F.desc("weight"), "term")
    return w.withColumn("k", F.row_number().over(win)).where(F.col("k") <= topics.TOP_TERMS).drop("k")


@query()
def nmf_topics(spark, d):
    m, _ = topics.fit_topics(_t(spark, d, "documents"), "doc_id", n_topics=5)
    return m.select("id", "topic", F.round("weight", 4).alias("weight"))


@query("""WITH l AS (SELECT event_id AS seq, sha256(event_id || '|' || event_type || '|' || user_id) AS h FROM events),
c AS (SELECT seq, h, lag(h) OVER (ORDER BY seq) AS prev FROM l)
SELECT count(*) AS checked, count(*) FILTER (prev IS NULL) AS heads, min(seq) FILTER (substr(h, 1, 2) = substr(prev, 1, 2)) AS first_hit, CAST(sum(CAST('0x' || substr(md5(seq || coalesce(prev, '')), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM c""")
def audit_chain_verify(spark, d):
    body = F.concat_ws("|", F.col("event_id").cast("string"), "event_type", F.col("user_id").cast("string"))
    log = _t(spark, d, "events").select(F.col("event_id").alias("seq"), F.sha2(body, 256).alias("entry_hash"))
    x = audit.with_previous(log)
    hit = F.substring("entry_hash", 1, 2) == F.substring("_prev", 1, 2)
    # a digest of every entry with the one before it; sums need no order
    digest = F.sum(F.conv(F.substring(F.md5(F.concat(F.col("seq").cast("string"), F.coalesce("_prev", F.lit("")))), 1, 8), 16, 10).cast("long"))
    return x.agg(F.count("*").alias("checked"), F.count_if(F.col("_prev").isNull()).alias("heads"), F.min(F.when(hit, F.col("seq"))).alias("first_hit"), digest.alias("digest"))


@query("""WITH f AS (SELECT conv_id, role, text, min(turn) AS pos FROM conversations GROUP BY ALL)
SELECT conv_id, role, pos, row_number() OVER (PARTITION BY conv_id ORDER BY pos, role, text) AS marker FROM f""")
def citation_groups(spark, d):
    f = _t(spark, d, "conversations").groupBy("conv_id", "role", "text").agg(F.min("turn").alias("pos"))
    return f.select("conv_id", "role", "pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("pos", "role", "text")).cast("long").alias("marker"))


@query("SELECT event_type, CAST(sum(coalesce(CAST(props->>'k' AS BIGINT), 0)) AS BIGINT) AS total, count(props->>'k') AS present, count(coalesce(props->>'missing', props->>'k')) AS fallback FROM events GROUP BY 1")
def json_attrs(spark, d):
    k = F.get_json_object("props", "$.k")
    return _t(spark, d, "events").groupBy("event_type").agg(F.sum(F.coalesce(k.cast("long"), F.lit(0))).alias("total"), F.count(k).alias("present"), F.count(F.coalesce(F.get_json_object("props", "$.missing"), k)).alias("fallback"))


@query("SELECT c.c_mktsegment AS name, CAST(count(*) AS BIGINT) AS n, round(avg(c_acctbal), 4) AS mean, min(c_name) AS first FROM customer c SEMI JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY 1")
def semi_join_counts(spark, d):
    c = _t(spark, d, "customer").join(_t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return c.groupBy(F.col("c_mktsegment").alias("name")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), F.min("c_name").alias("first"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def stale_signatures(spark, d):
    return _t(spark, d, "orders").join(_t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def ranked_page(spark, d):
    order = [V.rank_of(F.col("o_orderstatus"), ["F", "O", "P"]).asc(), F.desc("o_totalprice"), F.asc("o_orderkey")]
    return relational.page(_t(spark, d, "orders"), order, 50, 10).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) a
FULL JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) b ON a.k = b.k""")
def keyed_upsert(spark, d):
    old = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return relational.upsert(old, new, ["k"])


@query("""WITH k AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^\\p{L}\\p{M}\\p{N}_\\s-]', ' ', 'g'), '\\b(the|a|an|ltd|limited|project|colliery|mine|opencast|oc|underground)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS k, lower(p_name) AS raw FROM part)
SELECT p_partkey, CASE WHEN k = '' THEN trim(raw) ELSE k END AS key FROM k""")
def normalised_keys(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.norm_key(F.col("p_name")).alias("key"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 7500 THEN 'auto_accepted' ELSE 'needs_review' END AS status FROM supplier")
def confidence_routing(spark, d):
    return _t(spark, d, "supplier").select("s_suppkey", V.route(F.col("s_acctbal"), 7500).alias("status"))


@query("""SELECT o.o_custkey, CASE WHEN count(l.l_orderkey) = 0 THEN 'extracted' WHEN count(*) FILTER (l.l_returnflag = 'R') > 0 THEN 'needs_review' ELSE 'ready' END AS status
FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_custkey""")
def document_status(spark, d):
    from docmill.operators.extract import document_status as status

    li = _t(spark, d, "lineitem").join(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    fields = li.select("o_custkey", F.when(F.col("l_returnflag") == "R", "needs_review").otherwise("auto_accepted").alias("status"))
    return status(fields, _t(spark, d, "orders").select("o_custkey").distinct(), "o_custkey")
