"""Queries of the document domain: the stored orders and parts, told as reports, go through extraction, graph, findings and answers; each has its SQL.

The SQL restates what the operators should find from the columns the texts were made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from docmill.operators import anomalies, classify, extract, graph, metrics, reports, retrieval, workflow
from docmill.plans.registry import Registry, dealt, read
from docmill.sources.store import Store

R = Registry()
query, QUERIES, SQL = R.query, R.queries, R.sql

UNITS = [("s1", "ECL", "Eastern Coalfields Limited"), ("s2", "BCCL", "Bharat Coking Coal Limited")]
THIS_YEAR = 2026

# ---------------------------------------------------------------- the corpus: an order is a reserve report of two pages, a part a borehole log

#: Columns of an order's report, as expressions that Spark and DuckDB read alike; figures are in hundredths.
_ORDER = {
    "doc": "concat('d', CAST(o_orderkey AS VARCHAR(20)))",
    "n": "o_orderkey",
    "day": "CAST(o_orderdate AS DATE)",
    "mine": "concat('Pit ', CAST(o_custkey AS VARCHAR(20)), ' Colliery')",
    "block": "concat('North ', CAST(o_custkey AS VARCHAR(20)))",
    "seam": "CASE o_orderkey % 3 WHEN 0 THEN 'R-I' WHEN 1 THEN 'R-V' ELSE 'R-X' END",
    "grade": "concat('G', CAST(o_orderkey % 17 + 1 AS VARCHAR(20)))",
    "p": "(o_orderkey * 7919 + o_custkey * 31) % 20000 + 100",
    "i": "o_orderkey * 104729 % 7000 + 100",
    "f": "o_orderkey * 1299709 % 3000 + 100",
    "off": "CASE WHEN o_orderstatus = 'P' THEN 2500 ELSE 0 END",
    "kind": "CASE WHEN o_orderpriority = '1-URGENT' THEN 'ocr' ELSE 'text' END",
    "owner": "CASE WHEN o_orderpriority = '5-LOW' THEN 's2' END",
    "header": "CASE WHEN o_orderpriority = '2-HIGH' THEN 'Eastern Coalfields Limited' ELSE 'Reserve register' END",
}
_PART = {
    "doc": "concat('b', CAST(p_partkey AS VARCHAR(20)))",
    "n": "p_partkey",
    "hole": "concat('BH-', CAST(p_partkey AS VARCHAR(20)))",
    "depth": "p_partkey * 7919 % 90000 + 1000000000",
    "recovery": "p_partkey % 120 + 1",
    "seams": "p_size",
}


def _cols(table: dict[str, str], table_name: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {k}" for k, e in table.items()) + f" FROM {table_name}"


def _sql(body: str, tables: str = "o") -> str:
    """A query over the corpus' columns: o (orders) and b (parts)."""
    parts = []
    if "o" in tables:
        parts.append(f"o AS (SELECT *, p + i + f + off AS t FROM ({_cols(_ORDER, 'orders')}))")
    if "b" in tables:
        parts.append(f"b AS ({_cols(_PART, 'part')})")
    return f"WITH {', '.join(parts)}, {body}" if body.startswith("x AS") else f"WITH {', '.join(parts)} {body}"


def _money(c: str) -> str:
    """Hundredths as text with two decimals, in both engines."""
    return f"concat(CAST(CAST(floor({c} / 100) AS BIGINT) AS VARCHAR(20)), '.', lpad(CAST({c} % 100 AS VARCHAR(20)), 2, '0'))"


def orders_of(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").selectExpr(*[f"{e} AS {k}" for k, e in _ORDER.items()])
    return o.withColumn("t", F.expr("p + i + f + off"))


def reserve_pages(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, doc_type, page_no, text, source_kind, words)."""
    o = dealt(orders_of(spark, d), "doc")
    first = F.expr("concat(header, '\n', 'Geological Reserve Status Report\nMine : ', mine, '\nBlock : ', block, '\nPrincipal Seam : ', seam, '\nAverage Grade : ', grade, '\nReserves as on : ', date_format(day, 'dd.MM.yyyy'), '\n')")
    second = F.expr(f"concat('Proved reserve ', {_money('p')}, ' million tonnes\nIndicated reserve ', {_money('i')}, ' million tonnes\nInferred reserve ', {_money('f')}, ' million tonnes\nTotal geological reserve ', {_money('t')}, ' million tonnes\n')")
    pages = F.explode(F.array(F.struct(F.lit(2).alias("page_no"), second.alias("text")), F.struct(F.lit(1).alias("page_no"), first.alias("text"))))
    words = F.array().cast("array<struct<text:string,x0:double,y0:double,x1:double,y1:double,ocr_conf:double>>").alias("words")
    return o.select(F.col("doc").alias("document_id"), F.lit("geological_reserve_status").alias("doc_type"), pages.alias("g"), F.col("kind").alias("source_kind"), words).select("document_id", "doc_type", "g.page_no", "g.text", "source_kind", "words")


def hole_pages(spark: SparkSession, d: str) -> DataFrame:
    b = dealt(read(spark, d, "part").selectExpr(*[f"{e} AS {k}" for k, e in _PART.items()]), "doc")
    text = F.expr(f"concat('Borehole Log\nBorehole ID : ', hole, '\nTotal depth : ', {_money('depth')}, '\nCore recovery ', CAST(recovery AS STRING), ' %\nIn all ', CAST(seams AS STRING), ' seams were intersected\n')")
    words = F.expr("transform(array(array('Total', '0.5'), array('depth', '0.25')), w -> struct(w[0] AS text, double(1) AS x0, double(2) AS y0, double(3) AS x1, double(4) AS y1, double(w[1]) AS ocr_conf))")
    # the whole metres were recognised as a word of the confidence 0.8
    depth = F.expr("array(struct(CAST(CAST(floor(depth / 100) AS BIGINT) AS STRING) AS text, double(10) AS x0, double(20) AS y0, double(18) AS x1, double(40) AS y1, double(0.8) AS ocr_conf))")
    return b.select(F.col("doc").alias("document_id"), F.lit("borehole_log_summary").alias("doc_type"), F.lit(1).alias("page_no"), text.alias("text"), F.lit("ocr").alias("source_kind"), F.concat(words, depth).alias("words"))


#: (field, value as SQL text, number, ISO date, base confidence on text and on recognised pages, page).
_FIELDS = [
    ("mine_name", "mine", "NULL", "NULL", 0.8, 0.6, 1), ("block_name", "block", "NULL", "NULL", 0.8, 0.6, 1), ("principal_seam", "seam", "NULL", "NULL", 0.85, 0.638, 1),
    ("average_grade", "grade", "NULL", "NULL", 0.85, 0.638, 1), ("reserves_as_on", "strftime(day, '%Y-%m-%d')", "NULL", "strftime(day, '%Y-%m-%d')", 0.9, 0.675, 1),
    ("proved_reserve", _money("p"), "p / 100", "NULL", 0.93, 0.698, 2), ("indicated_reserve", _money("i"), "i / 100", "NULL", 0.93, 0.698, 2),
    ("inferred_reserve", _money("f"), "f / 100", "NULL", 0.93, 0.698, 2), ("total_geological_reserve", _money("t"), "t / 100", "NULL", 0.9, 0.675, 2),
]
_RESERVE_KEYS = "('proved_reserve', 'indicated_reserve', 'inferred_reserve', 'total_geological_reserve')"
_FIELD_ROWS = " UNION ALL ".join(
    f"SELECT doc AS document_id, '{k}' AS field_key, {v} AS value_text, CAST({n} AS DOUBLE) AS value, CAST({iso} AS VARCHAR) AS iso, CASE kind WHEN 'ocr' THEN {c1} ELSE {c0} END AS confidence, {pg} AS page_no, kind AS source_kind, abs(off) > greatest(50, 0.015 * t) AS wrong FROM o"
    for k, v, n, iso, c0, c1, pg in _FIELDS
)
_SHOW = ["document_id", "field_key", "value_text", "round(value, 2) AS value", "iso", "confidence", "page_no", "source_kind"]


@query(_sql(f"SELECT document_id, field_key, value_text, value, iso, CAST(confidence AS DOUBLE) AS confidence, page_no, source_kind FROM ({_FIELD_ROWS})"))
def rule_fields(spark, d):
    return extract.extract_by_rules(reserve_pages(spark, d)).selectExpr(*_SHOW)


@query(_sql(
    f"""SELECT doc AS document_id, 'borehole_id' AS field_key, hole AS value_text, CAST(NULL AS DOUBLE) AS value, 0.675 AS confidence FROM b
UNION ALL SELECT doc, 'total_depth_m', {_money("depth")}, depth / 100, 0.792 FROM b
UNION ALL SELECT doc, 'core_recovery_pct', CAST(recovery AS VARCHAR), recovery, 0.6 FROM b
UNION ALL SELECT doc, 'seams_intersected', CAST(seams AS VARCHAR), seams, 0.615 FROM b""", "b"))  # fmt: skip
def recognised_fields(spark, d):
    f = extract.extract_by_rules(hole_pages(spark, d))
    return f.select("document_id", "field_key", "value_text", F.round("value", 2).alias("value"), "confidence")


@query(_sql(
    """SELECT doc AS document_id, 'mention_seam' AS field_key, seam AS value_text, 1 AS page_no, CASE kind WHEN 'ocr' THEN 0.496 ELSE 0.62 END AS confidence FROM o
UNION ALL SELECT doc, 'mention_grade', grade, 1, CASE kind WHEN 'ocr' THEN 0.48 ELSE 0.6 END FROM o
UNION ALL SELECT doc, 'mention_mine', mine, 1, CASE kind WHEN 'ocr' THEN 0.44 ELSE 0.55 END FROM o
UNION ALL SELECT doc, 'mention_org', header, 1, 0.5 FROM o WHERE header = 'Eastern Coalfields Limited'"""))  # fmt: skip
def mentions(spark, d):
    return extract.extract_mentions(reserve_pages(spark, d)).select("document_id", "field_key", "value_text", "page_no", "confidence")


_VALID = f"""SELECT document_id, field_key, value_text, value, iso, page_no, confidence FROM (SELECT * REPLACE (CASE WHEN wrong AND field_key IN {_RESERVE_KEYS} THEN
  CASE confidence WHEN 0.93 THEN 0.744 WHEN 0.9 THEN 0.72 WHEN 0.698 THEN 0.558 ELSE 0.54 END ELSE confidence END AS confidence) FROM ({_FIELD_ROWS}))"""


@query(_sql(f"SELECT document_id, field_key, value_text, CAST(confidence AS DOUBLE) AS confidence, CASE WHEN confidence >= 0.75 THEN 'auto_accepted' ELSE 'needs_review' END AS status FROM ({_VALID})"))
def validated_fields(spark, d):
    """Rules, mentions, validation and routing; shown are the rules' fields."""
    f = extract.extract_fields(reserve_pages(spark, d), this_year=THIS_YEAR)
    return f.where("extractor like 'rule:%'").select("document_id", "field_key", "value_text", "confidence", "status")


@query("""SELECT event_id, CAST(CASE WHEN floor(value) % 4 = 0 THEN 1900 ELSE 2000 END + floor(value) % 27 AS BIGINT) AS year,
  CASE WHEN floor(value) % 4 = 0 THEN 0.63 ELSE 0.9 END AS date_confidence, CASE WHEN value BETWEEN 0 AND 100 THEN 0.8 ELSE 0.56 END AS percent_confidence FROM events""")
def plausible_values(spark, d):
    """Dates before 1950 and percentages beyond 0 to 100 lose confidence."""
    e = read(spark, d, "events").withColumn("v", F.floor("value")).withColumn("year", (F.when(F.col("v") % 4 == 0, 1900).otherwise(2000) + F.col("v") % 27).cast("int"))
    shared = [F.col("event_id").alias("document_id"), F.lit(1).alias("page_no"), F.lit("x").alias("value_text"), F.lit("rule:x").alias("extractor")]
    dates = e.select(*shared, F.lit("date").alias("field_key"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"), F.concat(F.col("year").cast("string"), F.lit("-06-01")).alias("iso"), F.lit(0.9).alias("confidence"), "year")
    pct = e.select(*shared, F.lit("share").alias("field_key"), "value", F.lit("percent").alias("unit"), F.lit(None).cast("string").alias("iso"), F.lit(0.8).alias("confidence"), "year")
    v = extract.validate(dates.unionByName(pct), this_year=THIS_YEAR)
    return v.groupBy(F.col("document_id").alias("event_id")).agg(F.max("year").cast("long").alias("year"), F.max(F.when(F.col("field_key") == "date", F.col("confidence"))).alias("date_confidence"), F.max(F.when(F.col("field_key") == "share", F.col("confidence"))).alias("percent_confidence"))


@query(_sql("SELECT doc AS document_id, 'geological_reserve_status' AS doc_type, 'en' AS language, CAST(day AS DATE) AS doc_date FROM o"))
def classified_documents(spark, d):
    """Whole classification of a report's first page and file name: type, language, date."""
    docs = reserve_pages(spark, d).where("page_no = 1").withColumn("filename", F.concat("document_id", F.lit(".pdf")))
    return classify.classify(docs.drop("doc_type"), "text", "filename").select("document_id", "doc_type", "language", "doc_date")


@query(_sql("SELECT doc AS document_id, CAST(10 AS DOUBLE) AS x0, CAST(20 AS DOUBLE) AS y0, CAST(18 AS DOUBLE) AS x1, CAST(40 AS DOUBLE) AS y1 FROM b", "b"))
def field_boxes(spark, d):
    """The box of a recognised depth: that of the first word that its text is part of, or the other way round."""
    f = extract.extract_by_rules(hole_pages(spark, d)).where("field_key = 'total_depth_m'")
    return f.select("document_id", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


# ---------------------------------------------------------------- graph


def documents(spark: SparkSession, d: str) -> DataFrame:
    o = orders_of(spark, d)
    return o.select(F.col("doc").alias("document_id"), F.lit("geological_reserve_status").alias("doc_type"), F.col("day").alias("doc_date"), F.col("owner").alias("subsidiary_id"), F.col("n").alias("created_at"), F.concat("doc", F.lit(".pdf")).alias("filename"))


def accepted_fields(spark: SparkSession, d: str) -> DataFrame:
    """Extracted fields; reviewers have confirmed the organisations."""
    f = extract.extract_fields(reserve_pages(spark, d), this_year=THIS_YEAR)
    f = f.withColumn("status", F.when(F.col("field_key") == "mention_org", "verified").otherwise(F.col("status")))
    return f.withColumn("field_id", F.concat_ws(":", "document_id", "field_key", "page_no"))


def built(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.build_graph(documents(spark, d), accepted_fields(spark, d), UNITS)


#: Per document: which fields are accepted (ok: text pages; sums: where the sum holds too), with the owner's null as '-'.
_DOCS = """x AS (SELECT *, kind = 'text' AS ok, kind = 'text' AND NOT (abs(off) > greatest(50, 0.015 * t)) AS sums, coalesce(owner, '-') AS own,
  CASE WHEN owner = 's2' THEN 's2' WHEN header LIKE 'Eastern%' THEN 's1' END AS unit, strftime(day, '%Y-%m-%d') AS as_on FROM o)"""
_NODES = """SELECT 'report' AS kind, 'report:' || doc AS key, own AS owner, doc || '.pdf' AS name, 0.0 AS confidence, n, doc, 'doc_date=' || as_on || ';doc_type=geological_reserve_status' AS attrs FROM x
UNION ALL SELECT 'subsidiary', 'sub:' || CASE unit WHEN 's1' THEN 'ECL' ELSE 'BCCL' END, unit, CASE unit WHEN 's1' THEN 'Eastern Coalfields Limited' ELSE 'Bharat Coking Coal Limited' END, CASE WHEN unit = 's1' THEN 0.5 ELSE 0.0 END, n, doc, 'code=' || CASE unit WHEN 's1' THEN 'ECL' ELSE 'BCCL' END FROM x WHERE unit IS NOT NULL
UNION ALL SELECT 'mine', replace(lower(mine), ' colliery', ''), own, mine, 0.8, n, doc, '' FROM x WHERE ok
UNION ALL SELECT 'block', lower(block), own, block, 0.8, n, doc, '' FROM x WHERE ok
UNION ALL SELECT 'seam', lower(seam), own, seam, 0.85, n, doc, '' FROM x WHERE ok
UNION ALL SELECT 'mineral', 'mineral:coal:' || grade, '-', 'Coal (' || grade || ')', 0.85, n, doc, 'commodity=coal;grade=' || grade FROM x WHERE ok
UNION ALL SELECT 'reserve', 'reserve:' || doc || ':proved_reserve', own, 'Proved reserve', 0.93, n, doc, 'as_on=' || as_on || ';category=proved' FROM x WHERE sums
UNION ALL SELECT 'reserve', 'reserve:' || doc || ':indicated_reserve', own, 'Indicated reserve', 0.93, n, doc, 'as_on=' || as_on || ';category=indicated' FROM x WHERE sums
UNION ALL SELECT 'reserve', 'reserve:' || doc || ':inferred_reserve', own, 'Inferred reserve', 0.93, n, doc, 'as_on=' || as_on || ';category=inferred' FROM x WHERE sums
UNION ALL SELECT 'reserve', 'reserve:' || doc || ':total_geological_reserve', own, 'Total reserve', 0.9, n, doc, 'as_on=' || as_on || ';category=total' FROM x WHERE sums"""
_NODE_GROUPS = f"SELECT kind, key, owner, min_by(name, n) AS name, CAST(max(confidence) AS DOUBLE) AS confidence, min_by(doc, n) AS document_id, max_by(attrs, n) AS attrs FROM ({_NODES}) GROUP BY kind, key, owner"


@query(_sql(f"{_DOCS} {_NODE_GROUPS}"))
def graph_entities(spark, d):
    """Nodes with their attributes (but quantities and units) as text."""
    e, _ = built(spark, d)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter("attrs", lambda k, _: ~k.isin("quantity", "unit"))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";")
    return e.select("kind", "key", F.coalesce("owner", F.lit("-")).alias("owner"), "name", "confidence", "document_id", shown.alias("attrs"))


_SUM_KEYS = ("proved", "indicated", "inferred", "total")
_KEY_OF = {"total": "total_geological_reserve"} | {k: f"{k}_reserve" for k in _SUM_KEYS[:3]}
_EDGES = (
    """SELECT doc, n, 'report:' || doc AS src, 'sub:' || CASE unit WHEN 's1' THEN 'ECL' ELSE 'BCCL' END AS dst, 'mentions' AS predicate, CAST(NULL AS DATE) AS valid_from, 0.5 AS confidence FROM x WHERE header LIKE 'Eastern%' AND owner IS NULL
UNION ALL SELECT doc, n, replace(lower(mine), ' colliery', ''), 'report:' || doc, 'reported_in', NULL, 0.8 FROM x WHERE ok
UNION ALL SELECT doc, n, replace(lower(mine), ' colliery', ''), 'sub:' || CASE unit WHEN 's1' THEN 'ECL' ELSE 'BCCL' END, 'located_in', NULL, 0.8 FROM x WHERE ok AND unit IS NOT NULL
UNION ALL SELECT doc, n, lower(block), 'report:' || doc, 'reported_in', NULL, 0.8 FROM x WHERE ok
UNION ALL SELECT doc, n, lower(block), replace(lower(mine), ' colliery', ''), 'located_in', NULL, 0.8 FROM x WHERE ok
UNION ALL SELECT doc, n, lower(block), lower(seam), 'contains', NULL, 0.85 FROM x WHERE ok
UNION ALL SELECT doc, n, lower(seam), 'mineral:coal:' || grade, 'for_mineral', NULL, 0.85 FROM x WHERE ok"""
    + "".join(
        f""" UNION ALL SELECT doc, n, 'reserve:' || doc || ':{_KEY_OF[k]}', 'report:' || doc, 'reported_in', day, {0.9 if k == "total" else 0.93} FROM x WHERE sums
UNION ALL SELECT doc, n, lower(block), 'reserve:' || doc || ':{_KEY_OF[k]}', 'has_reserve', day, {0.9 if k == "total" else 0.93} FROM x WHERE sums
UNION ALL SELECT doc, n, 'reserve:' || doc || ':{_KEY_OF[k]}', 'mineral:coal:' || grade, 'for_mineral', NULL, {0.9 if k == "total" else 0.93} FROM x WHERE sums"""
        for k in _SUM_KEYS
    )
)


@query(_sql(f"""{_DOCS} SELECT e.src, e.dst, e.predicate, o.own AS owner, CAST(e.valid_from AS DATE) AS valid_from, CAST(min(e.confidence) AS DOUBLE) AS confidence, min_by(e.doc, e.n) AS document_id, count(DISTINCT e.doc) AS backing
FROM ({_EDGES}) e JOIN x o ON o.doc = e.doc GROUP BY ALL"""))
def graph_relations(spark, d):
    """Edges by the keys of their ends; things of several owners are told apart by the owner."""
    _, r = graph.build_graph(documents(spark, d), accepted_fields(spark, d), UNITS, ends=True)
    return by_keys(r)


def by_keys(r: DataFrame) -> DataFrame:
    """Relations with told ends, by the keys of these."""
    j = r.select("*", *[F.col(f"{n}_node.{c}").alias(a) for n, as_ in (("src", ("s", "sk", "so")), ("dst", ("t", "tk", "to"))) for c, a in zip(("key", "kind", "owner"), as_, strict=True)])
    shared = ["subsidiary", "mineral"]
    owner = F.coalesce(F.when(~F.col("sk").isin(shared), F.col("so")), F.when(~F.col("tk").isin(shared), F.col("to")), F.lit("-"))
    return j.select(F.col("s").alias("src"), F.col("t").alias("dst"), "predicate", owner.alias("owner"), "valid_from", "confidence", "document_id", "backing")


@query(_sql(f"""{_DOCS}, e AS ({_NODE_GROUPS}), r AS (SELECT e.src, e.dst, e.predicate, o.own, e.valid_from, min_by(e.doc, e.n) AS document_id FROM ({_EDGES}) e JOIN x o ON o.doc = e.doc GROUP BY ALL),
a AS (SELECT document_id, count(*) AS entities FROM e GROUP BY 1), b AS (SELECT document_id, count(*) AS relations FROM r GROUP BY 1)
SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(entities, 0) AS entities, coalesce(relations, 0) AS relations FROM a FULL JOIN b ON a.document_id = b.document_id"""))
def graph_totals(spark, d):
    return graph.totals_by_document(*built(spark, d))


@query(_sql(f"{_DOCS}, e AS ({_NODE_GROUPS}) SELECT kind, name FROM e WHERE kind IN ('mine', 'block') AND (lower(name) LIKE '%pit 1%' OR key LIKE '%pit 1%') AND (owner = 's2' OR owner = '-') ORDER BY kind, name, key LIMIT 200"))
def graph_search(spark, d):
    e, _ = built(spark, d)
    return graph.search(e.where(F.col("kind").isin("mine", "block")), "pit 1", principal="s2").select("kind", "name")


# ---------------------------------------------------------------- facts, findings


def order_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts as anomalies.facts gives them: a customer's reports of one part of the year."""
    f = orders_of(spark, d).select("doc", "n", "day", "block", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), (F.col(c) / 100).alias("value")) for k, c in zip(_SUM_KEYS, "pift", strict=True)])).alias("e"))
    return f.select(F.concat_ws(":", "doc", "e.category").alias("node"), F.lit("reserve").alias("kind"), F.lower("block").alias("anchor"), F.col("block").alias("anchor_name"), "e.category", F.lit("million_tonnes").alias("unit"), "e.value", F.date_format("day", "yyyy").alias("as_on"), F.col("doc").alias("document_id"), F.concat_ws(":", "doc", "e.category").alias("field_id"))


_FACTS = "x AS (" + " UNION ALL ".join(f"SELECT doc, n, lower(block) AS anchor, block AS anchor_name, '{k}' AS category, {c} / 100 AS value, doc || ':{k}' AS node, strftime(day, '%Y') AS as_on FROM o" for k, c in zip(_SUM_KEYS, "pift", strict=True)) + ")"


@query("""SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linestatus = 'O' AND l_quantity - 10 <= 0 THEN 'stripping ratio ' || CAST(CAST(l_quantity - 10 AS BIGINT) AS VARCHAR) || ' must be positive'
  WHEN l_linestatus = 'F' AND l_returnflag = 'A' AND NOT (l_quantity * 3 BETWEEN 0 AND 110) THEN 'percentage ' || CAST(CAST(l_quantity * 3 AS BIGINT) AS VARCHAR) || '% outside 0-100' END AS detail
FROM lineitem WHERE (l_linestatus = 'O' AND l_quantity - 10 <= 0) OR (l_linestatus = 'F' AND l_returnflag = 'A' AND NOT (l_quantity * 3 BETWEEN 0 AND 110))""")
def implausible_figures(spark, d):
    li = read(spark, d, "lineitem")
    stripping, percent = F.col("l_linestatus") == "O", (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "A")
    f = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("node"), F.lit("production_figure").alias("kind"), F.lit("a").alias("anchor"), F.lit("A").alias("anchor_name"),
        F.when(stripping, "stripping_ratio").otherwise("share").alias("category"), F.when(percent, "percent").otherwise("tonnes").alias("unit"),
        F.when(stripping, F.col("l_quantity") - 10).when(percent, F.col("l_quantity") * 3).otherwise(F.col("l_quantity")).alias("value"), F.lit("x").alias("as_on"), F.lit("d").alias("document_id"), F.lit("f").alias("field_id"))
    return anomalies.out_of_range(f).select(F.substring("signature", 5, 30).cast("long").alias("id"), "detail")


_DIFF = "max(value) - min(value) > greatest(0.01, 0.02 * greatest(abs(max(value)), abs(min(value))))"


@query(_sql(f"""{_FACTS}, g AS (SELECT anchor, category, count(DISTINCT as_on) > 1 AS rev, count(*) AS n FROM x GROUP BY 1, 2 HAVING count(*) > 1 AND {_DIFF})
SELECT anchor, CASE WHEN rev THEN 'revision' ELSE 'contradiction' END AS kind, CASE WHEN rev THEN 'medium' ELSE 'high' END AS severity, count(*) AS fields, CAST(sum(n) AS BIGINT) AS evidence FROM g GROUP BY anchor, rev"""))
def revision_findings(spark, d):
    """One finding an anchor and kind; the number of its lines, and of the figures behind them."""
    f = anomalies.revisions_and_contradictions(order_facts(spark, d))
    return f.select("anchor", "kind", "severity", F.regexp_extract("title", r"\((\d+) field", 1).cast("long").alias("fields"), F.size("evidence").cast("long").alias("evidence"))


@query(_sql(f"""{_FACTS}, g AS (SELECT anchor, category, min(as_on) AS a, max(as_on) AS b, min_by(value, as_on || lpad(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR), 9, '0')) AS old, max_by(value, as_on || lpad(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR), 9, '0')) AS new
  FROM x GROUP BY 1, 2 HAVING count(*) > 1 AND {_DIFF} AND count(DISTINCT as_on) > 1)
SELECT anchor, string_agg(category || ' ' || regexp_replace(printf('%.2f', old), '\\.?0+$', '') || ' (' || a || ') -> ' || regexp_replace(printf('%.2f', new), '\\.?0+$', '') || ' (' || b || ')', '; ' ORDER BY category) AS lines FROM g GROUP BY anchor"""))
def revision_lines(spark, d):
    """What the detail of a revision says of each figure: its earliest and its latest value."""
    f = anomalies.revisions_and_contradictions(order_facts(spark, d)).where("kind = 'revision'")
    return f.select("anchor", F.regexp_extract("detail", "differ — (.*)[.] Confirm", 1).alias("lines"))


@query(_sql(f"""{_FACTS}, w AS (SELECT anchor, as_on, {", ".join(f"max_by(value, node) FILTER (category = '{k}') AS {k}" for k in _SUM_KEYS)} FROM x GROUP BY 1, 2)
SELECT 'sum:' || anchor || ':' || as_on AS signature, 'high' AS severity FROM w WHERE abs(proved + indicated + inferred - total) > greatest(0.01, 0.02 * greatest(abs(proved + indicated + inferred), abs(total)))"""))
def sum_findings(spark, d):
    return anomalies.sum_mismatch(order_facts(spark, d)).select("signature", "severity")


@query(_sql(f"""{_FACTS}, g AS (SELECT anchor, category, avg(value) AS m, stddev_pop(value) AS sd FROM x GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT DISTINCT left('trend:' || x.anchor || ':' || x.category || ':' || regexp_replace(printf('%.2f', x.value), '\\.?0+$', ''), 290) AS signature FROM x JOIN g USING (anchor, category) WHERE g.sd > 0 AND abs(x.value - g.m) > 2.5 * g.sd"""))
def trend_findings(spark, d):
    return anomalies.trend_breaks(order_facts(spark, d)).select("signature").distinct()


@query(_sql(f"""{_FACTS}, g AS (SELECT anchor, category, count(DISTINCT as_on) > 1 AS rev FROM x GROUP BY 1, 2 HAVING count(*) > 1 AND {_DIFF}),
w AS (SELECT anchor, as_on, {", ".join(f"max_by(value, node) FILTER (category = '{k}') AS {k}" for k in _SUM_KEYS)} FROM x GROUP BY 1, 2),
m AS (SELECT anchor, category, avg(value) AS m, stddev_pop(value) AS sd FROM x GROUP BY 1, 2 HAVING count(*) >= 4),
f AS (SELECT DISTINCT 'revision' AS kind, anchor AS s FROM g WHERE rev UNION ALL SELECT DISTINCT 'contradiction', anchor FROM g WHERE NOT rev
UNION ALL SELECT 'sum_mismatch', anchor || as_on FROM w WHERE abs(proved + indicated + inferred - total) > greatest(0.01, 0.02 * greatest(abs(proved + indicated + inferred), abs(total)))
UNION ALL SELECT DISTINCT 'trend_break', x.anchor || ':' || x.category || ':' || x.value FROM x JOIN m USING (anchor, category) WHERE m.sd > 0 AND abs(x.value - m.m) > 2.5 * m.sd)
SELECT kind, count(*) AS created, CAST(0 AS BIGINT) AS updated, CAST(0 AS BIGINT) AS resolved FROM f GROUP BY kind"""))
def scan_findings(spark, d):
    """A whole scan against an empty store: what it created, by kind."""
    empty = spark.createDataFrame([], "signature string, kind string, status string, severity string, anchor string, title string, detail string")
    _, stats = anomalies.scan(empty, order_facts(spark, d))
    return stats.select("kind", "created", "updated", "resolved")


@query(_sql(f"{_DOCS} " + " UNION ALL ".join(f"SELECT 'reserve:' || doc || ':{_KEY_OF[k]}' AS key, lower(block) AS anchor, '{k}' AS category, {c} / 100 AS value, as_on, doc AS document_id FROM x WHERE sums" for k, c in zip(_SUM_KEYS, "pift", strict=True))))
def graph_facts(spark, d):
    """Fact nodes of the graph with the thing that they are of."""
    e, r = built(spark, d)
    f = anomalies.facts(e, r).join(e.select(F.col("id").alias("node"), "key"), "node").join(e.select(F.col("id").alias("anchor"), F.col("key").alias("anchor_key")), "anchor")
    return f.select("key", F.col("anchor_key").alias("anchor"), "category", F.round("value", 2).alias("value"), "as_on", "document_id")


# ---------------------------------------------------------------- answers


def questions(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("question_id"), F.concat(F.lit("What reserves has North"), F.col("c_custkey").cast("string"), F.lit("?")).alias("question"))


def things(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    return c.select(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("id"), F.lit("block").alias("kind"), F.concat(F.lit("north"), F.col("c_custkey").cast("string")).alias("key"), F.concat(F.lit("North"), F.col("c_custkey").cast("string"), F.lit(" Block")).alias("name"), F.when(F.col("c_mktsegment") == "BUILDING", "s2").when(F.col("c_mktsegment") == "MACHINERY", "s1").alias("owner"))


@query("SELECT c_custkey AS question_id, 'e' || c_custkey AS id, 'North' || c_custkey || ' Block' AS name FROM customer WHERE c_mktsegment <> 'MACHINERY' AND length('north' || c_custkey) > 2")
def matched_entities(spark, d):
    """Things that share a telling token with a question, within a unit's scope."""
    return retrieval.match_entities(questions(spark, d), things(spark, d), "s2")


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    o = orders_of(spark, d).withColumn("c", F.regexp_extract("block", r"(\d+)", 1))
    fact = o.select(F.concat(F.lit("f"), "doc").alias("id"), F.lit("reserve").alias("kind"), F.concat(F.lit("fact "), "doc").alias("key"), F.lit("Proved reserve").alias("name"), F.lit(None).cast("string").alias("owner"), F.create_map(F.lit("category"), F.lit("proved"), F.lit("quantity"), F.expr(_money("p")), F.lit("unit"), F.lit("million_tonnes")).alias("attrs"), F.col("doc").alias("field_id"))
    e = things(spark, d).select("id", "kind", "key", "name", "owner", F.create_map().cast("map<string,string>").alias("attrs"), F.lit(None).cast("string").alias("field_id")).unionByName(fact)
    r = o.select(F.concat(F.lit("e"), "c").alias("src"), F.concat(F.lit("f"), "doc").alias("dst"), F.lit("has_reserve").alias("predicate"))
    f = o.where("kind = 'text'").select(F.col("doc").alias("field_id"), F.when(F.col("owner") == "s2", 0.5).otherwise(0.9).alias("confidence"), F.lit(2).alias("page_no"), F.col("doc").alias("document_id"))
    docs = o.select(F.col("doc").alias("document_id"), F.concat("doc", F.lit(".pdf")).alias("filename"))
    return retrieval.fact_evidence(retrieval.match_entities(questions(spark, d), things(spark, d)), e, r, f, docs)


_EVID = f"""x AS (SELECT CAST(regexp_extract(block, '([0-9]+)', 1) AS BIGINT) AS c, doc, 'North' || regexp_extract(block, '([0-9]+)', 1) || ' Block: proved = ' || {_money("p")} || ' million tonnes' AS text,
  CASE WHEN kind = 'text' THEN CASE WHEN owner = 's2' THEN 0.49 ELSE 0.882 END ELSE 0.588 END AS score FROM o)"""


@query(_sql(f"{_EVID} SELECT c AS question_id, text, CAST(max(score) AS DOUBLE) AS score FROM x JOIN customer ON c_custkey = c GROUP BY 1, 2"))
def fact_evidence(spark, d):
    """Facts at the matched things, each text of a question once with its best score; a figure without a field counts 0.6."""
    return _evidence(spark, d).select("question_id", "text", "score")


@query(_sql(f"""{_EVID}, u AS (SELECT c, text, max(score) AS score FROM x GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, text) AS marker FROM u),
t AS (SELECT c, max(score) AS top, string_agg(text || ' [[c:' || marker || ']]', '; ' ORDER BY marker) || '.' AS answer FROM k WHERE marker <= 6 GROUP BY c)
SELECT q.c_custkey AS question_id, CASE WHEN top >= 0.5 THEN 'answered' ELSE 'insufficient' END AS status, CAST(coalesce(top, 0) AS DOUBLE) AS confidence, coalesce(top >= 0.5 AND top < 0.75, false) AS flagged,
  CASE WHEN top >= 0.5 THEN answer WHEN top IS NULL THEN 'No source in the corpus addresses this question. Nothing was retrieved.' ELSE 'declined' END AS answer FROM customer q LEFT JOIN t ON t.c = q.c_custkey"""))
def composed_answers(spark, d):
    """The answer policy over the best six sources; a decline's list of closest sources is left out here."""
    a = retrieval.compose(_evidence(spark, d), questions(spark, d))
    text = F.when((F.col("status") == "insufficient") & F.col("sources").isNotNull(), "declined").otherwise(F.col("answer"))
    return a.select("question_id", "status", "confidence", "flagged", text.alias("answer"))


@query("""SELECT CAST(event_id AS VARCHAR) AS qa_id, CASE WHEN event_type IN ('click', 'view') AND NOT (value < 20 AND event_type = 'click') THEN CASE event_type WHEN 'click' THEN 'verified' ELSE 'rejected' END
  WHEN value < 20 THEN 'insufficient' ELSE 'answered' END AS status FROM events""")
def judged_answers(spark, d):
    """Answers after promotion and rejection; an insufficient one cannot be verified."""
    e = read(spark, d, "events")
    pairs = e.select(F.col("event_id").cast("string").alias("qa_id"), F.when(F.col("value") < 20, "insufficient").otherwise("answered").alias("status"))
    decided = e.where(F.col("event_type").isin("click", "view")).select(F.col("event_id").cast("string").alias("qa_id"), F.when(F.col("event_type") == "click", "verified").otherwise("rejected").alias("decision"))
    return retrieval.judge(pairs, decided)


# ---------------------------------------------------------------- reports, figures, scores


@query(_sql(f"""{_DOCS}, v AS ({" UNION ALL ".join(f"SELECT doc, '{_KEY_OF[k]}' AS field_key, {_money(c)} AS value_text, {0.9 if k == 'total' else 0.93} AS confidence FROM x WHERE sums" for k, c in zip(_SUM_KEYS, "pift", strict=True))})
SELECT field_key, value_text, doc AS document_id, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY field_key ORDER BY confidence DESC, doc) AS n FROM v) WHERE n = 1"""))
def report_figures(spark, d):
    """The best accepted figure of each key over all documents."""
    f = accepted_fields(spark, d)
    figs = reports.figures(documents(spark, d).select("document_id"), f, list(reports.RESERVE_LABELS))
    return figs.select("field_key", "value_text", "document_id", "confidence")


@query("""SELECT o_custkey AS report_id, row_number() OVER (PARTITION BY o_custkey ORDER BY pos, field_id) AS marker, field_id, shown AS value, filename AS document_filename
FROM (SELECT o_custkey, 'f' || (o_orderkey % 25) AS field_id, 'c' || (o_orderkey % 25) || '.pdf' AS filename, min(o_orderkey) AS pos, min_by(CAST(o_orderkey AS VARCHAR), o_orderkey) AS shown FROM orders GROUP BY 1, 2, 3)""")
def report_citations(spark, d):
    """Numbers by first citation, one a field and report, with its document: customers are reports, their orders cite the nations' fields."""
    o = read(spark, d, "orders")
    cited = o.select(F.col("o_custkey").alias("report_id"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("f"), F.col("o_orderkey") % 25).alias("field_id"), F.col("o_orderkey").cast("string").alias("shown"))
    c = read(spark, d, "nation")
    fields = c.select(F.concat(F.lit("f"), "n_nationkey").alias("field_id"), F.concat(F.lit("c"), "n_nationkey").alias("document_id"), F.lit(1).alias("page_no"), F.lit("k").alias("field_key"), F.lit(0.9).alias("confidence"), F.lit("s").alias("source_snippet"), F.lit("verified").alias("status"))
    docs = c.select(F.concat(F.lit("c"), "n_nationkey").alias("document_id"), F.concat(F.lit("c"), "n_nationkey", F.lit(".pdf")).alias("filename"))
    return reports.citations(cited, fields, docs).select("report_id", F.col("marker").cast("long").alias("marker"), "field_id", "value", "document_filename")


@query("""SELECT DISTINCT 'd' || o_orderkey AS document_id FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)""")
def anchor_documents(spark, d):
    """Documents of a thing: its own, those of the reports it stands in, and its neighbours'."""
    o = read(spark, d, "orders").withColumn("doc", F.concat(F.lit("d"), F.col("o_orderkey").cast("string")))
    least = o.agg(F.min("o_custkey").alias("c"), F.min_by("doc", F.struct("o_custkey", "o_orderkey")).alias("doc"))
    e = o.select(F.col("doc").alias("id"), F.lit("report").alias("kind"), F.col("doc").alias("document_id")).unionByName(o.groupBy("o_custkey").agg(F.min_by("doc", "o_orderkey").alias("document_id")).select(F.col("o_custkey").cast("string").alias("id"), F.lit("block").alias("kind"), "document_id"))
    r = o.select(F.col("o_custkey").cast("string").alias("src"), F.col("doc").alias("dst"), F.lit("reported_in").alias("predicate"))
    return reports.anchor_documents(str(least.first()["c"]), e, r)


@query("""SELECT p_partkey, '# ' || p_name || chr(10) || chr(10) || '- **Brand:** ' || p_brand || chr(10) || '- **Type:** ' || p_type || chr(10) || chr(10) || '| Size |' || chr(10) || '| --- |' || chr(10) || '| ' || p_size || ' [1] |' || chr(10) || chr(10) || 'As stated [1].' || chr(10) AS body FROM part""")
def report_markdown(spark, d):
    s = lambda **k: F.struct(*[(F.lit(None).cast(t) if v is None else v).alias(n) for n, (v, t) in k.items()])
    kv, rows = "array<struct<label:string,value:string>>", "array<array<string>>"
    block = lambda type_, level=None, text=None, items=None, columns=None, cells=None: s(type=(F.lit(type_), "string"), level=(level, "int"), text=(text, "string"), items=(items, kv), columns=(columns, "array<string>"), rows=(cells, rows))
    pair = lambda a, b: F.struct(F.lit(a).alias("label"), F.col(b).alias("value"))
    blocks = F.array(block("heading", F.lit(1), F.col("p_name")), block("kv", items=F.array(pair("Brand", "p_brand"), pair("Type", "p_type"))), block("table", columns=F.array(F.lit("Size")), cells=F.array(F.array(F.concat(F.col("p_size").cast("string"), F.lit(" [[c:1]]"))))), block("paragraph", text=F.lit("As stated [[c:1]].")))
    return read(spark, d, "part").select("p_partkey", reports.markdown_column(blocks).alias("body"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'proved_reserve' WHEN o_orderstatus = 'O' THEN 'total_geological_reserve' END AS field_key, o_orderstatus IN ('F', 'O') AND (o_orderkey % 3 <> 0) AS matched FROM orders""")
def scored_fields(spark, d):
    """Expected figures against the first candidate that a document has: near enough (half a per cent) or not."""
    o = read(spark, d, "orders").withColumn("document_id", F.col("o_orderkey").cast("string"))
    truth = o.select("document_id", F.lit("reserve").alias("key"), F.lit("1000").alias("value_text"), F.lit(1000.0).alias("value"))
    near = F.when(F.col("o_orderkey") % 3 == 0, 1005.5).otherwise(1004.5)
    first = o.where("o_orderstatus = 'F'").select("document_id", F.lit("proved_reserve").alias("field_key"), near.cast("string").alias("value_text"), near.alias("value"))
    last = o.where("o_orderstatus in ('F', 'O')").select("document_id", F.lit("total_geological_reserve").alias("field_key"), near.cast("string").alias("value_text"), near.alias("value"))
    aliases = spark.createDataFrame([("reserve", 0, "proved_reserve"), ("reserve", 1, "total_geological_reserve")], "key string, pos int, field_key string")
    return metrics.score_fields(truth, first.unionByName(last), aliases).select(F.col("document_id").cast("long").alias("o_orderkey"), "field_key", "matched")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS document_id, 'total_geological_reserve' AS field_key FROM orders WHERE o_orderstatus = 'F'""")
def extra_fields(spark, d):
    """What was extracted beyond the expected fields."""
    o = read(spark, d, "orders").withColumn("document_id", F.col("o_orderkey").cast("string"))
    found = o.where("o_orderstatus = 'F'").select("document_id", F.explode(F.array(F.lit("proved_reserve"), F.lit("total_geological_reserve"))).alias("field_key"))
    return metrics.extra_keys(found, o.select("document_id", F.lit("proved_reserve").alias("field_key")))


@query(_sql(f"""SELECT doc_type, n, mean_confidence, total, accepted, from_ocr FROM (SELECT 'geological_reserve_status' AS doc_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, count(*) AS total,
  round(avg(CASE WHEN confidence >= 0.75 THEN 1 ELSE 0 END), 6) AS accepted, round(avg(CASE WHEN kind = 'ocr' THEN 1 ELSE 0 END), 6) AS from_ocr FROM (SELECT v.*, o.kind FROM ({_VALID}) v JOIN o ON o.doc = v.document_id))"""))
def extraction_quality(spark, d):
    """Totals and rates of the rules' fields, overall and by type."""
    f = extract.extract_fields(reserve_pages(spark, d), this_year=THIS_YEAR).where("extractor like 'rule:%'")
    # stored, so that fields are extracted once for both tables
    f = Store(spark, "quality").write(f.select("document_id", "confidence", "status", "source_kind"), "fields")
    by = metrics.quality_by_type(f, documents(spark, d))
    q = metrics.extraction_quality(f, documents(spark, d))
    return by.join(F.broadcast(q.withColumn("doc_type", F.lit("geological_reserve_status")).drop("mean_confidence")), "doc_type").select("doc_type", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.col("total_fields").alias("total"), F.round("auto_accept_rate", 6).alias("accepted"), F.round("ocr_ratio", 6).alias("from_ocr"))


@query("""SELECT 'e' || c_custkey AS id, c_mktsegment AS segment, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def named_edge_counts(spark, d):
    """Edges with the names of their ends, counted by end; unknown ends keep their edges."""
    c = read(spark, d, "customer").select(F.concat(F.lit("e"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("name"))
    e = read(spark, d, "orders").select(F.concat(F.lit("e"), F.col("o_custkey").cast("string")).alias("src"), F.lit("nowhere").alias("dst"))
    n = workflow.named_edges(e, c).where("dst_name is null and src_name is not null").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"))
    return c.join(n, "id", "left").select("id", F.col("name").alias("segment"), F.coalesce("n", F.lit(0)).alias("n"))


