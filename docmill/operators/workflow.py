"""Jobs that chain operators: knowledge build, asking, field review, reset, and the figures of dashboards."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import chunk, extract, graph, relational, retrieval
from docmill.sources.store import Store


def build_knowledge(docs: DataFrame, fields: DataFrame, pages: DataFrame | None = None, embedder: Callable = chunk.hashing_embedder) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(entities, relations, chunks with vectors); without pages nothing is indexed anew."""
    e, r = graph.build_graph(docs, fields)
    return e, r, None if pages is None else chunk.embed(chunk.chunk_pages(pages), embedder)


#: What a source of an answer is: citations and evidence of stored answers are arrays of these.
SOURCE = "struct<marker:int,kind:string,text:string,score:double,document_id:string,filename:string,page_no:int,field_id:string,entity:string>"


def ask(questions: DataFrame, entities: DataFrame, relations: DataFrame, fields: DataFrame, docs: DataFrame, chunks: DataFrame, pairs: DataFrame, k: int = 6, embedder: Callable[[], Callable[[list[str]], np.ndarray]] = chunk.hashing_embedder, owner: str | None = None, use_cache: bool = True) -> DataFrame:
    """(question_id, mode, answer, status, confidence, qa_id, question, question_norm, embedding, sources, flagged, similarity): a verified answer that is near
    enough, else facts and passages under the answer policy.

    questions: question_id long, question; chunks: chunk_id long, document_id, page_no, text, embedding; pairs: qa_id long, status, owner, answer, confidence, embedding
    and, if kept, sources, which a cached answer hands on. A decline is flagged no more than the policy says; a cached answer is not flagged.
    """
    # stored, so that a question is embedded once
    q = Store(questions.sparkSession, "questions").write(chunk.embed(questions.withColumn("question_norm", T.normalize_question(F.col("question"))), embedder, "question_norm"), "questions")
    known = pairs if "sources" in pairs.columns else pairs.withColumn("sources", F.lit(None).cast(f"array<{SOURCE}>"))
    hit = retrieval.cached(q, known if use_cache else known.limit(0), owner=owner, exact=chunk.exact_of(embedder)).join(known.select("qa_id", "answer", "confidence", "sources").hint("merge"), "qa_id")
    done = hit.select("question_id", F.lit("cache").alias("mode"), "answer", F.lit("answered").alias("status"), "confidence", "qa_id", "sources", F.lit(False).alias("flagged"), "similarity")
    rest = q.join(done.select("question_id"), "question_id", "left_anti")
    scoped = docs.where(V.scope(F.col("subsidiary_id"), owner)).select("document_id", "filename")
    allowed = chunks.join(scoped, "document_id")
    facts = retrieval.fact_evidence(retrieval.match_entities(rest, entities, owner), entities, relations, fields, docs)
    near = chunk.nearest_for_all(rest, allowed, k, "question_id", "chunk_id").join(allowed.select("chunk_id", "document_id", "filename", "page_no", "text"), "chunk_id")
    passages = near.select("question_id", F.lit("passage").alias("kind"), F.trim("text").alias("text"), F.round(F.greatest(F.lit(0.0), "score"), 3).alias("score"), "document_id", "filename", "page_no", F.lit(None).cast("string").alias("field_id"), F.lit(None).cast("string").alias("entity"))
    a = retrieval.compose(facts.unionByName(passages), rest)
    fresh = a.select("question_id", F.lit("rag").alias("mode"), "answer", "status", "confidence", F.lit(None).cast("long").alias("qa_id"), F.col("sources").cast(f"array<{SOURCE}>").alias("sources"), "flagged", F.lit(None).cast("double").alias("similarity"))
    both = done.withColumn("sources", F.col("sources").cast(f"array<{SOURCE}>")).unionByName(fresh)
    # never broadcast: vectors are far larger than the files that they are stored in
    return both.join(q.select("question_id", "question", "question_norm", "embedding").hint("merge"), "question_id").select("question_id", "mode", "answer", "status", "confidence", "qa_id", "question", "question_norm", "embedding", "sources", "flagged", "similarity")


def bump_hits(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """hit_count of verified answers, after a batch of questions."""
    n = answers.where("mode = 'cache'").groupBy("qa_id").agg(F.count("*").alias("_n"))
    return pairs.join(n, "qa_id", "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).drop("_n")


def review_fields(fields: DataFrame, decisions: DataFrame) -> DataFrame:
    """Fields after review: confirm verifies, correct takes the new value (its number parsed anew) and keeps the original, reject rejects.

    decisions: field_id, decision, new_value and, if there is one, decided_at. A correction without a value is left out. Of several decisions on a field the
    last one sets its state and the last correction its value, as if they had been taken one after another. fields has original_value_text.
    """
    d = decisions.where("decision in ('confirm', 'reject') or (decision = 'correct' and trim(coalesce(new_value, '')) <> '')").select("field_id", "decision", "new_value", *[c for c in ("decided_at",) if c in decisions.columns])
    fixes = relational.last_decisions(d.where("decision = 'correct'").drop("decision"), "field_id").select("field_id", F.col("new_value").alias("new_value"))
    last = relational.last_decisions(d, "field_id").select("field_id", "decision")
    j = fields.join(last.join(fixes, "field_id", "left"), "field_id", "left")
    fix = F.col("new_value").isNotNull()
    out = j.withColumn("original_value_text", F.when(fix, F.coalesce("original_value_text", "value_text")).otherwise(F.col("original_value_text")))
    out = out.withColumn("value", F.when(fix, F.when(F.col("value").isNotNull(), T.to_number(F.col("new_value")))).otherwise(F.col("value")))
    out = out.withColumn("iso", F.when(fix & F.col("iso").isNotNull(), T.parse_date(F.col("new_value")).cast("string")).otherwise(F.col("iso")))
    out = out.withColumn("value_text", F.when(fix, F.col("new_value")).otherwise(F.col("value_text")))
    state = F.when(F.col("decision").isin("confirm", "correct"), "verified").when(F.col("decision") == "reject", "rejected").otherwise(F.col("status"))
    return out.withColumn("status", state).drop("decision", "new_value")


def review_and_follow(stored: tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], docs: DataFrame, fields: DataFrame, decisions: DataFrame, units: list[tuple[str, str, str]] | None = None) -> tuple[DataFrame, tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]]:
    """(fields, (graph, evidence)) after a review: the graph follows the documents whose fields were decided on, and nothing else is built anew.

    stored: (graph, evidence) before, as graph.follow() takes them.
    """
    changed = fields.join(decisions.select("field_id").distinct(), "field_id", "left_semi").select("document_id").distinct()
    now = review_fields(fields, decisions)
    return now, graph.follow(*stored, changed, docs, now, units)


def reset(docs: DataFrame, names: DataFrame, fields: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, fields, reports): documents of known file names with their fields, the newest report of a title."""
    d = docs.join(names.select("filename").distinct(), "filename", "left_semi")
    return d, fields.join(d.select("document_id"), "document_id", "left_semi"), relational.newest(reports, ["title"], [F.desc("created_at"), F.col("report_id")])


def review_queue(fields: DataFrame, docs: DataFrame, owner: str | None = None, limit: int = 100) -> DataFrame:
    """Waiting fields with their documents, the least certain first."""
    j = fields.where("status = 'needs_review'").join(docs.where(V.scope(F.col("subsidiary_id"), owner)).select("document_id", "filename", "doc_type"), "document_id")
    return relational.page(j, [F.asc("confidence"), F.asc("field_id")], limit, cap="review")


def statuses(docs: DataFrame, fields: DataFrame) -> DataFrame:
    """Documents with their status from their fields' states."""
    return docs.drop("status").join(extract.document_status(fields, docs), "document_id")


# ---------------------------------------------------------------- dashboards


def funnel(docs: DataFrame, fields: DataFrame, entities: DataFrame, outputs: DataFrame) -> DataFrame:
    """(name, n): documents, values, confirmed values, things, outputs."""
    return relational.overview({"documents": docs, "values": fields, "confirmed": fields.where(F.col("status").isin(graph.ACCEPTED)), "entities": entities, "outputs": outputs})


def kpis(fields: DataFrame, findings: DataFrame, docs: DataFrame) -> DataFrame:
    return relational.overview({"trusted": fields.where(F.col("status").isin(graph.ACCEPTED)), "high": findings.where("severity = 'high'"), "documents": docs})


def evidence_pairs(findings: DataFrame) -> DataFrame:
    """(signature, category, old, new, change, scale): first and last value by date of each figure in a finding; change is null from 0, scale the finding's largest value."""
    e = findings.select("signature", F.explode("evidence").alias("e")).select("signature", "e.*")
    day = F.struct(F.coalesce("as_on", F.lit("")), "value")
    g = e.groupBy("signature", "category").agg(F.min_by("value", day).alias("old"), F.max_by("value", day).alias("new"))
    w = Window.partitionBy("signature")
    return g.withColumn("change", F.try_divide(F.col("new") - F.col("old"), F.col("old"))).withColumn("scale", F.max(F.greatest(F.abs("old"), F.abs("new"))).over(w))


def named_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with the names of both ends, null where an end is unknown."""
    v = vertices.select("id", "name")
    return edges.join(v.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src", "left").join(v.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst", "left")


def load_summary(calls: DataFrame, seconds: float) -> DataFrame:
    """One row for calls (ms, ok): requests a second, p50, p95, p99, errors."""
    from docmill.operators.metrics import percentiles

    p = percentiles(calls.withColumn("g", F.lit(1)), "ms", ["g"], {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    n = calls.agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors")).withColumn("g", F.lit(1))
    return n.join(p.drop("n"), "g", "left").select("calls", (F.col("calls") / F.lit(float(seconds))).alias("per_second"), "p50", "p95", "p99", "errors")


def cited_documents(citations: DataFrame) -> DataFrame:
    """(document_id, citations, confidence): citations by document with their mean confidence."""
    return citations.groupBy("document_id").agg(F.count("*").alias("citations"), F.avg("confidence").alias("confidence"))


def monitor(docs: DataFrame, limit: int = 30) -> DataFrame:
    """The newest documents with the figures that ingestion left in their meta (JSON), 0 where it left none, and the number of failed ones of all."""
    at = lambda k: F.coalesce(F.get_json_object("meta", f"$.pipeline.{k}").cast("long"), F.lit(0)).alias(k)
    failed = F.lit(docs.where("status = 'failed'").count()).alias("failed")
    new = relational.page(docs, [F.desc("created_at"), F.asc("document_id")], limit, cap="documents")
    return new.select("document_id", "status", at("fields_extracted"), at("fields_needs_review"), at("ocr_pages"), failed)


def asked(pairs: DataFrame, answers: DataFrame, at: str, actor: str, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, audit events) after a batch of answers (of ask()): each is stored as a row of its own with its question, vector, sources, mode and owner, so that a
    verified one can be found again; a cached answer is an echo of the verified row, whose hit_count grows.

    Events: query.cache_hit names the verified row and the similarity; query.answered and query.declined name the new row, its mode, confidence, flag and how
    many facts and passages it rests on. The time `at` makes a batch's row ids its own.
    """
    old = bump_hits(pairs, answers)
    kept = {"question": "string", "question_norm": "string", "embedding": "array<float>", "sources": f"array<{SOURCE}>", "flagged": "boolean", "similarity": "double"}
    answers = answers.withColumns({c: F.lit(None).cast(t) for c, t in kept.items() if c not in answers.columns})
    new_id = F.xxhash64("question_id", F.lit(at))
    cache = F.col("mode") == "cache"
    new = answers.select(
        new_id.alias("qa_id"), "question", "question_norm", "embedding", "answer", F.col("sources").cast(f"array<{SOURCE}>").alias("sources"), "confidence", F.when(cache, "answered").otherwise(F.col("status")).alias("status"), F.col("mode").alias("answer_mode"),
        F.lit(owner).cast("string").alias("owner"), F.lit(actor).alias("asked_by"), F.lit(at).alias("asked_at"), F.lit(0).cast("long").alias("hit_count"),
    )
    n = lambda kind: F.coalesce(F.size(F.filter("sources", lambda s: s["kind"] == kind)), F.lit(0))
    short = F.left("question", F.lit(200)).alias("question")
    hit = F.to_json(F.struct(short, F.round("similarity", 3).alias("similarity")))
    said = F.to_json(F.struct(short, F.col("mode"), F.col("confidence"), F.col("flagged"), n("fact").alias("facts"), n("passage").alias("passages")))
    action = F.when(cache, "query.cache_hit").when(F.col("status") == "insufficient", "query.declined").otherwise("query.answered")
    events = answers.select(F.lit(actor).alias("actor"), action.alias("action"), F.lit("qa_pair").alias("target_type"), F.when(cache, F.col("qa_id")).otherwise(new_id).cast("string").alias("target_id"), F.when(cache, hit).otherwise(said).alias("meta"))
    return old.unionByName(new, allowMissingColumns=True), events
