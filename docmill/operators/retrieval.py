"""Answers from graph facts and passages, for batches of questions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.operators import relational
from docmill.sources.store import Store

# Words of names that identify nothing.
GENERIC = [
    "block", "blocks", "mine", "mines", "opencast", "colliery", "collieries", "project", "underground", "expansion", "seam", "seams",
    "coalfield", "coalfields", "limited", "area", "reserve", "reserves", "coal", "the",
]
NAMED = ["mine", "block", "seam", "mineral", "subsidiary"]
FACT_EDGES, FACT_KINDS = ["has_reserve", "produces", "reported_in"], ["reserve", "production_figure", "finding"]
FLOOR, SOLID, CACHE_HIT, MAX_SOURCES = 0.50, 0.58, 0.90, 6


def match_entities(questions: DataFrame, entities: DataFrame, owner: str | None = None) -> DataFrame:
    """(question_id, id, name): named things that share a telling token with a question. Tokens meet by an equi-join."""
    key = T.match_tokens(F.col("key"))
    tokens = F.array_except(F.when(F.size(key) > 0, key).otherwise(T.match_tokens(F.col("name"))), F.array(*[F.lit(w) for w in GENERIC]))
    e = entities.where(F.col("kind").isin(NAMED) & V.scope(F.col("owner"), owner)).select("id", "name", F.explode(tokens).alias("token"))
    q = questions.select("question_id", F.explode(T.match_tokens(F.col("question"))).alias("token"))
    return q.join(e, "token").select("question_id", "id", "name").distinct()


def fact_evidence(matched: DataFrame, entities: DataFrame, relations: DataFrame, fields: DataFrame, docs: DataFrame) -> DataFrame:
    """Facts at the matched things: (question_id, kind, text, score, document_id, filename, page_no, field_id, entity), each text once."""
    e = relations.where(F.col("predicate").isin(FACT_EDGES)).select("src", "dst")
    ends = e.select(F.col("src").alias("at"), F.col("dst").alias("other")).union(e.select(F.col("dst").alias("at"), F.col("src").alias("other")))
    fact = entities.where(F.col("kind").isin(FACT_KINDS)).select(F.col("id").alias("other"), F.col("name").alias("fact_name"), "attrs", "field_id")
    f = fields.select("field_id", F.col("confidence").alias("conf"), "page_no", F.col("document_id").alias("doc"))
    d = docs.select(F.col("document_id").alias("doc"), "filename")
    a = F.col("attrs")
    value = F.coalesce(a["quantity"], a["value"])
    label = F.coalesce(a["category"], a["metric"], "fact_name")
    unit = F.replace(F.coalesce(a["unit"], F.lit("")), F.lit("_"), F.lit(" "))
    # never broadcast: all three grow with the documents, and stored tables are judged by their compressed size
    j = matched.join(ends, matched["id"] == ends["at"]).join(fact.hint("merge"), "other").join(f.hint("merge"), "field_id", "left").join(d.hint("merge"), "doc", "left")
    text = F.trim(F.concat("name", F.lit(": "), label, F.lit(" = "), F.coalesce(value, F.lit("None")), F.lit(" "), unit))
    rows = j.select("question_id", F.lit("fact").alias("kind"), text.alias("text"), F.round(F.coalesce("conf", F.lit(0.6)) * 0.98, 3).alias("score"), F.col("doc").alias("document_id"), "filename", "page_no", "field_id", F.col("name").alias("entity"))
    w = Window.partitionBy("question_id", "entity", "text").orderBy(F.desc("score"), F.col("field_id"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def compose(evidence: DataFrame, questions: DataFrame, max_sources: int = MAX_SOURCES, accept: float = V.CONF_ACCEPT) -> DataFrame:
    """The answer policy: ranked sources, decline on weak evidence, otherwise the sources joined with markers.

    evidence: question_id, kind, text, score and provenance. A question without evidence is declined too.
    """
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "kind", "text")
    top = evidence.withColumn("marker", F.row_number().over(w)).where(F.col("marker") <= max_sources)
    source = F.struct("marker", "kind", "text", "score", *[c for c in ("document_id", "filename", "page_no", "field_id", "entity") if c in evidence.columns])
    g = top.groupBy("question_id").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    out = questions.select("question_id").join(g, "question_id", "left")
    src = F.coalesce("sources", F.lit(None))
    best = lambda k: F.coalesce(F.array_max(F.transform(F.filter(src, lambda s: s["kind"] == k), lambda s: s["score"])), F.lit(0.0))
    fact, passage = best("fact"), best("passage")
    has_fact = F.coalesce(F.exists(src, lambda s: s["kind"] == "fact"), F.lit(False))
    top_score = F.greatest(fact, passage)
    weak = src.isNull() | (top_score < FLOOR) | (~has_fact & (passage < SOLID))
    marked = lambda s, n: F.concat(s["text"] if n is None else F.left(s["text"], F.lit(n)), F.lit(" [[c:"), s["marker"].cast("string"), F.lit("]]"))
    answer = F.concat(F.array_join(F.transform(src, lambda s: F.concat(F.regexp_replace(s["text"], r"\.+$", ""), F.lit(" [[c:"), s["marker"].cast("string"), F.lit("]]"))), "; "), F.lit("."))
    closest = F.array_join(F.transform(F.slice(src, 1, 3), lambda s: F.concat(s["marker"].cast("string"), F.lit(". "), marked(s, 240))), "\n")
    decline = F.when(src.isNull(), "No source in the corpus addresses this question. Nothing was retrieved.").otherwise(F.concat(F.lit("There is not enough confident evidence in the corpus to answer this. The closest sources found (unverified):\n\n"), closest))
    conf = F.when(weak, F.round(top_score, 3)).otherwise(F.round(F.least(F.lit(V.CONF_CAP), F.greatest(fact, 0.9 * passage)), 3))
    out = out.select("question_id", "sources", F.when(weak, decline).otherwise(answer).alias("answer"), F.when(weak, "insufficient").otherwise("answered").alias("status"), conf.alias("confidence"))
    return out.withColumn("flagged", (F.col("status") == "answered") & (F.col("confidence") < accept))


def with_markers(answer: Column, confidence: Column, n_sources: Column) -> tuple[Column, Column]:
    """A written answer with its [n] as citation markers; one without any gets those of the first two sources and less confidence."""
    text = T.markers(answer)
    bare = ~F.contains(text, F.lit("[[c:"))
    extra = F.array_join(F.transform(F.sequence(F.lit(1), F.least(F.lit(2), n_sources)), lambda i: F.concat(F.lit(" [[c:"), i.cast("string"), F.lit("]]"))), "")
    return F.when(bare & (n_sources > 0), F.concat(text, extra)).otherwise(text), F.when(bare, F.round(confidence * 0.85, 3)).otherwise(confidence)


def _direction() -> Callable:
    """SHA-256 of a vector scaled by its greatest component, so that multiples of a vector are equal; null for one that is null, empty, zero or not finite."""

    def digest(v: np.ndarray | None) -> bytes | None:
        x = np.asarray([] if v is None else v, float)
        top = np.abs(x).max(initial=0.0)
        return hashlib.sha256((x / top + 0.0).tobytes()).digest() if 0 < top < np.inf else None

    @F.pandas_udf("binary")
    def run(vectors: pd.Series) -> pd.Series:
        return pd.Series([digest(v) for v in vectors], dtype=object)

    return run


def cached(questions: DataFrame, pairs: DataFrame, threshold: float = CACHE_HIT, owner: str | None = None, exact: Callable[[str | None, str | None], float] | None = None) -> DataFrame:
    """(question_id, qa_id, similarity): the nearest verified answer, if it is near enough.

    A vector of the same direction is the nearest that there can be, first that of the same question (question_norm, if both sides have it): these
    meet by a hash, and only the questions that have none are compared with all answers, in blocks of vectors of which only the best answer goes on.
    With `exact` (chunk.exact_of()) vectors are sketches, in which different questions can fall together; these count as near as their words are.
    questions: question_id, embedding.
    """
    from docmill.operators.chunk import nearest_for_all

    told = all("question_norm" in t.columns for t in (questions, pairs))
    norm = F.col("question_norm") if told else F.lit(None).cast("string")
    verified = pairs.where((F.col("status") == "verified") & V.scope(F.col("owner"), owner)).select("qa_id", "embedding", norm.alias("question_norm"))
    store = Store(pairs.sparkSession, "cached")
    digests = lambda rows, key: store.write(rows.select(F.col(key).cast("long").alias(key), norm.alias("norm"), _direction()(F.col("embedding")).alias("h")), "digests").dropna(subset=[key, "h"])
    known, asked = digests(verified, "qa_id"), digests(questions, "question_id")
    least = lambda *by: known.groupBy(*by).agg(F.min("qa_id").alias("qa_id")).hint("merge")
    first = lambda rows: rows.groupBy("question_id").agg(F.min("qa_id").alias("qa_id"))
    equal = first(asked.join(least("h", "norm"), ["h", "norm"]))
    if not (told and exact):
        equal = store.write(equal, "same")
        equal = equal.unionByName(first(asked.join(equal.select("question_id"), "question_id", "left_anti").join(least("h"), "h")))
    equal = store.write(equal.select("question_id", "qa_id", F.lit(1.0).alias("similarity")).where(F.col("similarity") >= threshold), "equal")
    rest = questions.join(equal.select("question_id"), "question_id", "left_anti")
    near = nearest_for_all(rest, verified, 1, "question_id", "qa_id", **({"texts": "question_norm", "exact": exact, "floor": threshold} if told and exact else {})).where(F.col("score") >= threshold)
    return equal.unionByName(near.select("question_id", "qa_id", F.col("score").alias("similarity")))


def judge(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Promote or reject answers (qa_id, decision: verified or rejected, decided_at if known); an insufficient one cannot be verified. Of several
    decisions on one answer the last that can be taken counts."""
    d = decisions.where("decision in ('verified', 'rejected')").select("qa_id", "decision", *[c for c in ("decided_at",) if c in decisions.columns])
    weak = pairs.where("status = 'insufficient'").select("qa_id").distinct()
    d = relational.last_decisions(d.where("decision = 'rejected'").unionByName(d.where("decision = 'verified'").join(weak, "qa_id", "left_anti")), "qa_id")
    ok: Column = F.col("decision").isNotNull() & ~((F.col("status") == "insufficient") & (F.col("decision") == "verified"))
    return pairs.join(d, "qa_id", "left").withColumn("status", F.when(ok, F.col("decision")).otherwise(F.col("status"))).drop("decision")
