"""Quality, accuracy and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T


def extraction_quality(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """One row of totals: fields, auto-accept rate, mean confidence, share from recognised text (of fields)."""
    return fields.agg(
        F.count("*").alias("total_fields"), F.coalesce(F.try_divide(F.count_if(F.col("status") == "auto_accepted"), F.count("*")), F.lit(0.0)).alias("auto_accept_rate"),
        F.avg("confidence").alias("mean_confidence"), F.coalesce(F.try_divide(F.count_if(F.col("source_kind") == "ocr"), F.count("*")), F.lit(0.0)).alias("ocr_ratio"),
    )


def quality_by_type(fields: DataFrame, docs: DataFrame) -> DataFrame:
    j = fields.join(docs.select("document_id", "doc_type"), "document_id")
    return j.groupBy(F.coalesce("doc_type", F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"))


def prf(df: DataFrame, keys: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Precision, recall, F1 and coverage by bucket; 0 where a denominator is."""
    g = df.groupBy(*keys).agg(F.count_if(truth & predicted).alias("tp"), F.count_if(~truth & predicted).alias("fp"), F.count_if(truth & ~predicted).alias("fn"), F.count("*").alias("n"))
    safe = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    g = g.withColumn("precision", safe(tp, tp + fp)).withColumn("recall", safe(tp, tp + fn))
    return g.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("coverage", safe(tp + fp, F.col("n")))


def percentiles(df: DataFrame, value: str, keys: list[str], qs: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Nearest-rank percentiles: the element at round(q * (n - 1)) in order, exact and without gathering a group.

    A sketch brackets each rank between two values; the values below the bracket are counted, and only the distinct values inside it, about
    4 / accuracy of a group, are ranked. Should a bracket miss its rank, all of that group's distinct values are ranked.
    """
    # keys travel as one struct, in which nulls are equal
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(value).alias("_v"))
    bound = lambda q: F.lit(float(min(1.0, max(0.0, q))))
    sketch = F.percentile_approx("_v", F.array(*[bound(q + s * 2 / accuracy) for q in qs.values() for s in (-1, 1)]), accuracy)
    marks = rows.groupBy("_k").agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most"), sketch.alias("m"))
    ask = F.array(*[F.struct(F.lit(k).alias("name"), F.floor(F.lit(q) * (F.col("n") - 1) + 0.5).alias("rank"), F.get("m", F.lit(2 * i)).alias("lo"), F.get("m", F.lit(2 * i + 1)).alias("hi")) for i, (k, q) in enumerate(qs.items())])
    ask = marks.select("_k", "n", "least", "most", F.explode(ask).alias("a")).select("_k", "n", "least", "most", "a.*")
    seen = rows.join(ask, "_k").groupBy("_k", "name").agg(F.count_if(F.col("_v") < F.col("lo")).alias("below"), F.count_if(F.col("_v") <= F.col("hi")).alias("upto"))
    hit = (F.col("below") <= F.col("rank")) & (F.col("upto") > F.col("rank"))
    ask = ask.join(seen, ["_k", "name"]).select("_k", "n", "name", "rank", F.when(hit, F.col("lo")).otherwise(F.col("least")).alias("lo"), F.when(hit, F.col("hi")).otherwise(F.col("most")).alias("hi"), F.when(hit, F.col("below")).otherwise(0).alias("below"))
    inside = rows.join(ask, "_k").where(F.col("_v").between(F.col("lo"), F.col("hi"))).groupBy("_k", "n", "name", "rank", "below", "_v").agg(F.count("*").alias("c"))
    w = Window.partitionBy("_k", "name").orderBy("_v")
    at = inside.withColumn("_upto", F.sum("c").over(w) + F.col("below")).where(F.col("_upto") > F.col("rank"))
    return at.groupBy("_k").agg(F.max("n").alias("n"), *[F.min(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in qs]).select("_k.*", "n", *qs)


def canonical_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)))


def text_matches(predicted: Column, truth: Column) -> Column:
    """Equal, one within the other, or the shorter one's tokens all in the other (a token may be shortened to its beginning)."""
    p, t = F.lower(T.squeeze(predicted)), F.lower(T.squeeze(truth))
    a, b = canonical_tokens(predicted), canonical_tokens(truth)
    within = lambda x, y: F.forall(x, lambda w: F.exists(y, lambda v: (w == v) | (F.length(w) > 1) & F.startswith(v, w) | (F.length(v) > 1) & F.startswith(w, v)))
    sub = F.when(F.size(a) <= F.size(b), within(a, b)).otherwise(within(b, a))
    return (p == t) | ((p != "") & (t != "") & (F.contains(p, t) | F.contains(t, p))) | ((F.size(a) > 0) & (F.size(b) > 0) & sub)


def number_matches(predicted: Column, truth: Column) -> Column:
    """Within 0.01 or half a per cent."""
    return F.abs(predicted - truth) <= F.greatest(F.lit(0.01), 0.005 * F.abs(truth))


def score_fields(truth: DataFrame, predicted: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each expected field with its first available candidate by alias order: document_id, key, field_key, matched.

    truth: document_id, key, value_text, value; predicted: document_id, field_key, value_text, value; aliases: key, pos, field_key.
    """
    t = truth.select("document_id", "key", F.col("value_text").alias("want_text"), F.col("value").alias("want"))
    a = aliases.select("key", "pos", "field_key")
    j = t.join(a, "key", "left").join(predicted.select("document_id", "field_key", "value_text", "value"), ["document_id", "field_key"], "left")
    has = F.col("value_text").isNotNull()
    w = Window.partitionBy("document_id", "key").orderBy(F.desc(has), "pos")
    one = j.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    ok = F.when(F.col("want").isNotNull() & F.col("value").isNotNull(), number_matches(F.col("value"), F.col("want"))).otherwise(text_matches(F.col("value_text"), F.col("want_text")))
    return one.select("document_id", "key", F.when(has, F.col("field_key")).alias("field_key"), F.coalesce(ok & has, F.lit(False)).alias("matched"))


def extra_keys(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(document_id, field_key): what was found beyond what was expected."""
    return found.select("document_id", "field_key").distinct().join(expected.select("document_id", "field_key"), ["document_id", "field_key"], "left_anti")
