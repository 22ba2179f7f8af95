"""Topics as dense regions of vectors: clusters of a nearest-neighbour graph, outliers, and class-based tf-idf for their words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.operators import topics, vector_index
from docmill.sources.store import Store

OUTLIER = -1


def components(store: Store, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that edges (a, b, in one direction) lead to. A round takes the least root of the neighbours, then the root's root, so
    long chains shorten by jumps; each round is stored, and only the number of changes comes to the driver."""
    both = store.write(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    at = store.write(nodes.select("id", F.col("id").alias("root")), "roots")
    while True:
        least = both.join(at.select(F.col("id").alias("b"), "root"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        hooked = at.join(least, "id", "left").select("id", "root", F.least("root", "near").alias("low"))
        # a root takes the least that any of its own found, then all jump to their root's root
        lower = hooked.groupBy(F.col("root").alias("id")).agg(F.min("low").alias("to"))
        tops = at.where("id = root").select("id").join(lower, "id").select("id", "to")
        jumped = hooked.join(tops.select(F.col("id").alias("low"), F.col("to").alias("top")), "low", "left").select("id", F.col("root").alias("was"), F.least("low", "top").alias("root"))
        new = store.write(jumped, "roots")
        if not new.where("was <> root").limit(1).count():
            return new.select("id", "root")
        at = new.select("id", "root")


def clusters(vectors: DataFrame, id_col: str, vec_col: str = "embedding", k: int = 5, least: float = 0.5, smallest: int = 5, store: Store | None = None) -> DataFrame:
    """(id_col, topic, core): topic is the smallest id of a cluster of at least `smallest` rows, OUTLIER for the others and for unusable vectors.

    A row is core if its k-th nearest other row has a cosine of `least` or more. Core rows that are among each other's k nearest (either way) within
    `least` share a cluster; a row that is not core joins the cluster of its nearest core row within `least`, if that is among its k nearest.
    Neighbours come from the inverted-file index, exactly; k edges a row, so dense regions and copies stay linear.
    """
    store = store or Store(vectors.sparkSession, "density")
    index = vector_index.build(store, vectors, id_col, vec_col)
    q = vectors.select(F.col(id_col).cast("long").alias("q_id"), F.col(vec_col).alias("embedding"))
    near = vector_index.search_exact(index, q, k + 1, "q_id", rounded=False).where("q_id <> id")
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k)
    near = store.write(near.where(F.col("score") >= least - 1e-12).select("q_id", "id", "score", "n"), "near")
    core = store.write(near.where(F.col("n") == k).select(F.col("q_id").alias("id")).distinct(), "core")
    edges = near.join(core.select(F.col("id").alias("q_id")), "q_id", "left_semi").join(core, "id", "left_semi")
    roots = components(store, core, edges.select(F.col("q_id").alias("a"), F.col("id").alias("b")))
    first = near.join(core.select(F.col("id").alias("q_id")), "q_id", "left_anti").join(roots.withColumnRenamed("root", "to"), "id")
    border = first.groupBy("q_id").agg(F.min_by("to", F.struct(-F.col("score"), "id")).alias("root")).select(F.col("q_id").alias("id"), "root", F.lit(False).alias("core"))
    placed = store.write(roots.withColumn("core", F.lit(True)).unionByName(border), "placed")
    large = placed.groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("topic")).where(F.col("n") >= smallest)
    found = placed.join(large.drop("n"), "root").select("id", "topic", "core")
    out = vectors.select(F.col(id_col).alias("_own"), F.col(id_col).cast("long").alias("_id")).join(found, F.col("_id") == F.col("id"), "left")
    return out.select(F.col("_own").alias(id_col), F.coalesce("topic", F.lit(OUTLIER)).cast("long").alias("topic"), F.coalesce("core", F.lit(False)).alias("core"))


def class_terms(docs: DataFrame, membership: DataFrame, id_col: str, text_col: str = "text", n: int = topics.TOP_TERMS, bigrams: bool = False) -> DataFrame:
    """(topic, term, weight, rank): the n terms that stand out in each topic: a term's share of the topic's terms times ln(1 + A / f), f being its count over
    all topics and A the mean number of terms a topic. membership: id, topic; outliers are left out. Counts are partial sums before they move."""
    t = topics.terms_of(docs, id_col, text_col, bigrams).join(membership.where(F.col("topic").cast("string") != str(OUTLIER)).select("id", "topic"), "id")
    tf = Store(docs.sparkSession, "classes").write(t.groupBy("topic", "term").agg(F.sum("tf").alias("tf")), "tf")
    total = tf.groupBy("topic").agg(F.sum("tf").alias("total"))
    mean = total.agg(F.avg("total")).first()[0] or 0.0
    all_ = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    w = tf.join(all_, "term").join(total, "topic").select("topic", "term", (F.col("tf") / F.col("total") * F.log(1 + F.lit(float(mean)) / F.col("f"))).alias("weight"))
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.round("weight", 9).desc(), "term"))
    return w.withColumn("rank", rank).where(F.col("rank") <= n)
