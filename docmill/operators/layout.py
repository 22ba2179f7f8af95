"""A layered layout of the graph: a tier a kind, places within a tier by the means of neighbours' places."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources.store import Store

#: Tiers from the top: kinds of one tier share a row.
TIERS = [["subsidiary"], ["mine"], ["block"], ["seam"], ["mineral"], ["reserve", "production_figure"], ["report"], ["inquiry", "finding"]]


def layered(vertices: DataFrame, edges: DataFrame, tiers: list[list[str]] = TIERS, rounds: int = 4, store: Store | None = None) -> DataFrame:
    """(id, tier, place): tiers by kind (unknown kinds below all), places 0, 1, ... within a tier.

    vertices: id, kind, name; edges: src, dst. The first places follow name and id; then, in turn from the top down and from below up, a tier's things are
    ordered by the mean relative place of their neighbours in the tiers passed before (things without any stay by their own place), which takes crossings
    out. A round is a join and an aggregate; ranks are taken by ranges, so that a large tier is no single task's.
    """
    store = store or Store(vertices.sparkSession, "layout")
    tier = F.lit(len(tiers))
    for i, kinds in reversed(list(enumerate(tiers))):
        tier = F.when(F.col("kind").isin(kinds), i).otherwise(tier)
    v = vertices.select("id", tier.alias("tier"), F.coalesce("name", F.lit("")).alias("name"))
    both = edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).union(edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))).where("id <> other").distinct()
    letters = F.ascii("name").cast("double") * (1 << 21) + F.ascii(F.substring("name", 2, 1))  # in the order of names, so that their ranges are too
    at = store.write(ranked(v.withColumn("key", letters)), "places")
    for r in range(rounds):
        down = r % 2 == 0
        near = both.join(at.select(F.col("id").alias("other"), F.col("tier").alias("other_tier"), F.col("share")), "other").join(at.select("id", F.col("tier").alias("own_tier")), "id")
        near = near.where("other_tier < own_tier" if down else "other_tier > own_tier").groupBy("id").agg(F.round(F.avg("share"), 9).alias("mean"))
        at = store.write(ranked(at.join(near, "id", "left").select("id", "tier", "name", F.coalesce("mean", F.round("share", 9)).alias("key"))), "places")
    return at.select("id", "tier", "place")


#: Rows of a tier that are ranked together.
RANGE = 1_000_000


def ranked(rows: DataFrame) -> DataFrame:
    """(id, tier, name, place, share): the rank of each row in its tier by key, name and id, and the rank's share of the tier.

    A tier is cut into ranges of its key, of equal width and as many as its rows ask for; the ranges' counts give each its first rank.
    """
    n = rows.groupBy("tier").agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    cut = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.ceil(F.col("n") / RANGE))).otherwise(F.lit(0))
    placed = rows.join(F.broadcast(n), "tier").withColumn("cut", cut.cast("long"))  # a row a tier
    counts = placed.groupBy("tier", "cut").agg(F.count("*").alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("tier").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    inner = F.row_number().over(Window.partitionBy("tier", "cut").orderBy("key", "name", "id"))
    out = placed.withColumn("inner", inner).join(before, ["tier", "cut"])
    place = (F.col("before") + F.col("inner") - 1).cast("long")
    return out.select("id", "tier", "name", place.alias("place"), ((place + 0.5) / F.col("n")).alias("share"))
