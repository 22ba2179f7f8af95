"""An inverted-file index of vectors: coarse centroids, lists stored apart, exact re-ranking, and bounds that say which lists can be left out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.sources.store import Store

#: Rows that centroids are fitted on (a bounded sample, documented; every row is indexed), lists at most, and rounds.
SAMPLE, MOST_LISTS, ROUNDS = 50_000, 2048, 8
#: Rows of a list that one task compares; larger lists are split.
PART_ROWS = 8192
#: Rows that are compared with all centroids at once, and queries whose probes (a vector a list) are held at once.
PLACED_ROWS, PROBED_ROWS = 1024, 32
#: Angles are in radians; what rounding can add to them.
SLACK = 1e-6


@dataclass
class Index:
    """lists: list, part, id, owner, unit (the vector at length 1); centroids: (lists, dim), at length 1; radius: the widest angle of a list."""

    lists: DataFrame
    centroids: np.ndarray
    radius: np.ndarray
    rows: int
    dim: int


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300)


def _sliced(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Batches of at most so many rows, so that what is made of each row, once a list, stays bounded."""
    for b in batches:
        for s in range(0, len(b), rows):
            yield b.iloc[s : s + rows].reset_index(drop=True)


def usable(vectors: DataFrame, vec_col: str, dim: int) -> DataFrame:
    """Rows whose vector has the index's dimension, no null or non-finite component, and is not zero."""
    v = F.col(vec_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.coalesce((F.size(v) == dim) & fine, F.lit(False)))


def _fit(sample: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), k, replace=False)]
    for _ in range(ROUNDS):
        at = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        some = np.linalg.norm(sums, axis=1) > 0
        c[some] = _unit(sums[some])
    return c


def build(store: Store, vectors: DataFrame, id_col: str, vec_col: str = "embedding", owner_col: str | None = None, seed: int = 42) -> Index:
    """An index of all usable vectors. The dimension is the commonest one; about sqrt(rows) lists, MOST_LISTS at most.

    The centroids come from at most SAMPLE rows, those least by the hash of their id, so a rebuild gives the same. Every list's radius is taken from all of its rows.
    """
    sizes = vectors.where(F.size(vec_col) > 0).groupBy(F.size(vec_col).alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = sizes["d"] if sizes else 1
    owner = F.col(owner_col).cast("string") if owner_col else F.lit(None).cast("string")
    rows = usable(vectors, vec_col, dim).select(F.col(id_col).cast("long").alias("id"), owner.alias("owner"), F.col(vec_col).cast("array<double>").alias("v"))
    n = rows.count()
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    sample = _unit(np.stack([np.asarray(v) for v in picked])) if len(picked) else np.ones((1, dim))
    c = _fit(sample, max(1, min(len(sample), MOST_LISTS, math.isqrt(max(1, n)))), seed)
    held = vectors.sparkSession.sparkContext.broadcast(c)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _sliced(batches, PLACED_ROWS):
            u = _unit(np.stack([np.asarray(v) for v in b["v"]])) if len(b) else np.zeros((0, dim))
            cos = u @ held.value.T
            at = cos.argmax(axis=1)
            yield pd.DataFrame({"list": at.astype("int32"), "id": b["id"], "owner": b["owner"], "unit": pd.Series(list(u), dtype=object), "angle": np.arccos(np.clip(cos[np.arange(len(at)), at], -1, 1))})

    placed = store.write(rows.mapInPandas(place, "list int, id long, owner string, unit array<double>, angle double"), "placed")
    found = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect()  # a row a list
    size, radius = np.zeros(len(c), np.int64), np.full(len(c), -1.0)
    for r in found:
        size[r["list"]], radius[r["list"]] = r["n"], r["r"]
    parts = F.array(*[F.lit(int(max(1, -(-s // PART_ROWS)))) for s in size])
    split = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.get(parts, F.col("list"))).cast("int")).drop("angle")
    lists = store.write(split.repartition("list", "part").sortWithinPartitions("list", "part"), "lists", by="list")
    return Index(lists, c, radius, n, dim)


def _probes(index: Index, queries: DataFrame, take) -> DataFrame:
    """(q, v, list) for the lists that take(angles to the centroids, row) names; queries with unusable vectors have none."""
    c = queries.sparkSession.sparkContext.broadcast((index.centroids, index.radius))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, radius = c.value
        for b in _sliced(batches, PROBED_ROWS):
            u = _unit(np.stack([np.asarray(v) for v in b["v"]])) if len(b) else np.zeros((0, centroids.shape[1]))
            angle = np.arccos(np.clip(u @ centroids.T, -1, 1))
            chosen = [take(a, radius, least) for a, least in zip(angle, b["least"], strict=True)]
            yield pd.DataFrame({"q": np.repeat(b["q"].to_numpy(), [len(x) for x in chosen]), "v": pd.Series([v for v, x in zip(u, chosen, strict=True) for _ in x], dtype=object), "list": np.concatenate([*chosen, np.empty(0, np.int64)]).astype("int32")})

    return queries.mapInPandas(near, "q long, v array<double>, list int")


def _ranked(index: Index, probes: DataFrame, k: int, owner: str | None, at_least: float | None = None) -> DataFrame:
    """(q, id, score): the best k rows of the probed lists for each query, ties by id. Only probed lists are read, each part once by one task."""
    lists = index.lists.where(F.col("owner").isNull() | (F.col("owner") == owner)) if owner is not None else index.lists
    few = F.broadcast(probes.select("list").distinct())  # MOST_LISTS at most, so lists that none asks for are pruned from the scan
    lists = lists.join(few, "list", "left_semi")
    parts = lists.select("list", F.col("part").alias("asked_part")).distinct()
    asked = probes.join(F.broadcast(parts) if index.rows <= 4096 * PART_ROWS else parts, "list")

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": [], "id": [], "score": []})
        if not len(x) or not len(y):
            return none
        y = y.sort_values("id", kind="stable")
        ids, at, out = y["id"].to_numpy(), np.stack([np.asarray(v) for v in y["unit"]]), []
        for s in range(0, len(x), 512):
            cos = np.stack([np.asarray(v) for v in x["v"].iloc[s : s + 512]]) @ at.T
            for q, row in zip(x["q"].iloc[s : s + 512], cos, strict=True):
                some = np.arange(len(row)) if len(row) <= k else np.flatnonzero(row >= np.partition(row, -k)[-k])
                some = some[row[some] >= at_least] if at_least is not None else some
                some = some[np.argsort(-row[some], kind="stable")][:k]
                out.append(pd.DataFrame({"q": q, "id": ids[some], "score": row[some]}))
        return pd.concat(out) if out else none

    rows = lists.select(F.col("list").alias("of_list"), F.col("part").alias("of_part"), "id", "unit")
    got = asked.select(F.col("list").alias("asked_list"), "asked_part", "q", "v").groupBy("asked_list", "asked_part").cogroup(rows.groupBy("of_list", "of_part")).applyInPandas(best, "q long, id long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _queries(index: Index, queries: DataFrame, qid: str, vec_col: str) -> DataFrame:
    return usable(queries, vec_col, index.dim).where(F.col(qid).isNotNull()).select(F.col(qid).cast("long").alias("q"), F.col(vec_col).cast("array<double>").alias("v"), F.lit(None).cast("double").alias("least"))


def search(index: Index, queries: DataFrame, k: int, qid: str, vec_col: str = "embedding", probes: int = 8, owner: str | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best rows of each query's `probes` nearest lists, within a scope if an owner is given; scores are exact, lists
    further off are not read. search_exact() misses nothing."""
    p = _probes(index, _queries(index, queries, qid, vec_col), lambda a, r, _: np.argsort(a, kind="stable")[:probes])
    return _ranked(index, p, k, owner).select(F.col("q").alias(qid), "id", F.round("score", 4).alias("score"), "rank")


def search_above(index: Index, queries: DataFrame, least: float, qid: str, vec_col: str = "embedding", k: int = 1, owner: str | None = None) -> DataFrame:
    """(qid, id, score, rank): the k best rows of cosine `least` or more; exact.

    A row of a list is at most the list's radius from its centroid, so a list further from the query than that and the angle of `least` holds none.
    """
    wide = math.acos(max(-1.0, min(1.0, least)))
    p = _probes(index, _queries(index, queries, qid, vec_col), lambda a, r, _: np.flatnonzero((r >= 0) & (a - r <= wide + SLACK)))
    return _ranked(index, p, k, owner, least - 1e-12).select(F.col("q").alias(qid), "id", F.round("score", 4).alias("score"), "rank")


def search_exact(index: Index, queries: DataFrame, k: int, qid: str, vec_col: str = "embedding", probes: int = 4, owner: str | None = None, rounded: bool = True) -> DataFrame:
    """(qid, id, score, rank): the k best rows of all. The nearest lists give each query its k-th score so far, and every list that could hold a better
    row by its radius is read then."""
    q = _queries(index, queries, qid, vec_col)
    first = _ranked(index, _probes(index, q, lambda a, r, _: np.argsort(a, kind="stable")[:probes]), k, owner)
    floor = first.where(F.col("rank") == k).select("q", F.col("score").alias("s"))
    known = q.drop("least").join(floor, "q", "left").select("q", "v", F.coalesce("s", F.lit(-1.0)).alias("least"))
    p = _probes(index, known, lambda a, r, s: np.flatnonzero((r >= 0) & (a - r <= math.acos(max(-1.0, min(1.0, s))) + SLACK)))
    return _ranked(index, p, k, owner).select(F.col("q").alias(qid), "id", (F.round("score", 4) if rounded else F.col("score")).alias("score"), "rank")
