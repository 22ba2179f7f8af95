"""Embedding near-dedup: cross-polytope hashes after fast Hadamard rotations, multiprobe buckets, verified pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import Work, components, join_classes

#: Hashes a bucket joins by default, and the share of the pairs just at the threshold that tables are to find.
HASHES, RECALL = 3, 0.99
#: Unrelated vectors that a vector may meet by chance; hashes a bucket grow with the logarithm of the rows so that it stays so.
CHANCE = 16
#: Rows of bucket tasks that one call verifies.
GROUP_ROWS = 8192
#: Vectors of a bucket that one task compares with so many others; larger buckets are split into pairs of blocks.
BLOCK = 1024


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (their length a power of two), scaled to keep lengths."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate((y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def codes(x: np.ndarray, tables: int, hashes: int = HASHES, seed: int = 99) -> tuple[np.ndarray, np.ndarray]:
    """(n, tables) bucket codes and (n, tables, hashes) probe codes of unit vectors.

    A hash is the nearest of the 2 * d signed axes after three rounds of random signs and Hadamard
    transforms; a bucket joins `hashes` of them. A probe puts the second nearest axis in place of one.
    """
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - dim)))
    rng = np.random.Generator(np.random.PCG64([seed, d]))
    main, probe = np.zeros((n, tables), np.int64), np.zeros((n, tables, hashes), np.int64)
    for t in range(tables):
        one, two = np.zeros((n, hashes), np.int64), np.zeros((n, hashes), np.int64)
        for h in range(hashes):
            y = x
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], d))
            a = np.abs(y)
            best = np.argpartition(-a, 1, axis=1)[:, :2] if d > 2 else np.argsort(-a, axis=1)[:, :2]
            v = np.take_along_axis(a, best, 1)
            best = np.where((v[:, :1] < v[:, 1:]), best[:, ::-1], best)
            sign = np.take_along_axis(y, best, 1) < 0
            one[:, h], two[:, h] = (best + d * sign).T
        base = (2 * d) ** np.arange(hashes)
        main[:, t] = one @ base
        for h in range(hashes):
            probe[:, t, h] = main[:, t] + (two[:, h] - one[:, h]) * base[h]
    return main, probe


def at_cosine(n: int, d: int, cosine: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """n random pairs of unit vectors of this cosine."""
    rng = np.random.Generator(np.random.PCG64([seed, d]))
    x, y = rng.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * y


def meetings(x: np.ndarray, y: np.ndarray, tables: int, hashes: int = HASHES) -> np.ndarray:
    """(n, tables): whether x and y of a row meet in a bucket of the table."""
    (mx, px), (my, py) = codes(x, tables, hashes), codes(y, tables, hashes)
    return (mx == my) | (px == my[:, :, None]).any(axis=2) | (py == mx[:, :, None]).any(axis=2)


@lru_cache(maxsize=256)
def tables_for(dim: int, threshold: float, hashes: int = HASHES, recall: float = RECALL) -> int:
    """Tables by which that share of the pairs just at the threshold meets, from random pairs; closer pairs meet more often."""
    d = 1 << max(1, (dim - 1).bit_length())
    hit = meetings(*at_cosine(2000 if d < 256 else 500, d, min(threshold, 1.0)), 4, hashes)
    share = min(max(hit.mean() - 2 * np.sqrt(hit.mean() * (1 - hit.mean()) / hit.size), 0.01), 0.99)
    return max(8, int(np.ceil(np.log(1 - recall) / np.log(1 - share))))


def hashes_for(rows: int, dim: int, threshold: float) -> int:
    """Hashes a bucket: the least number (two at least) by which chance brings no more than CHANCE others to a vector in all tables together."""
    d = 1 << max(1, (dim - 1).bit_length())
    h = 2
    # one hash of two unrelated vectors agrees once in 2 * d; one of h may be the other's second nearest, either way
    while rows * tables_for(dim, threshold, h) * (1 + 2 * h) * (2.0 * d) ** -h > CHANCE and h < 8:
        h += 1
    return h


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable by the edges a-b, for each of n."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    return root


def _first_meeting(main: np.ndarray, probe: np.ndarray, i: np.ndarray, j: np.ndarray, t: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether (table t, bucket code) is the first bucket in which i and j meet, one of them by its main code."""
    ok = np.ones(len(i), bool)
    for s in range(main.shape[1]):
        mi, mj = main[i, s], main[j, s]
        # they meet in bucket mi if j probes or has it, and in bucket mj likewise
        at_i = (mi == mj) | (probe[j, s] == mi[:, None]).any(axis=1)
        at_j = (mi == mj) | (probe[i, s] == mj[:, None]).any(axis=1)
        first = np.where(at_i & at_j, np.minimum(mi, mj), np.where(at_i, mi, mj))
        ok &= np.where(s < t, ~(at_i | at_j), (s > t) | ((at_i | at_j) & (first == code)))
    return ok


#: Members of a bucket up to which its pairs are listed together with those of other buckets of its size.
LISTED = 48


def _close_pairs(x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray, side: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (p, q) of rows of one bucket task whose vectors x[at] are within the threshold; side: 0 and 1 pair across, 2 with all."""
    for m in np.unique(sizes):
        first = starts[sizes == m]
        if m <= LISTED:
            u, v = np.triu_indices(m, 1)
            step = max(1, 200_000 // max(1, len(u)))
            for k in range(0, len(first), step):
                f = first[k : k + step, None]
                p, q = (f + u).ravel(), (f + v).ravel()
                ok = (side[p] != side[q]) | (side[p] == 2)
                p, q = p[ok], q[ok]
                ok = np.einsum("ij,ij->i", x[at[p]], x[at[q]]) >= threshold
                yield p[ok], q[ok]
        else:
            for f in first:
                rows = np.arange(f, f + m)
                left = rows[side[rows] != 1]
                right = rows[side[rows] != 0]
                hit = x[at[left]] @ x[at[right]].T >= threshold
                if side[f] == 2:
                    hit = np.triu(hit, 1)
                p, q = np.nonzero(hit)
                yield left[p], right[q]


def _listed_links(work: Work, coded: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(rep, links, root): the links that are found first in a small bucket. entries: dim, t, code, rep, own of buckets of up to LISTED entries.

    A bucket's pairs are listed by number (of entries of which one is there by its main code), each pair is kept once with its first bucket, and the
    vectors of both are joined to it then: in single precision first, and for what is near by that in double precision, with the codes. A pair whose first
    meeting is in a larger bucket is left to that one.
    """
    bucket = entries.groupBy("dim", "t", "code").agg(F.array_sort(F.collect_list(F.struct("rep", "own"))).alias("e"))
    tails = F.transform("e", lambda x, k: F.transform(F.filter(F.slice("e", k + 2, F.size("e")), lambda y: (y["rep"] > x["rep"]) & (x["own"] + y["own"] > 0)), lambda y: F.struct(x["rep"].alias("i"), y["rep"].alias("j"))))
    pairs = bucket.select(F.struct("t", "code").alias("at"), F.explode(F.flatten(tails)).alias("p")).groupBy("p.i", "p.j").agg(F.min("at").alias("at"))
    pairs = work.keep(pairs.select("i", "j", "at.t", "at.code"), "pairs")
    rough = coded.select("rep", F.col("x32").alias("x"))
    met = pairs.join(rough.withColumnRenamed("x", "x_i"), pairs["i"] == rough["rep"]).drop("rep").join(coded.select(F.col("rep").alias("j"), F.col("x32").alias("x_j")), "j")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs whose vectors in single precision are not clearly apart: most that met by chance go here."""
        for b in batches:
            size = b["x_i"].map(len).to_numpy()
            ok = np.zeros(len(b), bool)
            for n in np.unique(size):
                x, y = (np.frombuffer(b"".join(b[c][size == n]), np.float32).reshape(-1, n // 4) for c in ("x_i", "x_j"))
                ok[size == n] = np.einsum("ij,ij->i", x, y) >= threshold - 1e-4
            yield b.loc[ok, ["i", "j", "t", "code"]]

    close = work.keep(met.select("i", "j", "t", "code", "x_i", "x_j").mapInPandas(near, "i long, j long, t int, code long"), "close")
    side = lambda name: coded.select(F.col("rep").alias(name), F.col("size").alias(f"size_{name}"), F.col("dim").alias(f"dim_{name}"), F.col("x").alias(f"x_{name}"), F.col("main").alias(f"main_{name}"), F.col("probe").alias(f"probe_{name}"))
    both = close.join(side("i"), "i").join(side("j"), "j").drop("dim_j")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for dim, g in b.groupby("dim_i"):
                x, y = (np.frombuffer(b"".join(g[c]), float).reshape(-1, dim) for c in ("x_i", "x_j"))
                g = g[np.einsum("ij,ij->i", x, y) >= threshold]
                if not len(g):
                    continue
                n = len(g)
                main = np.stack([*g["main_i"], *g["main_j"]])
                probe = np.stack([*g["probe_i"], *g["probe_j"]]).reshape(*main.shape, -1)
                ok = _first_meeting(main, probe, np.arange(n), np.arange(n, 2 * n), g["t"].to_numpy(), g["code"].to_numpy())
                g = g[ok]
                root = g["i"].to_numpy()
                out.append(pd.DataFrame({"rep": np.concatenate((g["i"], g["j"])), "links": np.concatenate((g["size_j"], g["size_i"])), "root": np.concatenate((root, root))}))
            yield pd.concat(out) if out else pd.DataFrame({"rep": [], "links": [], "root": []}).astype("int64")

    return both.mapInPandas(verify, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", tables: int | None = None, hashes: int | None = None, work: Work | None = None) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows without an id, link with nothing (component the
    own id, kept unless the id is null). Equal vectors are one class: compared once, counted each. Vectors of different
    length do not link. Candidates meet in a bucket; every link is verified in double precision and counted in the first bucket
    in which the two meet. Hashes a bucket follow the logarithm of the rows (hashes_for), tables are as many as RECALL at the threshold needs
    with so many in the vectors' dimension. Buckets of up to LISTED entries hold numbers only: their pairs are made distinct over all tables, and
    vectors join each pair once. Larger buckets, those of many near copies, are split into pairs of blocks, so no task holds more than two. Rows of one id, whatever their vectors, share a component; n_links counts
    the other rows that a row's own vector links with.
    """
    work = work or Work(vectors.sparkSession, "near")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fine = fine & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("ok", F.coalesce(fine, F.lit(False)))
    # adding zero makes a negative zero a zero, as they compare equal
    v = F.transform("v", lambda x: x + F.lit(0.0))
    keyed = rows.where("ok").select("id", v.alias("v")).select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(5), "v").alias("k2"))
    # a class is known by a number of its own, as an id may stand in several
    classes = work.keep(keyed.groupBy("k1", "k2").agg(F.min("id").alias("least"), F.count("*").alias("size"), F.first("v").alias("v")).withColumn("rep", F.monotonically_increasing_id()))

    total_classes = classes.count()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sizes = np.array([len(x) for x in b["v"]])
            for dim in np.unique(sizes):
                part = b[sizes == dim]
                x = np.stack([np.asarray(y, float) for y in part["v"]])
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                h = hashes or hashes_for(total_classes, int(dim), threshold)
                main, probe = codes(x, tables or tables_for(int(dim), threshold, h), h)
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "size": part["size"].to_numpy(), "dim": int(dim), "h": h, "x": [y.tobytes() for y in x], "x32": [y.tobytes() for y in x.astype(np.float32)], "main": list(main), "probe": list(probe.reshape(len(x), -1))})

    coded = work.keep(classes.select("rep", "size", "v").mapInPandas(encode, "rep long, size long, dim int, h int, x binary, x32 binary, main array<long>, probe array<long>"))
    at = F.posexplode("main").alias("t", "code")
    mains = coded.select("dim", "rep", at, F.lit(1).alias("own"))
    probes = coded.select("dim", "rep", "h", F.posexplode("probe").alias("p", "code")).select("dim", "rep", F.floor(F.col("p") / F.col("h")).cast("int").alias("t"), "code", F.lit(0).alias("own"))
    meets = mains.unionByName(probes).select("dim", "t", "code", "rep", "own")
    live = work.keep(meets.groupBy("dim", "t", "code").agg(F.count("*").alias("n"), F.sum("own").alias("own")).where("n > 1 and own > 0").select("dim", "t", "code", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    links = _listed_links(work, coded, meets.join(live.where(F.col("n") <= LISTED).select("dim", "t", "code"), ["dim", "t", "code"]), threshold)
    placed = meets.join(live.where(F.col("n") > LISTED).drop("n"), ["dim", "t", "code"]).withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("lo"), F.greatest(o, F.col("blk")).alias("hi"))))
    tasks = placed.select("t", "code", "rep", "own", "blk", "dim", pairs.alias("pr"))
    tasks = work.keep(tasks.select("t", "code", "dim", "rep", "own", "blk", "pr.lo", "pr.hi"))
    full = tasks.join(coded.select("rep", "size", "x", "main", "probe"), "rep")

    def verify(g: pd.DataFrame) -> pd.DataFrame:
        """Many bucket tasks at once, each by itself."""
        g = g.sort_values(["t", "code", "dim", "lo", "hi", "rep", "own"], kind="stable")
        rep, at = np.unique(g["rep"].to_numpy(), return_inverse=True)
        one = g.drop_duplicates("rep").sort_values("rep")
        size = one["size"].to_numpy()
        task = g[["t", "code", "dim", "lo", "hi"]].to_numpy()
        t, code, lo, hi = task[:, 0], task[:, 1], task[:, 3], task[:, 4]
        starts = np.flatnonzero(np.concatenate((np.ones(1, bool), (task[1:] != task[:-1]).any(axis=1))))
        sizes = np.diff(np.append(starts, len(g)))
        side = np.where(lo == hi, 2, (g["blk"].to_numpy() == hi).astype(int))
        own = g["own"].to_numpy() == 1
        count, ends = np.zeros(len(rep), np.int64), []
        for dim in np.unique(task[:, 2]):
            here = one["dim"].to_numpy() == dim
            x = np.zeros((len(one), dim))
            x[here] = np.frombuffer(b"".join(one["x"][here]), float).reshape(-1, dim)
            main = np.stack(one["main"][here])
            probe, row = np.stack(one["probe"][here]).reshape(*main.shape, -1), np.cumsum(here) - 1
            mine = task[starts, 2] == dim
            for p, q in _close_pairs(x, starts[mine], sizes[mine], at, side, threshold):
                ok = (own[p] | own[q]) & (at[p] != at[q])
                p, q = p[ok], q[ok]
                ok = _first_meeting(main, probe, row[at[p]], row[at[q]], t[p], code[p])
                i, j = at[p[ok]], at[q[ok]]
                np.add.at(count, i, size[j])
                np.add.at(count, j, size[i])
                ends.append((i, j))
        i, j = (np.concatenate(c) for c in zip(*ends, strict=True)) if ends else (np.empty(0, int),) * 2
        root = roots(len(rep), i, j)
        some = count > 0
        return pd.DataFrame({"rep": rep[some], "links": count[some], "root": rep[root[some]]})

    # bucket tasks are dealt to groups of about GROUP_ROWS rows; a task has two blocks at most
    groups = max(1, tasks.count() // GROUP_ROWS)
    full = full.withColumn("part", F.pmod(F.xxhash64("t", "code", "dim", "lo", "hi"), F.lit(groups)))
    links = work.keep(full.groupBy("part").applyInPandas(verify, "rep long, links long, root long").unionByName(links))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    members = keyed.select("id", "k1", "k2")
    total = rows.count()
    # classes that share an id are tied to the first of them
    key = F.struct("k1", "k2")
    torn = members.groupBy("id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("id", F.col("lo.k1").alias("f1"), F.col("lo.k2").alias("f2"))
    torn = members.join(torn, "id").where("k1 <> f1 or k2 <> f2").select("k1", "k2", "f1", "f2").distinct()
    name = classes.select("k1", "k2", "rep")
    ties = torn.join(name.withColumnRenamed("rep", "a"), ["k1", "k2"]).join(name.toDF("f1", "f2", "b"), ["f1", "f2"]).select("a", "b")
    tops = components(work, links.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(ties))
    known = classes.select("k1", "k2", "rep", "size", "least").join(counts, "rep", "left").join(tops.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = work.keep(known)
    # the smallest id of a component, of which most have one class only
    joined = known.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("parts"))
    known = join_classes(known, joined, ["root"], total, "parts")
    known = known.select("k1", "k2", "size", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = join_classes(members, work.keep(known), ["k1", "k2"], total).select("id", "n_links", "component_id")
    alone = rows.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).withColumnRenamed("id", id_col)
