"""Exact Jaccard join of word-shingle sets in their metric space, by pivots, regions and triangle-inequality windows.

Documents as pivots fail at the top: unrelated texts are all at distance exactly 1, so a window of twice the radius around any Voronoi
border would copy every document everywhere. The first level therefore takes single-shingle sets as pivots. {s} is at distance
1 - 1/|x| from a set x that holds s and 1 from any other; among the tied nearest pivots a global order (rare shingles first)
decides, and the exact window of a set is its first |x| - ceil(t |x|) + 1 shingles in that order: two sets within the radius meet in
a region of both windows. Inside a region documents are pivots: a member within the radius of a region's pivot joins its
component at once, regions of one component are closed, and the open rest is joined recursively: by windows on the
distances to the empty set (sizes), on positions in the order, and on the distance of counted signatures (a weighted
Jaccard distance, also a metric, never above the sets' distance), then by the sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import Work, by_bytes, components, join_classes, mix, shingles, word_hashes
from docmill.llm.neardup import roots

#: Counts of a signature: sets of up to about 7000 shingles then differ enough in their counts at a radius of 0.2.
SIG = 256
#: A shingle this often in a chunk of so many is reported, and from so many reports on placed late in the order. Only the order depends on it.
CHUNK, OFTEN_CHUNK, OFTEN = 1_500_000, 4, 16
#: Shingles placed late at most (9 bytes each in every worker); any order is exact.
MOST_LATE = 1_000_000
#: Members up to which an open region is joined by pairs in the JVM; larger ones go to tasks of two blocks of so many, and of so many shingles.
SMALL, BLOCK, BLOCK_SHINGLES = 32, 256, 1_000_000
#: Regions of shingles that were reported 2 ** (HOT - 1) times or more are summed up by partial aggregates, others in windows.
HOT = 9
#: Document ids up to which a semi-join is broadcast (16 MB).
BROADCAST_IDS = 2_000_000


def _sets(texts: list[str | None], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Chunks of texts as (first text, sorted distinct shingle hashes, offsets)."""
    for a, b in by_bytes(texts):
        words, bounds = word_hashes(texts[a:b])
        sh, off = shingles(words, bounds, k)
        doc = np.repeat(np.arange(b - a), np.diff(off))
        order = np.lexsort((sh, doc))
        sh, doc = sh[order], doc[order]
        new = np.ones(len(sh), bool)
        new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
        sh, doc = sh[new], doc[new]
        bounds = np.zeros(b - a + 1, np.int64)
        bounds[1:] = np.cumsum(np.bincount(doc, minlength=b - a))
        yield a, sh, bounds


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` by document, modulo 2 ** 64."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def packed(sig: np.ndarray) -> list[bytes]:
    """Signatures as bytes: one a count where all fit, else two; counts beyond that make a signature of zeros, which says nothing."""
    top = sig.max(axis=1, initial=0)
    return [(s.astype(np.uint8) if t < 256 else s.astype("<u2") if t < 65536 else np.zeros(SIG, np.uint8)).tobytes() for s, t in zip(sig, top, strict=True)]


def unpacked(sigs: pd.Series) -> np.ndarray:
    """(n, SIG) counts of packed signatures."""
    out = np.zeros((len(sigs), SIG), np.int32)
    size = np.fromiter(map(len, sigs), np.int64, len(sigs))
    for width, kind in ((SIG, np.uint8), (2 * SIG, "<u2")):
        at = np.flatnonzero(size == width)
        if len(at):
            out[at] = np.frombuffer(b"".join(sigs.iloc[at]), kind).reshape(-1, SIG)
    return out


def profile(docs: DataFrame, k: int) -> DataFrame:
    """Rows of kind 0: a document's set size, set hashes and signature; of kind 1: a shingle seen often in a chunk, and how often."""

    def often(parts: list[np.ndarray]) -> pd.DataFrame:
        u, c = np.unique(np.concatenate(parts), return_counts=True)
        u, c = u[c >= OFTEN_CHUNK], c[c >= OFTEN_CHUNK]
        return pd.DataFrame({"kind": 1, "id": pd.array(u.view(np.int64), "Int64"), "n": c, "k1": 0, "k2": 0, "sig": None})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        for b in batches:
            ids = b["id"].astype("Int64").array
            for a, sh, bounds in _sets(list(b["t"]), k):
                n = np.diff(bounds)
                m = len(n)
                held.append(sh)
                if sum(map(len, held)) > CHUNK:
                    yield often(held)
                    held = []
                sig = np.zeros((m, SIG), np.int64)
                np.add.at(sig, (np.repeat(np.arange(m), n), (sh >> np.uint64(20)).astype(np.int64) % SIG), 1)
                yield pd.DataFrame({"kind": 0, "id": ids[a : a + m], "n": n, "k1": _per_doc(mix(sh), bounds).view(np.int64), "k2": _per_doc(mix(sh ^ np.uint64(0xABCDEF)), bounds).view(np.int64), "sig": packed(sig)})
        if held:
            yield often(held)

    return docs.mapInPandas(run, "kind int, id long, n long, k1 long, k2 long, sig binary")


def _order_keys(sh: np.ndarray, late: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Place of shingles in the global order: the level of frequency in the top 6 bits, then the hash."""
    key = sh >> np.uint64(6)
    if len(late):
        at = np.minimum(np.searchsorted(late, sh), len(late) - 1)
        key |= np.where(late[at] == sh, level[at], 0).astype(np.uint64) << np.uint64(58)
    return key


def windows(docs: DataFrame, k: int, pct: int, late: np.ndarray, level: np.ndarray) -> DataFrame:
    """(key, id, np): the regions of each document's window, with its size and its place there in one number. Within a task, equal sets appear once."""
    held = docs.sparkSession.sparkContext.broadcast((late, level))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late, level = held.value
        seen: set[tuple[int, int]] = set()
        for b in batches:
            ids = b["id"].to_numpy()
            for a, sh, bounds in _sets(list(b["t"]), k):
                n = np.diff(bounds)
                h1, h2 = _per_doc(mix(sh), bounds), _per_doc(mix(sh ^ np.uint64(0xABCDEF)), bounds)
                fresh = np.zeros(len(n), bool)
                for i, pair in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)):
                    if n[i] and pair not in seen:
                        seen.add(pair)
                        fresh[i] = True
                if len(seen) > 2_000_000:
                    seen.clear()  # more copies pass then, nothing is lost
                doc = np.repeat(np.arange(len(n)), n)
                keys = _order_keys(sh, late, level)
                order = np.lexsort((keys, doc))
                keys = keys[order]
                pos = np.arange(len(keys)) - np.repeat(bounds[:-1], n)
                length = n - -(-n * pct // 100) + 1
                keep = (pos < length[doc]) & fresh[doc]
                yield pd.DataFrame({"key": keys[keep].view(np.int64), "id": ids[a + doc[keep]], "np": n[doc[keep]] << 31 | pos[keep]})

    return docs.mapInPandas(run, "key long, id long, np long")


def full_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set): the sorted shingle hashes of the documents in `ids`."""
    few = ids.count() <= BROADCAST_IDS
    src = docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            for a, sh, bounds in _sets(list(b["t"]), k):
                yield pd.DataFrame({"id": ids[a : a + len(bounds) - 1], "set": [sh[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]})

    return src.mapInPandas(run, "id long, set binary")


def with_region(rows: DataFrame, **sums: Column) -> DataFrame:
    """`rows` (stored, with a key) and aggregates of their region.

    The level of a shingle's frequency is in its key. The rows of a frequent one, of which there are MOST_LATE at most, are aggregated in parts
    and get the sums by a broadcast; so no task receives a large region.
    """
    hot = F.shiftrightunsigned("key", 58) >= HOT
    w = Window.partitionBy("key")
    few = rows.where(~hot).select("*", *[c.over(w).alias(k) for k, c in sums.items()])
    many = rows.where(hot)
    return few.unionByName(many.join(F.broadcast(many.groupBy("key").agg(*[c.alias(k) for k, c in sums.items()])), "key").select(*few.columns))


def _fits(nx: str, ny: str, pct: int) -> Column:
    return (F.col(nx) * 100 >= F.col(ny) * pct) & (F.col(ny) * 100 >= F.col(nx) * pct)


def _reaches(nx: str, ny: str, px: str, py: str, pct: int) -> Column:
    """Whether the sets can overlap enough, given the places of one common shingle."""
    most = F.least(F.col(px), F.col(py)) + 1 + F.least(F.col(nx) - F.col(px) - 1, F.col(ny) - F.col(py) - 1)
    return most * (100 + pct) >= (F.col(nx) + F.col(ny)) * pct


def _near_signatures(pairs: DataFrame, sigs: DataFrame, pct: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures' distance is within the radius."""

    @F.pandas_udf("boolean")
    def near(x: pd.Series, y: pd.Series) -> pd.Series:
        p, q = unpacked(x).astype(np.int64), unpacked(y).astype(np.int64)
        return pd.Series((100 * np.minimum(p, q).sum(axis=1) >= pct * np.maximum(p, q).sum(axis=1)) | (p.sum(axis=1) == 0) | (q.sum(axis=1) == 0))

    s = sigs.select("id", "sig")
    both = pairs.join(s.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(s.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    return both.where(near("sa", "sb")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are within the radius."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            at = np.minimum(np.searchsorted(p, q), len(p) - 1)
            both = int((p[at] == q).sum())
            out.append(100 * both >= pct * (len(p) + len(q) - both))
        return pd.Series(out, dtype=bool)

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    return both.where(linked("sa", "sb")).select("a", "b")


def region_links(sets: list[np.ndarray], comp: np.ndarray, side: np.ndarray, pct: int) -> list[tuple[int, int]]:
    """Links between members of different components, enough to join all that are linked; side: 0, 1 or both (2) blocks.

    Overlaps of all members come from products of incidence matrices, a slice of the shared shingles at a time.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets])
    _, inv, cnt = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), n)
    shared = cnt[inv] > 1
    col, row = inv[shared], row[shared]
    _, col = np.unique(col, return_inverse=True)
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    both = np.zeros((m, m), np.float32)
    width = 8192
    edges = np.searchsorted(col, np.arange(0, (col[-1] if len(col) else 0) + width + 1, width))
    for i, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if x == y:
            continue
        part = np.zeros((m, width), np.float32)
        part[row[x:y], col[x:y] - i * width] = 1
        both += part @ part.T
    hit = 100 * both.astype(np.float64) >= pct * (n[:, None] + n[None, :] - both.astype(np.float64))
    hit &= (comp[:, None] != comp[None, :]) & np.triu(np.ones((m, m), bool), 1)
    hit &= (side[:, None] != side[None, :]) | (side[:, None] == 2)
    root = {int(c): int(c) for c in set(comp.tolist())}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = find(int(comp[i])), find(int(comp[j]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def jaccard_components(docs: DataFrame, k: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text", work: Work | None = None) -> DataFrame:
    """(id, n_shingles, component_id) for every row: sets of k-word shingles, linked where 100 * overlap >= pct * union.

    Words are runs of other than blanks and control white space, A-Z lower-cased. A text of fewer than k words is one shingle;
    one without words, or null, has none and links with nothing (component: its own id). Rows without an id keep a null component and
    link with nothing. Rows of one id, whatever their texts, share a component and are linked with whatever one of them is linked with.
    component_id is the smallest id reachable. Equal sets are joined by their hashes, so copies cost nothing beyond one row each.
    """
    work = work or Work(docs.sparkSession, "jaccard")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    if src.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # ids are repeated: rows get numbers of their own, and those of one id are tied afterwards
        rows = work.keep(src.withColumn("row", F.monotonically_increasing_id()))
        found = work.keep(_components(rows.where("id is not null").select(F.col("row").alias("id"), "t"), k, pct, work).withColumnRenamed("id", "row"))
        tied = rows.where("id is not null").select("row", "id").join(found, "row")
        ids = work.keep(tied.groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("size")))
        named = work.keep(join_classes(tied, ids, ["root"], rows.count()).select("row", "id", "n_shingles", "least"))
        one = components(work, named.select(F.col("id").alias("a"), F.col("least").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("component_id"))
        out = named.join(one, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    else:
        out = _components(src.where("id is not null"), k, pct, work).withColumnRenamed("root", "component_id")
    lost = profile(src.where("id is null"), k).where("kind = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return out.unionByName(lost).withColumnRenamed("id", id_col)


def _components(whole: DataFrame, k: int, pct: int, work: Work) -> DataFrame:
    """(id, n_shingles, root) of rows (id, t), no id of which is null or repeated."""
    seen = work.keep(profile(whole, k))
    base = seen.where("kind = 0")
    total = base.count()
    # copies: equal sets are one class, its smallest id the first link of the others
    nodes = base.where("n > 0").select("id", "k1", "k2", "n")
    classes = work.keep(nodes.groupBy("k1", "k2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1"))
    member = join_classes(nodes, classes, ["k1", "k2", "n"], total).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    late = seen.where("kind = 1").groupBy("id").agg(F.sum("n").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "id").limit(MOST_LATE).collect()
    late_id = np.array([r["id"] for r in late], np.int64).view(np.uint64)
    level = np.array([min(63, int(r["c"]).bit_length()) for r in late], np.int64)
    order = np.argsort(late_id)
    rows = work.keep(windows(whole, k, pct, late_id[order], level[order]))
    # groups of one are gone here; what stays is as large as the copies and chance neighbours in the corpus
    met = with_region(rows, p=F.min(F.struct("id", "np")), last=F.max("id")).where("p.id <> last")
    size, place = (lambda c: F.shiftright(c, 31).cast("int")), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    met = work.keep(met.select("key", "id", size("np").alias("n"), place("np").alias("pos"), F.col("p.id").alias("pid"), size("p.np").alias("pn"), place("p.np").alias("pp")))
    work.drop(rows)
    sigs = base.select("id", "sig")
    # first round: each document against the pivot that it meets most often within the windows
    star = met.where("id <> pid").where(_fits("n", "pn", pct) & _reaches("n", "pn", "pos", "pp", pct))
    star = star.groupBy("id", "pid").agg(F.count("*").alias("c")).groupBy("id").agg(F.max(F.struct("c", -F.col("pid"))).alias("m")).select(F.col("id").alias("a"), (-F.col("m.col2")).alias("b"))
    star = work.keep(_near_signatures(star, sigs, pct))
    ids = star.select(F.col("a").alias("id")).union(star.select(F.col("b").alias("id"))).distinct()
    sets = work.keep(full_sets(whole, ids, k))
    one = work.keep(_verified(star, sets, pct).union(member))
    comp = work.keep(components(work, one))
    # open regions: those with more than one component left
    c = comp.select(F.col("node").alias("id"), "root")
    state = work.keep(met.select("key", "id", "n", "pos").join(c, "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root"))
    still = work.keep(with_region(state, lo=F.min("comp"), hi=F.max("comp"), g=F.count("*")).where("lo <> hi").select("key", "id", "n", "pos", "comp", "g"))
    work.drop(met, star, sets, comp, state)
    small = still.where(F.col("g") <= SMALL)
    x = small.select("key", *[F.col(v).alias(f"{v}x") for v in ("id", "n", "pos", "comp")])
    y = small.select("key", *[F.col(v).alias(f"{v}y") for v in ("id", "n", "pos", "comp")])
    cond = (x["key"] == y["key"]) & (F.col("idx") < F.col("idy")) & (F.col("compx") != F.col("compy")) & _fits("nx", "ny", pct) & _reaches("nx", "ny", "posx", "posy", pct)
    pairs = x.join(y, cond).select(F.col("idx").alias("a"), F.col("idy").alias("b")).distinct()
    pairs = work.keep(_near_signatures(pairs, sigs, pct))
    more = [_verified(pairs, work.keep(full_sets(whole, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), k)), pct)]
    large = work.keep(still.where(F.col("g") > SMALL).select("key", "id", "n", "comp").distinct())
    if large.limit(1).count():
        more.append(_large(large, whole, sigs, k, pct, work))
    links = one
    for m in more:
        links = links.union(m)
    links = work.keep(links)
    sizes = work.keep(base.select("id", F.col("n").cast("long").alias("n_shingles")))
    work.drop(seen, still, pairs, one, classes)
    done = components(work, links).select(F.col("node").alias("id"), "root")
    return sizes.join(done, "id", "left").select("id", "n_shingles", F.coalesce("root", "id").alias("root"))


def _block_tasks(members: DataFrame, work: Work) -> DataFrame:
    """(key, id, n, comp, blk, lo, hi): members of large regions dealt to tasks of two blocks; tasks of one component have nothing to join.

    Blocks follow the number of members and their sizes, so that no task holds more than two blocks' sets (or two very large sets).
    Regions with the same members are joined once.
    """
    region = members.groupBy("key").agg(F.count("*").alias("g"), F.sum("n").alias("w"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("h"))
    blocks = F.greatest(F.ceil(F.col("g") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).cast("int")
    region = region.groupBy("g", "h").agg(F.min(F.struct("key", blocks.alias("blocks"))).alias("r")).select("r.key", "r.blocks", "g")
    total = members.count()
    placed = join_classes(members, region, ["key"], total, "g").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    spread = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("blk")).alias("lo"), F.greatest(o, F.col("blk")).alias("hi"))))
    tasks = placed.select("key", "id", "n", "comp", "blk", spread.alias("t")).select("key", "id", "n", "comp", "blk", "t.lo", "t.hi")
    w = Window.partitionBy("key", "lo", "hi")
    return work.keep(tasks.withColumn("c0", F.min("comp").over(w)).withColumn("c1", F.max("comp").over(w)).where("c0 <> c1").drop("c0", "c1"))


def near_members(sig: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, pct: int) -> np.ndarray:
    """The first member that each member reaches by steps between members of different components whose signatures are within the
    radius; a member near none reaches itself. Sizes n bound the search: in order of size, only a window of sizes can be near. A
    signature of zeros says nothing: it is near all of its window."""
    m = len(sig)
    order = np.argsort(n, kind="stable")
    s, c, d, n = sig[order], comp[order], side[order], n[order].astype(np.int64)
    blank = s.sum(axis=1) == 0
    end = np.searchsorted(n * pct, n * 100, "right")
    left, right = [], []
    for i in range(m):
        j = np.arange(i + 1, end[i])
        j = j[(c[j] != c[i]) & ((d[j] != d[i]) | (d[i] == 2))]
        if len(j):
            low = np.minimum(s[j], s[i]).sum(axis=1)
            j = j[(100 * low >= pct * (n[j] + n[i] - low)) | blank[j] | blank[i]]
            left.append(np.full(len(j), i))
            right.append(j)
    if not left:
        return np.arange(m)
    return roots(m, order[np.concatenate(left)], order[np.concatenate(right)])


def _large(members: DataFrame, docs: DataFrame, sigs: DataFrame, k: int, pct: int, work: Work) -> DataFrame:
    """Links inside large open regions (key, id, n, comp): tasks of two blocks each, first by signatures.

    Near copies share most of their regions; so what the signatures leave is gathered into clusters of members that reach each other
    by near signatures, whichever the region, and each cluster's sets are compared once.
    """

    def sides(key: tuple, g: pd.DataFrame) -> np.ndarray:
        return np.full(len(g), 2) if key[1] == key[2] else (g["blk"].to_numpy() == key[2]).astype(int)

    def sift(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        sig = unpacked(g["sig"])
        to = near_members(sig, g["n"].to_numpy(), g["comp"].to_numpy(), sides(key, g), pct)
        ids = g["id"].to_numpy()
        some = to != np.arange(len(g))
        return pd.DataFrame({"a": ids[some], "b": ids[to[some]]})

    near = _block_tasks(members, work).join(sigs.select("id", "sig"), "id").groupBy("key", "lo", "hi").applyInPandas(sift, "a long, b long")
    near = work.keep(near.distinct())
    clusters = components(work, near).select(F.col("node").alias("id"), F.col("root").alias("key"))
    comps = members.select("id", "n", "comp").distinct()
    tasks = _block_tasks(work.keep(clusters.join(comps, "id").select("key", "id", "n", "comp")), work)
    sets = work.keep(full_sets(docs, tasks.select("id").distinct(), k))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", kind="stable")
        ids = g["id"].to_numpy()
        got = region_links([np.frombuffer(s, np.uint64) for s in g["set"]], g["comp"].to_numpy(), sides(key, g), pct)
        return pd.DataFrame({"a": [ids[i] for i, _ in got], "b": [ids[j] for _, j in got]}, dtype="int64")

    return work.keep(tasks.select("key", "id", "comp", "blk", "lo", "hi").join(sets, "id").groupBy("key", "lo", "hi").applyInPandas(run, "a long, b long"))
