"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that workers map into memory."""

from __future__ import annotations

import json
import math
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import Work, by_bytes, combine, crc_mod, map_file, put_file, word_hashes

#: Marks of a text's begin (a context only) and end (a token): hashes no word is likely to have.
BEGIN, END = np.uint64(0x1B5AD4C1E9F7A3D5), np.uint64(0x7C3E9D2F5A6B8E01)
#: Characters counted at once in a worker before the counts are sent on: 16 bytes a word, and as much again for sorting. They are
#: hashed in by_bytes' smaller slices.
CHUNK_CHARS = 12_000_000
#: Bytes of counts that one shard should receive; shards follow the input's size, up to so many.
SHARD_BYTES, MOST_SHARDS = 6_000_000, 1 << 20
#: Contexts whose followers are dealt to all shards at most (those of more than a shard's eighth, found in a sample of about so many texts).
MOST_HOT, HOT_SAMPLE = 4096, 20_000

#: Shards' files that a worker maps at a time, those used last; queries come sorted, so that each is passed once a batch.
MOST_MAPS = 256


def _tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(contexts, tokens, tokens by text): the words of each text, then its end; the context of a token is the one before, or the begin."""
    words, bounds = word_hashes(texts)
    n = np.diff(bounds) + 1
    off = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    tok = np.empty(off[-1], np.uint64)
    last = off[1:] - 1
    inner = np.ones(len(tok), bool)
    inner[last] = False
    tok[inner] = words
    tok[last] = END
    ctx = np.empty_like(tok)
    ctx[1:] = tok[:-1]
    ctx[off[:-1]] = BEGIN
    return ctx, tok, n


def _hot(ctx: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which contexts are among the hot ones (sorted)."""
    if not len(hot):
        return np.zeros(len(ctx), bool)
    return hot[np.minimum(np.searchsorted(hot, ctx), len(hot) - 1)] == ctx


def place(ctx: np.ndarray, tok: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What deals a bigram to a shard by its top bits: the context, or for a hot context the whole bigram, so that no shard has all its followers."""
    return np.where(_hot(ctx, hot), combine(ctx, tok), ctx)


def pair_key(ctx: np.ndarray, tok: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Key of a bigram: its place's top 20 bits, so that a shard is a range of keys, then 44 bits of the pair's hash."""
    top = np.uint64(44)
    return ((place(ctx, tok, hot) >> top) << top) | (combine(ctx, tok) >> np.uint64(20))


def _pack(*cols: np.ndarray) -> bytes:
    raw = struct.pack("<q", len(cols[0])) + b"".join(np.ascontiguousarray(c).tobytes() for c in cols)
    return zlib.compress(raw, 1)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    raw = zlib.decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    at, out = 8, []
    for t in types:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _sum_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values by key."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(1, bool), keys[1:] != keys[:-1])))
    return (keys[first], *(np.add.reduceat(v[order], first) for v in values))


@dataclass(frozen=True)
class Model:
    """Where a model lies (a shared folder), its shards, and its scalars."""

    folder: str
    shards: int
    tokens: int
    types: int
    bigrams: int


def train(docs: DataFrame, fold: tuple[int, int] | None = (5, 1), id_col: str = "doc_id", text_col: str = "text", work: Work | None = None) -> Model:
    """Count all whole texts outside the fold (crc32(id) mod fold[0] == fold[1] is held out; rows without an id are trained on) and write the model.

    A worker sums a chunk's bigrams before anything is sent; counts travel as packed blocks by context hash, so a shard holds
    the distinct followers of its contexts only, however often a text is repeated; those of the commonest contexts (a text's begin, common words) are
    dealt to all shards, and their sums are added up afterwards. Which contexts these are changes no score. A second, smaller exchange by word gives the
    continuation counts. Discounts D1, D2, D3+ come from the counts of counts of all shards.
    """
    spark = docs.sparkSession
    work = work or Work(spark, "lm")
    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    if fold:
        src = src.where(F.coalesce(crc_mod("i", fold[0]) != fold[1], F.lit(True)))
    size = src.agg(F.sum(F.length("t")).alias("chars"), F.count("*").alias("n")).first()
    shards = 1 << max(3, math.ceil(math.log2(max(1, 1.5 * (size["chars"] or 0) / SHARD_BYTES))))
    shards = min(shards, MOST_SHARDS)
    shift = np.uint64(64 - int(math.log2(shards)))
    least = max(1 / (8 * shards), 1 / MOST_HOT)

    def common(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["t"])
            for x, y in by_bytes(texts):
                ctx, _, _ = _tokens(texts[x:y])
                u, c = np.unique(ctx, return_counts=True)
                some = c >= least / 4 * len(ctx)
                yield pd.DataFrame({"ctx": u[some].view(np.int64), "n": c[some], "all": 0})
                yield pd.DataFrame({"ctx": [0], "n": [0], "all": [len(ctx)]})

    part = F.pmod(F.xxhash64("t"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, HOT_SAMPLE / max(1, size["n"])))
    found = src.where(part).select(F.left("t", F.lit(100_000)).alias("t")).mapInPandas(common, "ctx long, n long, all long").groupBy("ctx").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    total = found.agg(F.sum("all")).first()[0] or 0
    # at most 1 / least rows
    hot = np.sort(np.array([r["ctx"] for r in found.where(F.col("n") > least * total).collect()], np.int64).view(np.uint64))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chunks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            held, size = [], 0
            for b in batches:
                texts = list(b["t"])
                for x, y in by_bytes(texts):
                    ctx, tok, _ = _tokens(texts[x:y])
                    held.append((ctx, tok))
                    size += sum(len(t) if t else 1 for t in texts[x:y])
                    if size >= CHUNK_CHARS:
                        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
                        held, size = [], 0
            if held:
                yield tuple(np.concatenate(c) for c in zip(*held, strict=True))

        for ctx, tok in chunks():
            order = np.lexsort((tok, ctx))
            ctx, tok = ctx[order], tok[order]
            first = np.flatnonzero(np.concatenate((np.ones(1, bool), (ctx[1:] != ctx[:-1]) | (tok[1:] != tok[:-1]))))
            n = np.diff(np.append(first, len(ctx))).astype("<u4")
            ctx, tok = ctx[first], tok[first]
            shard = (place(ctx, tok, hot) >> shift).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            ctx, tok, n, shard = ctx[order], tok[order], n[order], shard[order]
            edge = np.searchsorted(shard, np.arange(shards + 1))
            rows = [(s, _pack(ctx[x:y], tok[x:y], n[x:y])) for s, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if y > x]
            yield pd.DataFrame(rows, columns=["shard", "blob"])

    blocks = src.select("t").mapInPandas(count, "shard int, blob binary")
    folder = f"{work.path}/model"

    def merge(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b, "<u8", "<u8", "<u4") for b in g["blob"]]
        ctx, tok, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((tok, ctx))
        ctx, tok, n = ctx[order], tok[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), (ctx[1:] != ctx[:-1]) | (tok[1:] != tok[:-1]))))
        n, ctx, tok = np.add.reduceat(n, first), ctx[first], tok[first]
        put_file(f"{folder}/raw", f"{key[0]}", [struct.pack("<q", len(n)), ctx.tobytes(), tok.tobytes(), n.astype("<u4").tobytes()])
        kinds = np.bincount(np.minimum(n, 5), minlength=6)
        w, c, cont = _sum_by(tok, n, np.ones(len(tok), np.int64))
        where = (w >> shift).astype(np.int64)
        edge = np.searchsorted(where, np.arange(shards + 1))
        rows = [(s, _pack(w[x:y], c[x:y].astype("<u4"), cont[x:y].astype("<u4")), 0, 0, 0, 0, 0, 0) for s, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if y > x]
        rows.append((-1, None, 0, *map(int, kinds[1:5]), len(n)))
        some = _hot(ctx, hot)
        for u in np.unique(ctx[some]):
            m = n[ctx == u]
            rows.append((-2, None, int(u.view(np.int64)), int((m == 1).sum()), int((m == 2).sum()), int((m > 2).sum()), 0, int(m.sum())))
        return pd.DataFrame(rows, columns=["shard", "blob", "ctx", "n1", "n2", "n3", "n4", "n"])

    merged = work.keep(blocks.groupBy("shard").applyInPandas(merge, "shard int, blob binary, ctx long, n1 long, n2 long, n3 long, n4 long, n long"))
    sums = {r["ctx"]: r for r in merged.where("shard = -2").groupBy("ctx").agg(*[F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n")]).collect()}
    hot = np.sort(np.array(list(sums), np.int64).view(np.uint64))
    high = merged.where("shard = -1").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "n")]).first()

    def words(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b, "<u8", "<u4", "<u4") for b in g["blob"]]
        w, c, cont = _sum_by(*(np.concatenate(x).astype(np.uint64 if i == 0 else np.int64) for i, x in enumerate(zip(*parts, strict=True))))
        put_file(f"{folder}/words", f"{key[0]}", [struct.pack("<q", len(w)), w.tobytes(), c.astype("<i8").tobytes(), cont.astype("<i8").tobytes()])
        kinds = np.bincount(np.minimum(cont, 5), minlength=6)
        return pd.DataFrame([(*map(int, kinds[1:5]), len(w), int(c.sum()))], columns=["n1", "n2", "n3", "n4", "n", "c"])

    low = work.keep(merged.where("shard >= 0").select("shard", "blob").groupBy("shard").applyInPandas(words, "n1 long, n2 long, n3 long, n4 long, n long, c long"))
    low = low.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n1", "n2", "n3", "n4", "n", "c")]).first()
    d2 = _discounts(high["n1"], high["n2"], high["n3"], high["n4"])
    d1 = _discounts(low["n1"], low["n2"], low["n3"], low["n4"])
    total, types, tokens = int(high["n"]), int(low["n"]), int(low["c"])
    # mass that the discounts leave, spread evenly over the known words and one unknown
    n3 = types - low["n1"] - low["n2"]
    spare = (d1[1] * low["n1"] + d1[2] * low["n2"] + d1[3] * n3) / total if total else 1.0
    floor = spare / (types + 1)
    hot_sum = np.array([sums[int(u)]["n"] for u in hot.view(np.int64)], float)
    hot_gamma = np.array([(d2[1] * sums[int(u)]["n1"] + d2[2] * sums[int(u)]["n2"] + d2[3] * sums[int(u)]["n3"]) / sums[int(u)]["n"] for u in hot.view(np.int64)])

    def finish(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Turn a shard's counts into what scoring looks up, in arrays sorted by key."""
        for b in it:
            for s in b["shard"]:
                ctx, tok, n = _read(folder, "raw", s, "<u8", "<u8", "<u4")
                known, gamma = hot[(hot >> shift) == np.uint64(s)], hot_gamma[(hot >> shift) == np.uint64(s)]
                if len(ctx):
                    first = np.flatnonzero(np.concatenate((np.ones(1, bool), ctx[1:] != ctx[:-1])))
                    disc = d2[np.minimum(n, 3)]
                    own = np.add.reduceat(n.astype(np.int64), first).astype(float)
                    some = _hot(ctx[first], hot)
                    own_gamma = np.add.reduceat(disc, first) / own
                    own[some] = hot_sum[np.searchsorted(hot, ctx[first][some])]
                    held = np.maximum(n - disc, 0) / np.repeat(own, np.diff(np.append(first, len(ctx))))
                    key = pair_key(ctx, tok, hot)
                    order = np.argsort(key, kind="stable")
                    put_file(f"{folder}/pairs", f"{s}", [struct.pack("<q", len(key)), key[order].tobytes(), held[order].astype("<f4").tobytes()])
                    known, gamma = np.concatenate((known, ctx[first][~some])), np.concatenate((gamma, own_gamma[~some]))
                if len(known):
                    order = np.argsort(known)
                    put_file(f"{folder}/contexts", f"{s}", [struct.pack("<q", len(known)), known[order].tobytes(), gamma[order].astype("<f4").tobytes()])
                w, c, cont = _read(folder, "words", s, "<u8", "<i8", "<i8")
                if len(w):
                    p = np.maximum(cont - d1[np.minimum(cont, 3)], 0) / total + floor
                    put_file(f"{folder}/unigrams", f"{s}", [struct.pack("<q", len(w)), w.tobytes(), c.tobytes(), p.astype("<f8").tobytes()])
                yield pd.DataFrame({"shard": [s]})

    spark.range(shards, numPartitions=min(shards, 512)).select(F.col("id").cast("int").alias("shard")).mapInPandas(finish, "shard int").agg(F.count("*")).first()
    put_file(folder, "meta.json", [json.dumps({"floor": floor, "tokens": tokens, "types": types, "hot": [int(u) for u in hot]}).encode()])
    work.drop(merged)
    work.remove(f"{folder}/raw")
    return Model(folder, shards, tokens, types, total)


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D(0..3+) of modified Kneser-Ney; where counts of counts are missing, the usual 0.5, 1, 1.5."""
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))])


def _read(folder: str, kind: str, shard: int, *types: str) -> list[np.ndarray]:
    try:
        raw = map_file(f"{folder}/{kind}", f"{shard}")
    except FileNotFoundError:  # an empty shard has no file
        return [np.empty(0, t) for t in types]
    (n,) = struct.unpack("<q", raw[:8].tobytes())
    at, out = 8, []
    for t in types:
        size = n * np.dtype(t).itemsize
        out.append(raw[at : at + size].view(t))
        at += size
    return out


class Scorer:
    """Lookups in a model's mapped arrays. Queries come sorted, so that pages of a shard are read in order."""

    def __init__(self, model: Model):
        self.m = model
        self.shift = np.uint64(64 - int(math.log2(model.shards)))
        meta = json.loads(map_file(model.folder, "meta.json").tobytes())
        self.floor, self.hot = meta["floor"], np.array(meta["hot"], np.uint64)
        self.held: OrderedDict[tuple[str, int], list[np.ndarray]] = OrderedDict()

    def _find(self, kind: str, keys: np.ndarray, *types: str) -> tuple[np.ndarray, ...]:
        """Values of sorted distinct keys, 0 where there is none."""
        out = [np.zeros(len(keys), t) for t in types]
        shard = (keys >> self.shift).astype(np.int64)
        edge = np.searchsorted(shard, np.arange(self.m.shards + 1))
        for s in np.flatnonzero(np.diff(edge)):
            if (kind, s) not in self.held:
                self.held[kind, s] = _read(self.m.folder, kind, s, "<u8", *types)
                while len(self.held) > MOST_MAPS:
                    self.held.popitem(last=False)
            self.held.move_to_end((kind, s))
            known, *vals = self.held[kind, s]
            if not len(known):
                continue
            q = keys[edge[s] : edge[s + 1]]
            at = np.minimum(np.searchsorted(known, q), len(known) - 1)
            hit = known[at] == q
            for o, v in zip(out, vals, strict=True):
                o[edge[s] : edge[s + 1]] = np.where(hit, v[at], 0)
        return tuple(out)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, model score) of whole texts, in log10."""
        ctx, tok, n = _tokens(texts)
        first = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)[:-1]))
        w, inv = np.unique(tok, return_inverse=True)
        c, p1 = self._find("unigrams", w, "<i8", "<f8")
        p1 = np.where(p1 > 0, p1, self.floor)
        base = np.log10((c + 0.5) / (self.m.tokens + 0.5 * (self.m.types + 1)))
        cw, cinv = np.unique(ctx, return_inverse=True)
        (gamma,) = self._find("contexts", cw, "<f4")
        gamma = np.where(gamma > 0, gamma.astype(float), 1.0)  # an unseen context leaves all to the words alone
        key, kinv = np.unique(pair_key(ctx, tok, self.hot), return_inverse=True)
        (held,) = self._find("pairs", key, "<f4")
        p = held.astype(float)[kinv] + gamma[cinv] * p1[inv]
        return n, np.add.reduceat((c > 0)[inv].astype(np.int64), first), np.add.reduceat(base[inv], first), np.add.reduceat(np.log10(p), first)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score) for every row. A null or empty text is its end token alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for b in batches:
            texts, ids = list(b["t"]), b["i"].astype("Int64").array
            for x, y in by_bytes(texts):
                n, known, base, s = scorer.score(texts[x:y])
                yield pd.DataFrame({"i": ids[x:y], "n_tokens": n, "n_known": known, "base_score": base, "score": s})

    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return src.mapInPandas(run, "i long, n_tokens long, n_known long, base_score double, score double").withColumnRenamed("i", id_col)
