"""Overlapping chunks of page texts, and vectors for them."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, OrderedDict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docmill.functions import text as T
from docmill.functions import values as V

TARGET, OVERLAP = 600, 90
#: Bytes of texts that a worker chunks at once.
CHUNKED = 1 << 20


_ENDS = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def chunk_text(text: str, target: int = TARGET, overlap: int = OVERLAP) -> list[str]:
    """Sentences packed into chunks of about `target` characters; each but the first begins with the last `overlap` of the one before.

    Every sentence is looked at once, so the work grows with the text.
    """
    out: list[str] = []
    held: list[str] = []
    size = 0
    for unit in _ENDS.split(text.strip()):
        unit = unit.strip()
        if not unit:
            continue
        if held and size + 1 + len(unit) > target:
            out.append(" ".join(held))
            held = [t] if (t := out[-1][-overlap:].strip()) and overlap else []
            size = sum(map(len, held))
        size += len(unit) + bool(held)
        held.append(unit)
    return [*out, " ".join(held)] if held else out


def chunk_pages(pages: DataFrame, doc_col: str = "document_id", text_col: str = "text", page_col: str | None = "page_no", target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """(document, page, chunk_index, text): chunks numbered through a document's pages."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # a few rows at a time: a batch is bounded in rows, not in the length of its texts
            for s, e in T.runs(pc.fill_null(pc.binary_length(b.column("_t")), 0).to_pylist(), CHUNKED):
                part = b.slice(s, e - s)
                made = pa.array([chunk_text(t or "", target, overlap) for t in part.column("_t").to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*part.schema.names[:-1], "_c"])

    keys = pages.select(doc_col, *([page_col] if page_col else []))
    base = pages.select(*keys.columns, F.col(text_col).cast("string").alias("_t")).mapInArrow(split, StructType([*keys.schema, StructField("_c", ArrayType(StringType()))]))
    if not page_col:
        return base.select(doc_col, F.posexplode("_c").alias("chunk_index", "text"))
    w = Window.partitionBy(doc_col).orderBy(page_col).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.size("_c")).over(w), F.lit(0))
    return base.withColumn("_at", at).select(doc_col, page_col, "_at", F.posexplode("_c").alias("_i", "text")).select(doc_col, page_col, (F.col("_at") + F.col("_i")).cast("int").alias("chunk_index"), "text")


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _terms(text: str | None) -> list[str]:
    words = _WORD.findall((text or "").lower())
    return [*words, *map(" ".join, zip(words, words[1:], strict=False))]


def hashing_embedder(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for an embedding model: signed hashes (MD5) of words and word pairs, scaled to length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in _terms(t):
                h = hashlib.md5(w.encode(), usedforsecurity=False).digest()
                out[i, int.from_bytes(h[:4], "big") % dim] += 1 if h[4] >= 128 else -1
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-12)

    return embed


#: Embedders by name; each is made from its options, once a worker.
EMBEDDERS: dict[str, Callable[..., Callable[[list[str]], np.ndarray]]] = {"hashing": hashing_embedder}


def word_cosine(a: str | None, b: str | None) -> float:
    """What hashing_embedder() estimates: the cosine of the counts of two texts' words and word pairs, without the collisions of their hashes."""
    x, y = Counter(_terms(a)), Counter(_terms(b))
    norm = sum(n * n for n in x.values()) * sum(n * n for n in y.values())
    return sum(n * y[w] for w, n in x.items()) / norm**0.5 if norm else 0.0


#: Embedders whose vectors are sketches, and the cosine of two texts that these estimate.
EXACT: dict[Callable, Callable[[str | None, str | None], float]] = {hashing_embedder: word_cosine}


def exact_of(factory: Callable) -> Callable[[str | None, str | None], float] | None:
    """The cosine that an embedder's vectors estimate, if they are sketches."""
    return EXACT.get(getattr(factory, "func", factory))


def embedder_of(name: str, **options) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """A factory of the named embedder, as embed() takes it."""
    if name not in EMBEDDERS:
        raise ValueError(f"unknown embedder: {name}")
    return partial(EMBEDDERS[name], **options)


def health(factory: Callable[[], Callable[[list[str]], np.ndarray]], dim: int | None = None) -> dict:
    """ok, dim and what is wrong, from a vector of one short text: a model that fails, another dimension than asked for, or values that are no numbers."""
    try:
        v = np.asarray(factory()(["ok"]))
    except Exception as e:  # a model may fail in any way; that is what is reported
        return {"ok": False, "dim": None, "error": str(e)}
    if v.ndim != 2 or len(v) != 1 or not np.isfinite(v).all():
        return {"ok": False, "dim": None, "error": "not one vector of numbers a text"}
    wrong = dim is not None and v.shape[1] != dim
    return {"ok": not wrong, "dim": v.shape[1], "error": f"dimension {v.shape[1]}, not {dim}" if wrong else None}


#: Texts that a model is given at once.
EMBEDDED = 256
#: Vectors that a worker keeps, those used last.
CACHED = 4096


class LastUsed:
    """A model behind a bounded memory of its last used texts: equal texts are embedded once while they are remembered."""

    def __init__(self, model: Callable[[list[str]], np.ndarray], size: int = CACHED):
        self.model, self.size, self.held, self.asked = model, size, OrderedDict(), 0

    def __call__(self, texts: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(t for t in texts if t not in self.held))
        # copies: a row of the model's answer would keep the whole answer in memory
        fresh = {t: np.array(v) for t, v in zip(new, self.model(new), strict=True)} if new else {}
        self.asked += len(new)
        out = []
        for t in texts:
            v = fresh[t] if t in fresh else self.held[t]
            out.append(v)
        for t in texts:
            self.held[t] = fresh.get(t, self.held.get(t))
            self.held.move_to_end(t)
        while len(self.held) > self.size:
            self.held.popitem(last=False)
        return np.stack(out) if out else np.zeros((0, 0))


def embed(chunks: DataFrame, embedder: Callable[[], Callable[[list[str]], np.ndarray]] = hashing_embedder, text_col: str = "text", cached: int = CACHED, on_failure: str = "raise") -> DataFrame:
    """Adds embedding (array<float>); a model is made once a worker, texts go by Arrow batches, the last `cached` ones are remembered.

    on_failure "null": rows of a batch that the model fails on have no vector, so that one bad text does not end the job; searches pass over them.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = LastUsed(embedder(), cached)
        for b in batches:
            try:
                made = (model([t or "" for t in b.iloc[s : s + EMBEDDED]]) for s in range(0, len(b), EMBEDDED))
                yield pd.Series([v.astype("float32") for part in made for v in part], dtype=object)
            except Exception:
                if on_failure != "null":
                    raise
                yield pd.Series([None] * len(b))

    return chunks.withColumn("embedding", run(F.col(text_col)))


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str, vec_col: str = "embedding", owner: str | None = None) -> DataFrame:
    """The k rows nearest to one vector by cosine, ties by id: partial top-k in every task, no sort of all rows. Scores are rounded after ranking."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if owner is None else vectors.where(V.scope(F.col("owner"), owner))
    return rows.withColumn("score", V.cosine(F.col(vec_col), q)).orderBy(F.desc_nulls_last("score"), id_col).limit(k).withColumn("score", F.round("score", 4))


def nearest_for_all(queries: DataFrame, vectors: DataFrame, k: int, qid: str, id_col: str, vec_col: str = "embedding", q_vec: str = "embedding", block: int = 4096, texts: str | None = None, exact: Callable[[str | None, str | None], float] | None = None, floor: float = 0.0) -> DataFrame:
    """The k nearest rows for each query vector, ties by id: queries and vectors are dealt to blocks, every block of queries meets every block of
    vectors in one task, and only the best k rows of a query and task go on. Nothing but counts comes to the driver.

    This compares a stated set of queries with all rows; scores are rounded after ranking. Vectors are compared with those of their own length; null or
    empty ones, and those with null or non-finite components, are near nothing.

    With `exact`, vectors are sketches of `texts` (a column of both sides): rows of a cosine of `floor` or more are scored by exact() of the two texts,
    should that be lower. Rows without a text keep the vectors' cosine.
    """
    told = F.col(texts) if texts and exact else F.lit(None).cast("string")
    fine = F.expr("size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    q = queries.select(F.col(qid).cast("long").alias("q"), F.col(q_vec).cast("array<double>").alias("v"), told.alias("t")).where("q is not null").where(F.coalesce(fine, F.lit(False))).withColumn("d", F.size("v"))
    base = vectors.select(F.col(id_col).cast("long").alias("i"), F.col(vec_col).cast("array<double>").alias("v"), told.alias("t")).where(F.coalesce(fine, F.lit(False))).withColumn("d", F.size("v"))
    # a long vector counts as several rows of 256 components, so that a block's memory does not grow with the dimension
    rows_of = lambda t: t.agg(F.sum(F.greatest(F.lit(1.0), F.col("d") / 256))).first()[0] or 0
    n = rows_of(q)
    m = rows_of(base) if n else 0
    if not n or not m:  # nothing to compare: the other side need not move
        q, base = q.limit(0), base.limit(0)
    qb, vb = max(1, int(-(-n // block))), max(1, int(-(-m // (8 * block))))
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    # the smaller number of copies: queries go to all blocks of vectors, vectors to all blocks of queries
    left = q.select("d", "q", "v", "t", F.pmod(F.xxhash64("q"), F.lit(qb)).cast("int").alias("a"), every(vb).alias("b"))
    right = base.select("d", "i", F.col("v").alias("w"), "t", every(qb).alias("a"), F.pmod(F.xxhash64("i"), F.lit(vb)).cast("int").alias("b"))

    def unit(rows: pd.Series) -> np.ndarray:
        x = np.stack([np.asarray(v, float) for v in rows])
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"q": [], "i": [], "score": []})
        y = y.sort_values("i", kind="stable")
        ids, at, rows = y["i"].to_numpy(), unit(y["w"]), []
        for s in range(0, len(x), 256):
            part = x.iloc[s : s + 256]
            cos = unit(part["v"]) @ at.T
            if exact:
                for r, t in enumerate(part["t"]):
                    for j in np.flatnonzero(cos[r] >= floor - 1e-4):
                        if t is not None and y["t"].iat[j] is not None:
                            cos[r, j] = min(cos[r, j], exact(t, y["t"].iat[j]))
            low = np.partition(cos, -min(k, cos.shape[1]), axis=1)[:, -min(k, cos.shape[1])]
            for r, (name, c, least) in enumerate(zip(part["q"], cos, low, strict=True)):
                some = np.flatnonzero(c >= least)
                some = some[np.argsort(-c[some], kind="stable")][:k]
                rows.append(pd.DataFrame({"q": name, "i": ids[some], "score": c[some]}))
        return pd.concat(rows)

    got = left.groupBy("d", "a", "b").cogroup(right.groupBy("d", "a", "b")).applyInPandas(best, "q long, i long, score double")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "i")
    return got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias(qid), F.col("i").alias(id_col), F.round("score", 4).alias("score"), "rank")
