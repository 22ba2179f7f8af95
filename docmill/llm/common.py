"""What several of the training-data operators share: tables, work folders, word hashing, components."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the class [\x20\x09-\x0D].
SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; read only through Spark, so that any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(doc_id: str, mod: int):
    """Column crc32(id as text) mod `mod`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod)


def crc_of(value) -> int:
    return zlib.crc32(str(value).encode())


# ---------------------------------------------------------------- shared folders


_OWN_DIR: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only where it is unset in a local session, as in tests, a temporary folder serves instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="docmill-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return f"file://{_OWN_DIR[0]}"


class Work:
    """A folder of one call under the shared root; tables written there cut the lineage.

    A result may read its call's tables until it is written. Whoever writes it can then close() the work, or all works
    that were opened since a mark().
    """

    _open: list[Work] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/docmill/{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        Work._open.append(self)

    @staticmethod
    def mark() -> int:
        return len(Work._open)

    @staticmethod
    def close_since(mark: int) -> None:
        """Close the works opened since the mark."""
        for w in Work._open[mark:]:
            w.remove(w.path)
        del Work._open[mark:]

    def close(self) -> None:
        """Delete the folder with all of its tables."""
        self.remove(self.path)
        if self in Work._open:
            Work._open.remove(self)

    def remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def keep(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Write `df` as Parquet and read it back. The shuffle files behind it go once it is written, as its own files stand for it then."""
        self._n += 1
        at = f"{self.path}/{label}-{self._n}"
        clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(clean, "false")
        self.spark.conf.set(clean, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.set(clean, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._docmill_path = at
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables made by keep() that nothing reads any more."""
        for df in frames:
            at = getattr(df, "_docmill_path", None)
            if at:
                self.remove(at)


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path, None for other file systems."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def put_file(folder: str, name: str, parts: list[bytes]) -> None:
    """Write a file into a shared folder; a retried task replaces it whole."""
    here = local_path(folder)
    if here is None:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        tmp = f"{base}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(tmp) as out:
            for p in parts:
                out.write(p)
        fs.move(tmp, f"{base}/{name}")
        return
    os.makedirs(here, exist_ok=True)
    tmp = f"{here}/.{name}.{uuid.uuid4().hex}"
    with open(tmp, "wb") as out:
        for p in parts:
            out.write(p)
    os.replace(tmp, f"{here}/{name}")


def map_file(folder: str, name: str) -> np.ndarray:
    """A file of a shared folder as memory-mapped bytes; a remote one is fetched to the worker first."""
    here = local_path(folder)
    if here is None:
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        with tempfile.NamedTemporaryFile(prefix="docmill-model-") as tmp, fs.open_input_stream(f"{base}/{name}") as src:
            shutil.copyfileobj(src, tmp)
            tmp.flush()
            # the file loses its name here; its bytes go when nothing maps them any more
            return np.memmap(tmp.name, dtype=np.uint8, mode="r") if os.path.getsize(tmp.name) else np.empty(0, np.uint8)
    path = f"{here}/{name}"
    return np.memmap(path, dtype=np.uint8, mode="r") if os.path.getsize(path) else np.empty(0, np.uint8)


# ---------------------------------------------------------------- words as 64-bit hashes

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_POW_N = 1 << 16
with np.errstate(over="ignore"):
    _POW = np.cumprod(np.full(_POW_N, 0x9E3779B97F4A7C15 | 1, np.uint64), dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACE_BYTES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_M1, _M2, _C = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0xD6E8FEB86659FD93)
_S33 = np.uint64(33)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, element by element."""
    h = h ^ (h >> _S33)
    h = h * _M1
    h ^= h >> _S33
    h *= _M2
    h ^= h >> _S33
    return h


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered hash of two hashes."""
    return mix(a * _C + (b ^ (b >> np.uint64(29))) + np.uint64(1))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of `texts` (A-Z lower-cased), and the n + 1 offsets of each text's words."""
    blobs = [(t or "").encode("utf-8", "replace") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in blobs], dtype=np.int64)
    raw = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    keep = ~_SPACE[raw]
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    starts = np.flatnonzero(first)
    bounds = np.zeros(len(texts) + 1, np.int64)
    bounds[1:] = np.searchsorted(starts, ends, "left")
    if not len(starts):
        return np.empty(0, np.uint64), bounds
    pos = np.flatnonzero(keep)
    at = np.searchsorted(pos, starts)  # where each word begins among the kept bytes
    lens = np.diff(np.append(at, len(pos)))
    off = np.arange(len(pos), dtype=np.int64) - np.repeat(at, lens)
    vals = _BYTE[_LOWER[raw[pos]]] * _POW[off & (_POW_N - 1)]
    return mix(np.add.reduceat(vals, at) + lens.astype(np.uint64)), bounds


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text and their offsets; a text of fewer words is one shingle, an empty one none."""
    n = np.diff(bounds)
    full = np.maximum(n - k + 1, 0)
    h = words.copy()
    for i in range(1, k):
        h[: len(h) - i] = combine(h[: len(h) - i], words[i:])
    count = np.where(n == 0, 0, np.maximum(full, 1))
    out_at = np.zeros(len(bounds), np.int64)
    out_at[1:] = np.cumsum(count)
    src = np.repeat(bounds[:-1] - out_at[:-1], count) + np.arange(out_at[-1])
    out = h[src] if len(src) else np.empty(0, np.uint64)
    for i in np.flatnonzero((n > 0) & (n < k)):
        x = words[bounds[i] : bounds[i] + 1]
        for j in range(1, n[i]):
            x = combine(x, words[bounds[i] + j : bounds[i] + j + 1])
        out[out_at[i]] = mix(x ^ np.uint64(n[i]))[0]
    return out, out_at


def by_bytes(texts: list[str | None], most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Slices of `texts` of about `most` characters each, so that memory follows neither row counts nor text lengths."""
    i = size = 0
    for j, t in enumerate(texts):
        size += len(t) if t else 1
        if size >= most:
            yield i, j + 1
            i, size = j + 1, 0
    if i < len(texts):
        yield i, len(texts)


# ---------------------------------------------------------------- classes of equal rows


#: Classes that are broadcast at most, those of the most rows (about 40 bytes each).
HOT_CLASSES = 20_000


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], total: int, size: str = "size") -> DataFrame:
    """`rows` with the columns of their class, by `keys`; `total`: the sum of the classes' sizes.

    Classes of more than total / HOT_CLASSES rows, of which there can be no more than HOT_CLASSES, are broadcast, so that the rows of one class
    never meet in one task; the others are shuffled.
    """
    most = max(1000, total // HOT_CLASSES)
    hot = F.broadcast(classes.where(F.col(size) > most))
    many = rows.join(hot, keys)
    few = rows.join(F.broadcast(classes.where(F.col(size) > most).select(*keys)), keys, "left_anti").join(classes.where(F.col(size) <= most), keys)
    return many.unionByName(few)


# ---------------------------------------------------------------- components


def components(work: Work, edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable by edges (a, b), for every node of an edge.

    Alternates large-star and small-star steps, which need a number of rounds logarithmic in the
    size of a component; each round is written to the shared folder, nothing comes to the driver
    but a count and a checksum.
    """
    e = work.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    said = None
    for _ in range(60):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = work.keep(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        n = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        work.drop(e)
        e = new
        if tuple(n) == said:
            break
        said = tuple(n)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()
