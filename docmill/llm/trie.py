"""Conversation prefix trie: partial tries of partitions, merged as a tree, then rolled up from below."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import WORD_RE, Work, join_classes

#: Key of the textless root.
ROOT = bytes(16)
#: Nodes and ends that a partial trie holds before it is sent on.
PARTIAL = 50_000
#: Partial tries that one merge brings together.
FAN_IN = 64
#: Ends in one run of a node's list.
RUN = 65_536


def head_length(conv_id: int) -> int:
    """Turns that a rebuilt conversation takes from its family's first one: crc32 of the id as text, mod 4."""
    return zlib.crc32(str(conv_id).encode()) % 4


def _head_column(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(conversations: DataFrame, family: int = 20) -> DataFrame:
    """(conv_id, src, turn, key, words): the turns that rebuild each conversation, in order of src, turn (null first) and key.

    src 0: the family's head, the first head_length() turns of conversation `conv_id - conv_id % family`; src 1: all of its own turns, whose
    first head_length() the reader passes over. key: a 16-byte hash of role and text, the tie order of equal turns; words: of the text.
    Only hashes move, no texts. Null role or text: empty. Rows without a conv_id belong to no conversation and make none.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.substring(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD_RE)).cast("long").alias("words"))
    ids = own.select("conv_id").distinct().select(F.col("conv_id").alias("c"), (F.col("conv_id") - F.col("conv_id") % family).alias("conv_id"), _head_column(F.col("conv_id")).alias("h"))
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "key"))
    heads = own.where(F.col("conv_id") % family == 0).withColumn("nth", nth).where("nth <= 3")  # three of each before the shuffle too
    taken = ids.join(heads, "conv_id").where("nth <= h").select(F.col("c").alias("conv_id"), F.lit(0).alias("src"), "turn", "key", "words")
    return taken.unionByName(own.select("conv_id", F.lit(1).alias("src"), "turn", "key", "words"))


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The partition's trie, a node's members and ends summed; a full one is sent on and a new one begun.

    What is held: at most PARTIAL nodes and ends, and the keys of one conversation's path.
    """
    where = TaskContext.get().partitionId()
    nodes: dict[bytes, list] = {}
    held = 0

    def member(key: bytes, conv: int, depth: int, words: int, path: list[bytes]) -> list:
        nonlocal held
        n = nodes.get(key)
        if n is None:
            held += 1
            n = nodes[key] = [depth, conv, 0, words, [path[depth - (1 << k)] for k in range(depth.bit_length())], []]
        n[1] = min(n[1], conv)
        n[2] += 1
        return n

    def table() -> pa.RecordBatch:
        cols = list(zip(*nodes.values(), strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays(
            [pa.array(list(nodes), pa.binary()), pa.array([where] * len(nodes), pa.int64()), *[pa.array(cols[i], pa.int64()) for i in range(4)], pa.array(cols[4], pa.list_(pa.binary())), pa.array(cols[5], pa.list_(pa.int64()))],
            names=["node", "part", "depth", "conv_id", "n_convs", "words", "up", "ends"],
        )

    conv, skip, path, last = None, 0, [], None
    for batch in batches:
        for c, src, key, words in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "src", "key", "words")], strict=True):
            if c != conv:
                if last is not None:
                    last[5].append(conv)
                    held += 1
                if held >= PARTIAL:
                    yield table()
                    nodes.clear()
                    held = 0
                conv, skip, path = c, head_length(c), [ROOT]
                last = member(ROOT, c, 0, 0, path)
            if src:
                if skip:
                    skip -= 1
                    continue
            at = hashlib.blake2b(path[-1] + key, digest_size=16).digest()
            path.append(at)
            last = member(at, c, len(path) - 1, words, path)
            if held >= PARTIAL:  # one path can be longer than a trie may be
                at_end = path[-1]
                yield table()
                nodes.clear()
                held = 0
                last = nodes[at_end] = [len(path) - 1, c, 0, words, [path[len(path) - 1 - (1 << k)] for k in range((len(path) - 1).bit_length())], []]
    if last is not None:
        last[5].append(conv)
    yield table()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring ends of one node, in order, as runs of comma-joined text."""
    node, ids, out = None, [], []

    def row() -> tuple:
        return node, ids[0], ",".join(map(str, ids)).encode()

    def table() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        got = pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["node", "first", "ids"])
        out.clear()
        return got

    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if n != node or len(ids) >= RUN:
                if ids:
                    out.append(row())
                node, ids = n, []
            ids.append(c)
        yield table()
    if ids:
        out.append(row())
    yield table()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs, one after another."""
    node, h, keys, out = None, None, [], []
    for batch in batches:
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if n == node:
                h.update(b",")
            else:
                if h:
                    keys.append(node)
                    out.append(h.hexdigest())
                node, h = n, hashlib.sha256()
            h.update(ids)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["node", "ends_sha256"])
        keys, out = [], []
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of ends (node, conv_id): the ids of a node in ascending order, comma-joined.

    Ranges of (node, conv_id) become runs first, so the ends of one node are sorted and joined by many tasks; the hash itself, which is
    sequential, reads a few runs a node.
    """
    runs = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_runs, "node binary, first long, ids binary")
    return runs.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def merge(partial: DataFrame, parts: int) -> DataFrame:
    """Partial node tables (node, part, depth, conv_id, n_convs, words, up) of `parts` partitions as one: FAN_IN of them at a time, then those, and so on."""
    same = [F.first(c).alias(c) for c in ("depth", "words", "up")]
    sums = [F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")]
    while parts > 1:
        partial = partial.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("node", "part").agg(*same, *sums)
        parts = -(-parts // FAN_IN)
    return partial


def rollup(work: Work, nodes: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens): sums over each node's subtree of `leaves` and `saved`.

    Bottom up by doubling: after round k a node has the sums of all nodes less than 2 ** (k + 1) below it, which it gets from those exactly
    2 ** k below (up[k] names a node's ancestor so far up). Rounds follow the logarithm of the depth, and rows are summed before they move.
    """
    cur = work.keep(nodes.select("node", "depth", "up", "leaves", "saved"), "roll")
    deepest = cur.agg(F.max("depth")).first()[0] or 0
    for k in range(int(deepest).bit_length()):
        low = cur.where(F.col("depth") >= (1 << k)).groupBy(F.col("up")[k].alias("node")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        new = cur.join(low, "node", "left").select("node", "depth", "up", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        new = work.keep(new, "roll")
        work.drop(cur)
        cur = new
    return cur.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, family: int = 20) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (see rebuilt()): node (its key), conv_id (its smallest member), depth, parent_conv_id
    (null for the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A partition's conversations become partial tries in one sorted pass; partial node tables are merged by key; nodes of a single member need no
    rollup (they have one leaf below or are it, and save nothing), the shared ones are rolled up by doubling. A conversation's path is one chain of
    hashes, so its turns pass one task in order, as hashes; members, ends and children of a node never meet in one.

    Nulls: turn first, role and text empty, rows without conv_id make no conversation. Rows of one turn: in the order of their hashes; repeated
    rows are turns of their own. An empty table has no nodes. Other columns are left out.
    """
    work = Work(conversations.sparkSession, "trie")
    rows = rebuilt(conversations, family).repartition("conv_id").sortWithinPartitions("conv_id", "src", F.asc_nulls_first("turn"), "key").select("conv_id", "src", "key", "words")
    schema = "node binary, part long, depth long, conv_id long, n_convs long, words long, up array<binary>, ends array<long>"
    partial = work.keep(rows.mapInArrow(_partial, schema), "partial")
    parts = (partial.agg(F.max("part")).first()[0] or 0) + 2  # a partition may send more than one table
    nodes = work.keep(merge(partial.drop("ends"), parts).drop("part"), "nodes")
    ends = ends_digest(partial.select("node", F.explode("ends").alias("conv_id")))
    below = nodes.where("depth > 0").groupBy(F.col("up")[0].alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    nodes = work.keep(nodes.join(below, "node", "left").na.fill(0, ["n_children", "single"]), "nodes")
    leaves = F.col("single") + (F.col("n_children") == 0).cast("long")
    shared = nodes.where("n_convs > 1").select("node", "depth", "up", leaves.alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    full = nodes.join(rollup(work, shared), "node", "left").join(ends, "node", "left")
    full = full.select(
        "node", "conv_id", "depth", F.get("up", F.lit(0)).alias("parent"), "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
    full = work.keep(full, "full")
    parents = full.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("size"))
    named = join_classes(full.where("depth > 0"), parents, ["parent"], full.count()).drop("size", "parent")
    return named.unionByName(full.where("depth = 0").drop("parent").withColumn("parent_conv_id", F.lit(None).cast("long"))).select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
