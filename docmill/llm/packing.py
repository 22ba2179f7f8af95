"""Packing: documents into fixed windows by multiway Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Unicode white space, as the pre-tokeniser's pattern understands it.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: White space that is more than single blanks and line ends between words.
_ODD = re.compile(f"[{_WS}][{_WS}]|[\\t\\v-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]|^ | $")


class _Words(dict):
    """Word -> its ids as little-endian 32-bit bytes, in two generations of at most `most` words each."""

    def __init__(self, encode: Callable[[str], list[int]], before: str, most: int):
        super().__init__()
        self.encode, self.before, self.most, self.old, self.made = encode, before, most, {}, 0

    def __missing__(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            out = array("I", self.encode(self.before + word)).tobytes()
            self.made += 1
        if len(word) > 64:  # long runs seldom recur, and would make the bounded number of words large
            return out
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes -> id of a byte-level BPE file whose ids follow its merges; None for any other file."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    kind = model.get("pre_tokenizer") or {}
    body = model["model"]
    if body.get("type") != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or model.get("normalizer"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
    vocab = body["vocab"]
    special = {t["content"] for t in model.get("added_tokens", [])}
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in body["merges"]]
    if any(vocab.get(m) != 256 + i for i, m in enumerate(merges)):
        return None
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}


class Ids:
    """Whole texts to ids of a tokenizer file, each distinct word encoded once while it stays in a bounded cache; where words seldom recur, texts are
    encoded as they are for a while, which costs less than words that are not remembered.

    A byte-level BPE whose ids are its merge ranks is run by the faster of the two installed libraries, from the same
    file, after a probe against the tokenizers library; any other file, or a failed probe, by tokenizers itself, whole texts.
    """

    #: Words after which it is seen whether they recur, texts then encoded as they are, and the share of new words (one in so many) from which on.
    SEEN, AS_THEY_ARE, NEW = 100_000, 2_000, 6
    PROBE = "It's 12 tests,\n\n  \u00e9t\u00e9 \u00df \u4e2d\u6587 <|endoftext|> a_b\t'll\u3000x  \n don't!! \U0001f600"

    def __init__(self, path: str, pattern: str, most: int = 60_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        self.first = self.rest = self.whole = None
        self.left = self.seen = 0
        if ranks := byte_ranks(path):
            import tiktoken

            core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            if core.encode_ordinary(self.PROBE) == self.slow.encode(self.PROBE, add_special_tokens=False).ids:
                self.whole = lambda text: core.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
                self.first, self.rest = _Words(core.encode_ordinary, "", most), _Words(core.encode_ordinary, " ", most)

    def encode(self, text: str) -> bytes:
        if self.first is None:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.left:
            self.left -= 1
            return self.whole(text)
        first, rest, out = self.first, self.rest, []
        self.seen += text.count(" ") + 1
        if self.seen > self.SEEN:
            self.left = self.AS_THEY_ARE if self.NEW * (first.made + rest.made) > self.seen else 0
            self.seen = first.made = rest.made = 0
        if _ODD.search(text):
            return b"".join([rest[w[1:]] if w[0] == " " and len(w) > 1 and w[1] != " " else first[w] for w in _CHUNK.findall(text)])
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(first["\n"])
            head, *words = line.split(" ")
            if head:
                out.append(first[head])
            out += [rest[w] for w in words]
        return b"".join(out)


def tokenize_pieces(docs: DataFrame, tokenizer: str, pattern: str, end_id: int = 1, capacity: int = 2048, tail: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids (its text's, then end_id), cut into pieces of `capacity` ids and a rest in pieces of at most `tail`.

    A null text counts as empty and is the end id alone. Every row is a document of its own, repeated ids included
    (`row` tells them apart). Ids equal whole-text encoding, as the vocabulary's merges never cross its pre-tokens;
    tests hold them against it. `tokenizer` is a file on every worker, never copied elsewhere.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows, seq = Ids(tokenizer, pattern), [], 0
        for b in batches:
            for d, t in zip(b["d"], b["t"], strict=True):
                raw = ids.encode(t or "") + end
                n = len(raw) // 4
                whole = n - n % capacity
                for s, step in [*((s, capacity) for s in range(0, whole, capacity)), *((s, tail) for s in range(whole, n, tail))]:
                    part = raw[4 * s : 4 * min(n, s + step)]
                    rows.append((d, s, len(part) // 4, zlib.crc32(part), n, seq))
                seq += 1
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
        yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])
        out["doc_id"] = pd.array(out["doc_id"], "Int64")
        return out

    src = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    return src.mapInPandas(run, PIECE_SCHEMA + ", row long")


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Karmarkar-Karp: partition items into k sets of nearly equal sums.

    Partial partitions wait in a heap by their spread; the two widest are merged, the largest sums of one
    with the smallest of the other, until one is left. Sums are kept less their least; ties go to the older.
    """
    order = np.argsort(-sizes, kind="stable")
    heap, parts, n = [], {}, 0
    # the widest of all, the single items, meet in order of size: k of them make a first partition at no cost
    for at in range(0, len(order), k):
        block = order[at : at + k]
        sums = np.zeros(k, np.int64)
        sums[k - len(block) :] = sizes[block][::-1]
        sets: list[list[int]] = [[] for _ in range(k - len(block))] + [[int(i)] for i in block[::-1]]
        low = sums[0]
        heap.append((-int(sums[-1] - low), n))
        parts[n] = (sums - low, sets)
        n += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, pa), (sb, pb) = parts.pop(a), parts.pop(b)
        sums = sa + sb[::-1]
        sets = [x + y for x, y in zip(pa, reversed(pb), strict=True)]
        turn = np.argsort(sums, kind="stable")
        sums = sums[turn]
        sums -= sums[0]
        heapq.heappush(heap, (-int(sums[-1]), n))
        parts[n] = (sums, [sets[i] for i in turn])
        n += 1
    return next(iter(parts.values()))[1] if parts else []


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """The fewest windows that differencing fits: the count starts at ceil(sum / capacity) and rises while a window exceeds the capacity."""
    total = int(sizes.sum())
    k = max(1, -(-total // capacity))
    while True:
        sets = difference(sizes, k)
        over = sum(max(0, int(sizes[s].sum()) - capacity) for s in sets)
        if not over:
            return [s for s in sets if s]
        k += max(1, over // capacity)


def pack(pieces: DataFrame, capacity: int = 2048, block: int = 1024) -> DataFrame:
    """Give each piece sequence_id and offset. Needs doc_id, start, length; the other columns stay.

    Full pieces are sequences of their own. Shorter ones are dealt at random (by a hash) to blocks of about
    `block` pieces; each block is packed by itself, so no task holds more than a block however the
    input grows. Sequence ids: block number * 2**22 + window, and for full pieces from 2**62 on, by a hash-free running
    number over partitions. Offsets are gapless from 0.
    """
    spark = pieces.sparkSession
    n = pieces.where(F.col("length") < capacity).count()
    blocks = max(1, round(n / block))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*names)
    full = pieces.where(F.col("length") >= capacity).select("*", (F.lit(1 << 62) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = full.schema

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([c for c in ("doc_id", "start", "row", "length") if c in g], kind="stable").reset_index(drop=True)
        sizes = g["length"].to_numpy(np.int64)
        seq, off = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        for w, members in enumerate(windows(sizes, capacity)):
            at = 0
            for i in members:
                seq[i], off[i] = w, at
                at += sizes[i]
        g["sequence_id"] = (np.int64(g["_b"].iloc[0]) << 22) + seq
        g["offset"] = off
        return g[[f.name for f in schema.fields]]

    key = [F.col(c) for c in ("doc_id", "start", "row") if c in names]
    short = pieces.where(F.col("length") < capacity).withColumn("_b", F.pmod(F.xxhash64(*key, F.lit(11)), F.lit(blocks)))
    packed = short.groupBy("_b").applyInPandas(run, schema)
    return full.unionByName(packed)


def piece_counts(pieces: DataFrame) -> DataFrame:
    """Sequences, tokens and padding by the rule that a sequence is padded to its capacity unless its length is a power of two."""
    s = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    two = F.expr("(n & (n - 1)) = 0")
    return s.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(two, 0).otherwise(2048 - F.col("n"))).alias("padding"))

