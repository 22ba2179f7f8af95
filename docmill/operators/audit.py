"""An append-only log whose entries carry the hash of the one before."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docmill.sources.manifest import State, Table
from docmill.sources.store import Store


def canonical(actor: str, action: str, target_type: str | None, target_id: str | None, meta: dict, prev: str) -> str:
    """JSON with sorted keys, no blanks, ASCII only."""
    return json.dumps({"actor": actor, "action": action, "target_type": target_type, "target_id": target_id, "meta": meta, "prev": prev}, sort_keys=True, separators=(",", ":"), default=str)


def entry_hash(body: str) -> str:
    return hashlib.sha256(body.encode()).hexdigest()


_COLS = ["actor", "action", "target_type", "target_id", "meta"]


@F.pandas_udf(StringType())
def _hashes(actor: pd.Series, action: pd.Series, ttype: pd.Series, tid: pd.Series, meta: pd.Series, prev: pd.Series) -> pd.Series:
    none = lambda x: None if x is None or x != x else x
    return pd.Series([entry_hash(canonical(a, b, none(c), none(d), json.loads(m) if none(m) else {}, none(p) or "")) for a, b, c, d, m, p in zip(actor, action, ttype, tid, meta, prev, strict=True)])


#: Entries that a range of the log should have.
RANGE_ROWS = 1_000_000


def with_previous(log: DataFrame, seq: str = "seq", value: str = "entry_hash", buckets: int | None = None) -> DataFrame:
    """Adds `_prev`: the value of the row before by seq. Rows are dealt to ranges of seq, as many as their number asks for, and the edges of
    ranges are stitched by a small join, so that no task sees the whole log."""
    b = log.agg(F.min(seq).alias("lo"), F.max(seq).alias("hi"), F.count("*").alias("n")).first()
    buckets = buckets or max(64, -(-b["n"] // RANGE_ROWS))
    lo, width = b["lo"] or 0, max(1, -(-((b["hi"] or 0) - (b["lo"] or 0) + 1) // buckets))
    # the number of tasks is given, as adaptive execution would join ranges that are small, but long to hash
    x = log.withColumn("_b", F.floor((F.col(seq) - lo) / width).cast("int")).repartition(min(buckets, int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "_b")
    w = Window.partitionBy("_b").orderBy(seq)
    x = x.withColumn("_in", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = log.withColumn("_b", F.floor((F.col(seq) - lo) / width).cast("int")).groupBy("_b").agg(F.max_by(value, seq).alias("_tail"))
    # at most `buckets` rows: the tail of the nearest non-empty range below
    tails = last.select((F.col("_b")).alias("_b"), F.lag("_tail").over(Window.orderBy("_b")).alias("_edge"))
    return x.join(F.broadcast(tails), "_b", "left").withColumn("_prev", F.when(F.col("_first"), F.col("_edge")).otherwise(F.col("_in"))).drop("_b", "_in", "_first", "_edge")


def verify(log: DataFrame, start: int | None = None) -> DataFrame:
    """One row: ok, checked, first_broken_seq, detail. A row is compared with the stored hash before it, which by induction finds the first break.
    `start`: the number of an entry that is known to be right and only lends its hash."""
    x = with_previous(log).withColumn("_hash", _hashes(*[F.col(c) for c in _COLS], F.coalesce("_prev", F.lit(""))))
    link = F.coalesce("prev_hash", F.lit("")) != F.coalesce("_prev", F.lit(""))
    body = F.col("entry_hash") != F.col("_hash")
    bad = F.when(link, "prev_hash mismatch").when(body, "entry_hash mismatch")
    if start is not None:
        bad = F.when(F.col("seq") != start, bad)
    r = x.agg(F.count("*").alias("n"), F.min(F.when(bad.isNotNull(), F.struct("seq", bad.alias("why")))).alias("b"))
    return r.select(F.col("b").isNull().alias("ok"), F.col("n").alias("checked"), F.col("b.seq").alias("first_broken_seq"), F.concat(F.col("b.why"), F.lit(" at seq "), F.col("b.seq").cast("string")).alias("detail"))


def _parts(actor: str, action: str, target_type: str | None, target_id: str | None, meta: dict) -> tuple[str, str]:
    """What stands before and behind the previous hash in the canonical text of an entry."""
    text = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), default=str)
    head, tail = text({"actor": actor, "action": action, "meta": meta}), text({"target_type": target_type, "target_id": target_id})
    return f'{head[:-1]},"prev":', f",{tail[1:]}"


def rehash(log: DataFrame) -> DataFrame:
    """The log with its chain computed anew in order of seq, stored. Each hash needs the one before, so ranges of at most about RANGE_ROWS entries are chained one
    after another, each by one task that gets the hash before it; the entries' texts are made by all tasks beforehand."""
    store, none = Store(log.sparkSession, "chain"), lambda v: v if isinstance(v, str) else None

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_parts(r.actor, r.action, none(r.target_type), none(r.target_id), json.loads(r.meta) if none(r.meta) else {}) for r in b.itertuples(index=False)]
            b["_head"], b["_tail"] = [x[0] for x in made], [x[1] for x in made]
            yield b

    def chain(before: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            prev = before
            for b in batches:
                links = []
                for head, tail in zip(b["_head"], b["_tail"], strict=True):
                    h = entry_hash(f'{head}"{prev}"{tail}')
                    links.append((prev or None, h))
                    prev = h
                b["prev_hash"], b["entry_hash"] = [x[0] for x in links], [x[1] for x in links]
                yield b.drop(columns=["_head", "_tail"])

        return run

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    tasks = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as a small file is one task, however much work its rows are
    rows = log.repartition(tasks).mapInPandas(texts, f"{fields}, _head string, _tail string")
    size = log.count()
    cuts = log.approxQuantile("seq", [i / n for i in range(1, n)], 0.1 / n) if (n := -(-size // RANGE_ROWS)) > 1 else []
    cuts = sorted({int(c) for c in cuts})
    at = F.lit(0)
    for c in cuts:
        at = at + (F.col("seq") > c).cast("int")
    rows = store.write(rows.withColumn("_range", at).repartition(len(cuts) + 1, "_range"), "texts", by="_range")
    out, prev = None, ""
    for i in range(len(cuts) + 1):
        part = rows.where(F.col("_range") == i).drop("_range").coalesce(1).sortWithinPartitions("seq")
        done = store.write(part.mapInPandas(chain(prev), log.schema), "range")
        tip = done.agg(F.max_by("entry_hash", "seq")).first()[0]
        prev = tip if tip is not None else prev
        out = done if out is None else out.unionByName(done)
    return out


SCHEMA = "seq long, actor string, action string, target_type string, target_id string, meta string, prev_hash string, entry_hash string"


def chained(events: DataFrame, seq: int, prev: str, order: list[str] | None = None) -> DataFrame:
    """Entries for new events (actor, action, target_type, target_id, meta) behind a tip of number `seq` and hash `prev`, in the order of the given columns
    (or all of them). Each hash needs the one before, so a batch is one ordered task through which its rows stream."""
    numbered = events.select(*_COLS, *[c for c in order or [] if c not in _COLS])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, last = seq, prev
        none = lambda v: v if isinstance(v, str) else None
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                at += 1
                h = entry_hash(canonical(r.actor, r.action, none(r.target_type), none(r.target_id), json.loads(r.meta) if none(r.meta) else {}, last))
                rows.append((at, r.actor, r.action, r.target_type, r.target_id, r.meta, last or None, h))
                last = h
            yield pd.DataFrame(rows, columns=["seq", *_COLS, "prev_hash", "entry_hash"])

    return numbered.repartition(1).sortWithinPartitions(*(order or _COLS)).select(*_COLS).mapInPandas(run, SCHEMA)


def append(log: DataFrame, events: DataFrame) -> DataFrame:
    """Rows to add for new events after the log's tip; for several writers see append_to()."""
    tip = log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s"), F.max_by("entry_hash", "seq").alias("h")).first()
    return chained(events.withColumn("_at", F.monotonically_increasing_id()), tip["s"], tip["h"] or "", ["_at"])


def append_to(table: Table, events: DataFrame, order: list[str] | None = None) -> State:
    """Append events to a log that several writers share: the tip is noted in every commit, and a writer that meets another one chains its entries
    anew behind the other's."""
    store = Store(table.spark, "audit")

    def make(s: State) -> tuple[DataFrame, dict]:
        rows = store.write(chained(events, s.notes.get("seq", 0), s.notes.get("hash", ""), order), "entries")
        end = rows.agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("hash")).first()
        return rows, {"seq": end["seq"], "hash": end["hash"]} if end["seq"] is not None else s.notes

    try:
        return table.append_after(make)
    finally:
        store.remove()


# ---------------------------------------------------------------- checkpoints: a tree of digests over ranges of the log

LEAF_ROWS, ARITY = 1000, 16


def _folded(rows: DataFrame, key: str, value: str, by: int) -> DataFrame:
    """(key, digest): digests of runs of `by` neighbouring keys, in order."""
    g = rows.groupBy(F.floor(F.col(key) / by).alias("k")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("i"), F.col(value).alias("v")))).alias("x"))
    text = F.array_join(F.transform("x", lambda e: F.concat(e["i"].cast("string"), F.lit(":"), F.coalesce(e["v"], F.lit("")))), ",")
    return g.select(F.col("k").alias(key), F.sha2(text, 256).alias(value))


def checkpoint(log: DataFrame, upto: int | None = None) -> DataFrame:
    """(level, range, digest): level 0 has a digest per LEAF_ROWS numbers over the stored entries (bodies and hashes) of whole ranges up to `upto`, each level
    above one per ARITY ranges below, up to a root. It is taken from a log that verify() found right."""
    last = upto if upto is not None else log.agg(F.max("seq")).first()[0]
    whole = ((last if last is not None else -1) + 1) // LEAF_ROWS * LEAF_ROWS
    body = F.to_json(F.struct(*[F.coalesce(F.col(c), F.lit("\u0000")).alias(c) for c in (*_COLS, "prev_hash", "entry_hash")]))
    level = _folded(log.where(F.col("seq") < whole).select(F.col("seq").alias("range"), F.sha2(body, 256).alias("digest")), "range", "digest", LEAF_ROWS)
    out, n = level.select(F.lit(0).alias("level"), "range", "digest"), whole // LEAF_ROWS
    depth = 0
    while n > 1:
        depth, n = depth + 1, -(-n // ARITY)
        level = _folded(level, "range", "digest", ARITY)
        out = out.unionByName(level.select(F.lit(depth).alias("level"), "range", "digest"))
    return out


def verify_since(log: DataFrame, known: DataFrame) -> DataFrame:
    """One row: ok, checked, first_broken_seq, detail, before: entries behind the checkpoint are verified by their chain, whose start is the stored hash of the
    last covered entry; those before by the checkpoint's digests, without hashing any entry's chain. `before` says on which side the break is."""
    leaves = known.where("level = 0")
    end = leaves.agg(F.max("range")).first()[0]
    behind = 0 if end is None else (end + 1) * LEAF_ROWS
    now = checkpoint(log.where(F.col("seq") < behind), behind - 1) if behind else leaves.limit(0)
    pair = leaves.select("range", F.col("digest").alias("was")).join(now.where("level = 0").select("range", F.col("digest").alias("is")), "range", "full_outer")
    broken = pair.where(F.coalesce(F.col("was") != F.col("is"), F.lit(True))).agg(F.min("range")).first()[0]
    if broken is not None:
        first = log.where((F.col("seq") >= broken * LEAF_ROWS) & (F.col("seq") < (broken + 1) * LEAF_ROWS)).agg(F.min("seq").alias("s"), F.count("*").alias("n"))
        return first.select(F.lit(False).alias("ok"), F.col("n").alias("checked"), F.lit(broken * LEAF_ROWS).cast("long").alias("first_broken_seq"), F.lit(f"digest mismatch in the range from seq {broken * LEAF_ROWS}").alias("detail"), F.lit(True).alias("before"))
    tail = log.where(F.col("seq") >= behind)
    tip = log.where(F.col("seq") < behind).agg(F.max_by("entry_hash", "seq").alias("h"), F.max("seq").alias("s")).first()
    if tip["h"] is not None:
        tail = tail.unionByName(log.where(F.col("seq") == tip["s"]))
        return verify(tail, start=tip["s"]).withColumn("checked", F.col("checked") - 1).withColumn("before", F.when(~F.col("ok"), F.lit(False)))
    return verify(tail).withColumn("before", F.when(~F.col("ok"), F.lit(False)))
