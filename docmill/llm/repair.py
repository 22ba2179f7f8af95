"""Conversation repair: a forward Viterbi pass over each conversation's turns, four grammar states, the least (cost, audit string) kept in each."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
#: Role initials that lead from a state to the next. 0: nothing yet, 1: after system, 2: after user, 3: after assistant; 0 and 3 may end.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that an inserted or re-roled turn takes in each state, and the state it leads to.
WANTED, LEADS = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
ENDS = (0, 3)
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
OPS = "DKR"
LEGAL = {"su", "ua", "au"}

_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_ARROW = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): rows damaged by crc32 of `conv_id:turn` mod 20, nulls as one space.

    0 drops a row (it stays here, emptied and marked as gone, so that no conversation is lost), 1 empties its text, 2 takes its full stops,
    exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    at = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(at("conv_id"), F.lit(":"), at("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), at("role").alias("role"), at("text").alias("text"), k.alias("k"))
    text = F.when(F.col("k") <= 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("k") == 0).alias("gone"), copies.alias("copy")).drop("copy")


class Viterbi:
    """The pass over one conversation. Held: eight bytes a turn for the way back, a hash of what each state would write, and the turns' 16-byte hashes.

    Audit strings are compared without being kept: those of one layer are told apart by a character of their rank, what is added to them is
    written behind it. Two audits of a layer before its insertions hold as many K, R and D, so none begins another, and their order stays.
    """

    def __init__(self) -> None:
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.days = 0
        self.low = self.high = self.initial = None
        self.seen: set[bytes] = set()
        self.back = bytearray()
        self.live = self._close({0: (0, "0", 0, 0)}, {0: None})

    def _close(self, layer: dict[int, tuple], wrote: dict[int, object]) -> dict[int, tuple]:
        """Up to three insertions behind a layer (state: cost, rank and signs, core state, insertions); each state's way back is noted."""
        best = {s: (c, key, s, 0) for s, (c, key, *_) in layer.items()}
        for _ in range(3):
            for s, (c, key, core, n) in list(best.items()):
                new = (c + INSERT, key + "I", core, n + 1)
                if LEADS[s] not in best or new[:2] < best[LEADS[s]][:2]:
                    best[LEADS[s]] = new
        hashes = {}
        for s, (_, _, core, n) in best.items():
            h, at = wrote[core], core
            for _ in range(n):
                h = _write(h, WANTED[at], "")
                at = LEADS[at]
            hashes[s] = h
        self.back += bytes(best[s][2] | best[s][3] << 2 if s in best else 0 for s in range(4))
        return {s: (best[s][0], best[s][1], hashes[s]) for s in best}

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.n += 1
        if turn is not None:
            self.days += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        initial = role[:1]
        self.illegal += self.initial is not None and self.initial + initial not in LEGAL
        self.initial = initial
        bare = text.rstrip(SPACE)
        mark = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        extra, must_go = 0, True
        if not bare:
            self.blank += 1
        elif mark in self.seen:
            self.duplicate += 1
        else:
            must_go = False
            if bare[-1] not in ".!?":
                self.truncated += 1
                extra = TRUNCATED
        self.seen.add(mark)
        found: dict[int, tuple] = {}
        for s, (c, key, _) in self.live.items():
            ways = [(c + DELETE, key + "D", s, 0, s)]
            if not must_go:
                if initial in GRAMMAR[s]:
                    ways.append((c + extra, key + "K", s, 1, GRAMMAR[s][initial]))
                ways.append((c + REROLE + extra, key + "R", s, 2, LEADS[s]))
            for *way, to in ways:
                if to not in found or tuple(way[:2]) < found[to][:2]:
                    found[to] = tuple(way)
        rank = {key: chr(48 + i) for i, key in enumerate(sorted(w[1] for w in found.values()))}
        wrote = {to: self.live[s][2] if op == 0 else _write(self.live[s][2], role if op == 1 else WANTED[s], text) for to, (_, _, s, op) in found.items()}
        self.back += bytes(found[s][2] | found[s][3] << 2 if s in found else 0 for s in range(4))
        self.live = self._close({to: (w[0], rank[w[1]]) for to, w in found.items()}, wrote)

    def result(self) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest)."""
        end = min((s for s in ENDS if s in self.live), key=lambda s: self.live[s][:2])
        cost, _, h = self.live[end]
        signs, at = [], end
        for i in range(self.n, -1, -1):
            core = self.back[8 * i + at]
            signs.append("I" * (core >> 2))
            if i:
                op = self.back[8 * i - 4 + (core & 3)]
                signs.append(OPS[op >> 2])
                at = op & 3
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.days
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(signs)), (h or hashlib.sha256()).hexdigest()


def _write(h: object, role: str, text: str) -> object:
    h2 = h.copy() if h else hashlib.sha256()
    h2.update(f"{chr(10) if h else ''}{role}:{text}".encode())
    return h2


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, way, out = (), None, []

    def table() -> pa.RecordBatch:
        got = pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in out], schema=_ARROW)
        out.clear()
        return got

    for batch in batches:
        for c, turn, role, text, gone in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "gone")], strict=True):
            if (c,) != conv:
                if way:
                    out.append((*conv, *way.result()))
                conv, way = (c,), Viterbi()
            if not gone:
                way.add(turn, role, text)
        yield table()
    if way:
        out.append((*conv, *way.result()))
    yield table()


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "text")


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of `turns` (conv_id, turn, role, text, gone; as of damage()): gaps, the counts of blank, duplicate, truncated and
    illegally following turns, cost, audit (initials of the cheapest edits: Keep, Rerole, Delete, Insert; of equally cheap ones the least) and
    repaired_sha256, the hash of the repaired turns as lines `role:text`. repaired_turns() gives these turns themselves.

    A conversation's turns stream through one task in order of turn (null first), role and text; what is held of them does not grow with their
    texts. Repeated rows are duplicates; a conversation without turns has zeros, an empty audit and the empty string's hash; rows without
    conv_id are one conversation; an empty table gives no rows; other columns are left out.
    """
    return _in_order(turns).select("conv_id", "turn", "role", "text", "gone").mapInArrow(_repair, _SCHEMA)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, audit, at, state, pos = (), "", 0, 0, 0
    out: list[tuple] = []

    def put(role: str, text: str, edit: str) -> None:
        nonlocal state, pos
        out.append((*conv, pos, role, text, edit))
        pos += 1
        state = GRAMMAR[state][role[0]]

    def inserted() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            put(WANTED[state], "", "I")
            at += 1

    for batch in batches:
        for c, turn_audit, role, text in zip(*[batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text")], strict=True):
            if turn_audit is not None:
                conv, audit, at, state, pos = (c,), turn_audit, 0, 0, 0
                inserted()
                continue
            op, at = audit[at], at + 1
            if op != "D":
                put(role if op == "K" else WANTED[state], text, op)
            inserted()
        cols = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *[pa.array(x, pa.string()) for x in cols[2:]]], names=["conv_id", "pos", "role", "text", "edit"])
        out.clear()


def repaired_turns(turns: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, edit): the turns of every repaired conversation, each kept (K), re-roled (R) or inserted (I); deleted ones are gone.

    turns: as given to repair(); repairs: what it returned. A conversation's audit is sorted before its turns, which then stream by.
    """
    rows = turns.where("not gone").select("conv_id", F.lit(1).alias("src"), F.lit(None).cast("string").alias("audit"), "turn", "role", "text")
    audits = repairs.select("conv_id", F.lit(0).alias("src"), F.coalesce("audit", F.lit("")).alias("audit"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"))
    return _in_order(rows.unionByName(audits), "src").select("conv_id", "audit", "role", "text").mapInArrow(_apply, "conv_id long, pos long, role string, text string, edit string")
