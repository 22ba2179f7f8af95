"""Conversation repair and the prefix trie against SQL on the stored tables and plain restatements on odd ones."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from docmill.llm import queries, repair, trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    *[(1, i, "system", "Be brief.", "x") for i in range(3)],
    (2, None, None, None, None), (2, 3, "user", "Hi.", None), (2, 3, "user", "Hi.", None), (2, 3, "assistant", " \t\n", None), (2, 9, "tool", "data", None),
    (3, 0, "", "", None), (4, 1, "assistant", "Well ?", None), (4, 2, "assistant", "No end", None), (4, 0, "user", "x" * 300_000 + ".", None),
    (20, 0, "user", "a b", None), (20, 1, "assistant", "c.", None), (20, 2, "user", "d", None), (21, 5, "user", "own 1.", None), (21, 6, "assistant", "own 2.", None), (21, 7, "user", "own 3.", None), (21, 8, "assistant", "own 4.", None),
    *[(c, i, "user" if i % 2 == 0 else "assistant", f"same {i}.", None) for c in range(40, 60) for i in range(6)],
    (None, 1, "user", "Nobody's.", None), (-7, -2, "assistant", "Below zero!", None), (-7, 4, "user", "?", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(7)


def crc(x):
    return zlib.crc32(x.encode())


def plain_repair(rows):
    """The contract over whole strings; rows of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    live, counts, seen = {0: (0, "", ())}, [0, 0, 0], set()

    def close(ways):
        for _ in range(4):
            for s, (c, a, o) in list(ways.items()):
                to, role = (3, "assistant") if s == 2 else (2, "user")
                new = (c + 3, a + "I", (*o, f"{role}:"))
                if to not in ways or new < ways[to]:
                    ways[to] = new
        return ways

    live = close(live)
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        ways = {}
        for s, (c, a, o) in live.items():
            new = [(s, (c + 4, a + "D", o))]
            if fault not in (0, 1):
                more = 3 if fault == 2 else 0
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, role[:1]))
                if to:
                    new.append((to, (c + more, a + "K", (*o, f"{role}:{text}"))))
                to, want = (3, "assistant") if s == 2 else (2, "user")
                new.append((to, (c + 3 + more, a + "R", (*o, f"{want}:{text}"))))
            for to, way in new:
                if to not in ways or way < ways[to]:
                    ways[to] = way
        live = close(ways)
    cost, audit, out = min(live[s] for s in (0, 3) if s in live)
    turns = [t for t, *_ in rows if t is not None]
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts, bad, cost, audit, out)


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text, *_ in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        k = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        out[c] += [] if k == 0 else [(t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    return out


def test_repair_odd_rows(spark, odd):
    turns = repair.damage(odd)
    got = {r.conv_id: r for r in repair.repair(turns).collect()}
    want = damaged(ODD)
    assert got.keys() == want.keys()
    lines = defaultdict(list)
    for r in repair.repaired_turns(turns, repair.repair(turns)).orderBy("conv_id", "pos").collect():
        lines[r.conv_id].append(f"{r.role}:{r.text}")
    for c, rows in want.items():
        *counts, audit, out = plain_repair(rows)
        r = got[c]
        assert [r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == [*counts, audit], c
        assert r.repaired_sha256 == hashlib.sha256("\n".join(out).encode()).hexdigest() and lines[c] == list(out)


def test_repair_many_random():
    """The pass itself, on random turns of few roles and texts so that ties and duplicates are common."""
    import random

    rng = random.Random(7)
    for _ in range(400):
        rows = [(rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["A.", "B!", "c", " ", "D?", "e."])) for _ in range(rng.randrange(9))]
        way = repair.Viterbi()
        for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])):
            way.add(*r)
        *counts, audit, out = plain_repair(rows)
        assert way.result() == (*counts, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_repair_holds_little():
    """A very long conversation whose states never agree: what is held does not grow with its texts."""
    way = repair.Viterbi()
    for i in range(3000):
        way.add(i, "system", f"{i} " + "x" * 2000 + ".")
    gaps, *_, cost, audit, _ = way.result()
    assert (gaps, len(audit), audit.count("D")) == (0, len(audit), audit.count("D")) and cost > 0 and len(way.back) == 4 + 8 * 3000


def test_repair_empty(spark):
    none = repair.damage(spark.createDataFrame([], SCHEMA))
    assert repair.repair(none).count() == 0
    gone = next(i for i in range(1000) if crc(f"{i}:0") % 20 == 0)
    r = repair.repair(repair.damage(spark.createDataFrame([(gone, 0, "user", "Hi.", "")], SCHEMA))).first()
    assert tuple(r) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = crc(str(c)) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in built.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        saved = sum((len(members[q]) - 1) * len(WORD.findall(q[-1][1])) for q in below if q)
        ends = ",".join(map(str, sorted(c for c in m if built[c] == p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("partial", [50_000, 3])
def test_trie_odd_rows(spark, odd, partial, monkeypatch):
    """Also with tries that are sent on nearly at once, and lists of ends that fall into many runs."""
    monkeypatch.setattr(trie, "FAN_IN", 2)
    rows = trie.rebuilt(odd).repartition("conv_id").sortWithinPartitions("conv_id", "src", "turn", "key")
    assert rows.count() > 0
    got = [tuple(r)[1:] for r in trie.prefix_trie(odd).collect()]
    assert sorted(got, key=str) == plain_trie(ODD)


def test_partial_tries_are_bounded(monkeypatch):
    """One task's output is the same, merged, whatever a partial trie may hold, a single long path included."""
    import pyarrow as pa

    monkeypatch.setattr(trie.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 3})())
    convs = [c for c in range(30) for _ in range(8)] + [99] * 50
    keys = [f"{i % 8 // 2 if c != 99 else i}".encode().ljust(16) for i, c in enumerate(convs)]
    batch = pa.RecordBatch.from_pydict({"conv_id": convs, "src": [1] * len(convs), "key": keys, "words": [2] * len(convs)})

    def total(limit):
        monkeypatch.setattr(trie, "PARTIAL", limit)
        out = defaultdict(lambda: [0, [], None])
        sizes = []
        for b in trie._partial(iter([batch.slice(0, 100), batch.slice(100)])):
            sizes.append(b.num_rows)
            for r in b.to_pylist():
                out[r["node"]][0] += r["n_convs"]
                out[r["node"]][1] += r["ends"]
                out[r["node"]][2] = r["depth"], r["words"], tuple(r["up"])
        return {k: (v[0], sorted(v[1]), v[2]) for k, v in out.items()}, max(sizes)

    whole, _ = total(50_000)
    small, most = total(5)
    assert whole == small and most <= 7


def test_trie_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["op12_conversation_repair", "op13_prefix_trie"])
def test_talks_match_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    got = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(map(str, rel.select(*[f'"{c}"' for c in got.columns]).fetchall())) == sorted(str(tuple(r)) for r in got.collect())
    assert os.path.exists(SF)
