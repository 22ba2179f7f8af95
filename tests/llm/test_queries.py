"""The registered queries on the smallest tables, against brute force or SQL."""

import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from docmill.llm import licenses, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_lm(spark, docs):
    got = queries.op1_lm_scoring(spark, SF).toPandas().set_index("doc_id")
    toks = {i: [*words(t), None] for i, t in zip(docs.doc_id, docs.text, strict=True)}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in train for w in toks[i])
    total, types = sum(c.values()), len(c)
    pairs = Counter(p for i in train for p in zip(["<"] + toks[i], toks[i], strict=False))
    cont = Counter(b for _, b in pairs)

    def discounts(counts):
        k = Counter(counts.values())
        y = k[1] / (k[1] + 2 * k[2])
        return [0, 1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3]]

    d2, d1 = discounts(pairs), discounts(cont)
    floor = sum(d1[min(n, 3)] for n in cont.values()) / len(pairs) / (types + 1)
    left, gamma = Counter(), Counter()
    for (a, _), n in pairs.items():
        left[a] += n
        gamma[a] += d2[min(n, 3)]

    def p(a, b):
        low = max(cont[b] - d1[min(cont[b], 3)], 0) / len(pairs) + floor
        return low if a not in left else (max(pairs[a, b] - d2[min(pairs[a, b], 3)], 0) + gamma[a] * low) / left[a]

    for i in list(toks)[:60]:
        r = got.loc[i]
        assert r.n_tokens == len(toks[i]) and r.n_known == sum(w in c for w in toks[i]) and r.train_tokens == total
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (total + 0.5 * (types + 1))) for w in toks[i]), rel=1e-9)
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["<"] + toks[i], toks[i], strict=False)), rel=1e-5)
    seen = list(c)[:50] + ["never seen"]
    assert sum(p("the", w) for w in c) + p("the", "never seen") == pytest.approx(1) and len(seen) == 51
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path, _ = queries.tokenizer_path()
    got = queries.op2_packing(spark, SF).toPandas()
    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    ids = {i: np.array([*coder.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in zip(docs.doc_id, docs.text, strict=True)}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for i, g in got.groupby("doc_id"):
        g = g.sort_values("start")
        assert list(g.start) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() == len(ids[i])
    sums = []
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
        sums.append(g.length.sum())
    assert max(sums) <= 2048 and sum(sums) / (2048 * len(sums)) > 0.95


def test_media(spark, docs):
    import hashlib

    got = queries.op3_media_columns(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        raw = t.encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got.loc[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))


def test_media_features_by_plain_sums(spark, docs):
    """The hash of the stored picture, from the cosine transform written out as sums."""
    got = queries.op3_media_columns(spark, SF).toPandas().set_index("doc_id").feature
    for i, t in list(zip(docs.doc_id, docs.text, strict=True))[:25]:
        raw = t.encode()
        pad = np.frombuffer(raw + bytes(-len(raw) % 64 or (0 if raw else 64)), np.uint8).reshape(-1, 64)
        h = len(pad)
        cell = np.zeros((32, 32))
        for y in range(32):
            a, b = y * h // 32, (y + 1) * h // 32
            rows = pad[a : max(b, a + 1)]
            for x in range(32):
                cell[y, x] = rows[:, 2 * x : 2 * x + 2].astype(float).mean()
        f = np.zeros((8, 8))
        for u in range(8):
            for v in range(8):
                cu, cv = (math.sqrt((1 if w == 0 else 2) / 32) for w in (u, v))
                f[u, v] = cu * cv * sum(cell[y, x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32))
        flat = f.ravel().round(6)
        bits = [flat[0] > 127.5 * 32, *(flat[1:] > np.median(flat[1:]))]
        assert got[i] == f"{int(''.join('1' if b else '0' for b in bits), 2):016x}"


def test_line_dedup(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    a, b = queries.op4_line_dedup(spark, SF).toPandas(), con.sql(queries.ORACLE_SQL["op4_line_dedup"]).df()
    cols = sorted(a.columns)
    assert a[cols].sort_values("doc_id").reset_index(drop=True).equals(b[cols].sort_values("doc_id").reset_index(drop=True))


def test_language(spark):
    docs = pd.read_parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").toPandas().merge(docs[["doc_id", "lang"]])
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_by_plain_compression(spark, docs):
    """Every document against every dictionary, written out."""
    import zstandard

    from docmill.llm import langid
    from docmill.llm.common import table

    model = langid.learn(table(spark, SF, "documents"), fold=(4, 2))
    got = queries.op5_language_id(spark, SF).toPandas().set_index("doc_id")

    def size(raw, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        p = zstandard.ZstdCompressionParameters.from_level(1, min_match=4, strategy=zstandard.STRATEGY_DFAST, window_log=18, hash_log=15, chain_log=15, write_content_size=False)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(raw))

    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        if len(set(w)) * 2 < len(w):
            w = [x for j, x in enumerate(w) if j == 0 or x != w[j - 1]]
        if not w:
            assert got.lang_pred[i] == "und"
            continue
        rest, parts = f" {' '.join(w)} ", []
        while len(rest) > 16_384:
            cut = rest.rindex(" ", 1, 16_384)
            parts.append(rest[:cut])
            rest = rest[cut:]
        parts.append(rest)
        sizes = {k: sum(size(x.encode() + b" " * 256, c) for x in parts) for k, c in model.contents.items()}
        best = min(sorted(sizes), key=sizes.get)
        assert got.lang_pred[i] == best and got.score[i] == pytest.approx(1 / sum(2.0 ** (-min(60, (n - sizes[best]) / 2)) for n in sizes.values()))


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op6_toxicity(spark, sf).toPandas().merge(pd.read_parquet(f"{sf}/labels.parquet"), how="left")
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out & got.toxic.notna()]
    hit = held[held.predicted == 1]
    assert len(hit) >= 5 and (hit.toxic == 1).mean() > 0.9 and (held.predicted[held.toxic == 1] == 1).mean() > 0.6


def brute_components(texts, k, pct):
    sets = {}
    for i, t in texts.items():
        w = words(t or "")
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    where = {}
    for i in ids:
        near = Counter(o for g in sets[i] for o in where.get(g, ()))
        for o, n in near.items():
            if 100 * n >= pct * (len(sets[i]) + len(sets[o]) - n):
                a, b = find(i), find(o)
                root[max(a, b)] = min(a, b)
        for g in sets[i]:
            where.setdefault(g, []).append(i)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard(spark, docs):
    got = queries.op7_jaccard_join(spark, SF).toPandas()
    want = brute_components(dict(zip(docs.doc_id, docs.text, strict=True)), 3, 90)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == want


def test_licenses(spark, docs):
    got = queries.op8_license_scan(spark, SF).toPandas().set_index("doc_id")
    notes = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert set(got.loc[i].licenses) == {k for k, s in notes.items() if s in t.split("\n")}


_KNOWN: dict = {}


def brute_licences(text):
    """The sentence rules, word by word: a known sentence starts and ends at a line's or sentence's ends and has no sentence's end inside but its own."""
    def words_of(t):
        t = t.lower()
        found = list(re.finditer("[a-z0-9]+", t))
        gaps = [t[: found[0].start()] if found else t, *(t[a.end() : b.start()] for a, b in zip(found, found[1:], strict=False)), t[found[-1].end() :] if found else ""]
        kinds = []
        for k, g in enumerate(gaps):
            prev = found[k - 1][0] if k else ""
            g = g[1:] if prev == "v" and re.match("[.!?:]", g) else g
            kinds.append("E" if re.search(r"[.!?:]\s", g) else "N" if re.search(r"[\n\r\v\f]", g) else " ")
        kinds[0], kinds[-1] = "N", "N"
        return [m[0] for m in found], kinds

    words_in, kinds = words_of(text)
    if not _KNOWN:
        made = [(k, t) for k, ts in licenses.notices().items() for t in ts]
        fixed = {licenses.norm(t) for t in licenses.SENTENCES.values()}
        every = [(k, t) for k, t in made if licenses.norm(t) not in fixed] + list(licenses.SENTENCES.items())
        for w, own, name in sorted(((*words_of(t), k) for k, t in every), key=lambda x: -len(" ".join(x[0]))):
            _KNOWN.setdefault(tuple(w[:3]), []).append((w, own, name))
    ids, at = [], 0
    while at < len(words_in):
        for w, own, name in [x for n in (3, 2, 1) for x in _KNOWN.get(tuple(words_in[at : at + n]), []) if n == 3 or len(x[0]) == n]:
            end = at + len(w)
            if words_in[at:end] == w and kinds[at] != " " and kinds[end] != " " and all(kinds[at + j] != "E" or own[j] == "E" for j in range(1, len(w))):
                ids.append(name)
                at = end
                break
        else:
            at += 1
    left, found = list(ids), []
    for name, seq in sorted([*licenses.RULES, *[(k.removeprefix("notice:"), [k]) for k in licenses.notices()]], key=lambda r: -len(r[1])):
        k = 0
        while k + len(seq) <= len(left):
            if left[k : k + len(seq)] == seq:
                left[k : k + len(seq)] = ["#"]
                found.append(name)
            k += 1
    return ids, list(dict.fromkeys(found))


def test_licenses_word_by_word(spark, docs):
    s = licenses.SENTENCES
    rng = np.random.default_rng(4)
    texts = {int(i): t for i, t in zip(docs.doc_id, docs.text, strict=True)}
    for k in range(150):  # known sentences, wrapped or not, in odd surroundings
        parts = [str(rng.choice(["", "see v. 2", "x:", "Note. ", "* ", "# a line"]))]
        for name in rng.choice(list(s), rng.integers(1, 5)):
            w = s[name].split(" ")
            cut = int(rng.integers(1, len(w) + 1))
            parts += [" ".join(w[:cut]) + str(rng.choice(["\n", " ", "\n * "])) + " ".join(w[cut:]), str(rng.choice(["\n", " ", ". ", " and "]))]
        texts[100_000 + k] = "".join(parts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        assert (r["sentence_ids"], r["licenses"]) == brute_licences(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_embeddings(spark):
    got = queries.op9_embedding_neardup(spark, SF).toPandas().set_index("vec_id").sort_index()
    e = pd.read_parquet(f"{SF}/embeddings.parquet").sort_values("vec_id")
    x = np.stack(e.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    assert ((near.sum(axis=1) - 1) == got.n_links.to_numpy()).all()


def test_mixing(spark, docs):
    got = queries.op10_mixing(spark, SF).toPandas()
    n = got.groupby("doc_id").size()
    assert set(n.index) == set(docs.doc_id) and n.max() <= math.ceil(queries.MAX_REPEATS)
    have = docs.assign(n=[len(WORD.findall(t)) for t in docs.text]).groupby("source").n.sum()
    spent = got.groupby("source").n_tokens.sum()
    ratio = spent / have
    assert ratio.min() >= 1 and ratio.max() <= queries.MAX_REPEATS + 1e-9


def test_mixing_by_sorting(spark, docs):
    """Which rows go once and which twice, from the sorted permutation of every source."""
    from pyspark.sql import functions as F

    src = spark.read.parquet(f"{SF}/documents.parquet")
    d = src.select("doc_id", "source", F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(1 << 52)).alias("u")).toPandas().merge(docs[["doc_id", "text"]])
    d["n"] = [len(WORD.findall(t)) for t in d.text]
    tokens = d.groupby("source").n.sum()

    def repeats(a):
        w = (tokens / tokens.max()) ** a
        w /= w.sum()
        return w * (tokens / w).max() / tokens, np.rint(w * (tokens / w).max()).astype(int)

    lo, hi = 0.0, 1.0
    if repeats(0.0)[0].max() > queries.MAX_REPEATS:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if repeats(mid)[0].max() <= queries.MAX_REPEATS else (mid, hi)
    else:
        hi = 0.0
    want = Counter()
    for s, b in repeats(hi)[1].items():
        left = b
        g = d[d.source == s].sort_values("u")
        while left > 0:
            for r in g.itertuples():
                if r.n > left:
                    left = 0
                    break
                want[r.doc_id] += 1
                left -= r.n
    got = queries.op10_mixing(spark, SF).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"].to_dict()
    off = {k for k in set(want) | set(got) if want[k] != got.get(k, 0)}
    assert not off
