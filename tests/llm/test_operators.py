"""Operators on small cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, large groups."""

import random
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.llm import jaccard, langid, licenses, linededup, lm, media, mixing, neardup, packing, queries, toxicity
from docmill.llm.common import Work, components, join_classes, word_hashes
from tests.llm.test_queries import brute_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, n long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, la, s, len(t) if t else None, 0.5, 1, 1) for i, t, la, s in rows], SCHEMA)


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, columns of names that operators use themselves."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "the quick brown fox", "en", "a"), (1, "the quick brown fox", "en", "a"), (2, None, None, None), (3, "", "de", "a"), (4, " \t\n ", "fr", "b"), (5, long, "en", "b"), (None, "no id here", "en", "a"), (6, "12 34 !!", None, "c"), (7, "été à la plage", "fr", None)]
    return docs_of(spark, rows)


def test_odd_rows(spark, odd):
    path, pattern = queries.tokenizer_path()
    empty = odd.limit(0)
    assert lm.score(odd, lm.train(odd)).count() == 9
    assert lm.score(empty, lm.train(empty)).count() == 0
    p = packing.pack(packing.tokenize_pieces(odd, path, pattern)).toPandas()
    assert sorted(p[p.start == 0].doc_id.dropna()) == [1, 1, 2, 3, 4, 5, 6, 7] and p.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(packing.tokenize_pieces(empty, path, pattern)).count() == 0
    m = media.media_features(media.as_media(odd)).toPandas().set_index("doc_id")
    assert len(m) == 9 and m.loc[2].payload_bytes == 64 and m.loc[3].payload_sha256 == m.loc[2].payload_sha256
    x = linededup.drop_boilerplate(odd)
    assert x.count() == 9 and x.where("doc_id = 2").first()["text"] is None and linededup.drop_boilerplate(empty).count() == 0
    la = {r["doc_id"]: r for r in langid.identify(odd, langid.learn(odd)).collect()}
    assert la[2]["lang_pred"] == la[3]["lang_pred"] == la[6]["lang_pred"] == "und" and la[7]["lang_pred"] != "und"
    assert langid.identify(odd, langid.learn(empty)).where("lang_pred = 'und'").count() == 9
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    t = toxicity.score(odd, toxicity.learn(odd, labels, fold=None), keep=True)
    assert t.count() == 9 and t.where("score between 0 and 1").count() == 9 and set(odd.columns) <= set(t.columns)
    assert toxicity.score(empty, toxicity.learn(empty, labels.limit(0))).count() == 0
    j = jaccard.jaccard_components(odd, 3, 90).toPandas()
    assert len(j) == 9 and j[j.doc_id == 2].component_id.iloc[0] == 2 and j[j.doc_id.isna()].component_id.isna().all()
    assert jaccard.jaccard_components(empty, 3, 90).count() == 0
    assert licenses.scan(odd).count() == 9 and licenses.scan(empty).count() == 0
    mx = mixing.mix(odd, max_repeats=1.5)
    assert mx.count() >= 9 and mx.select("doc_id").distinct().count() == 8 and mixing.mix(empty, max_repeats=1.5).count() == 0


def test_hot_contexts_change_no_score(spark, monkeypatch):
    """Scores with the followers of common contexts dealt to all shards, against scores with none dealt; one very long text among short ones."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words if rng.random() < 0.6 else words[:3]) for _ in range(n))
    df = docs_of(spark, [(i, text(rng.randrange(1, 40)), "en", "a") for i in range(400)] + [(900, text(300_000), "en", "a")]).repartition(3)
    scores = lambda m: {r["doc_id"]: r["score"] for r in lm.score(df, m).collect()}
    dealt = lm.train(df)
    hot = lm.Scorer(dealt).hot
    monkeypatch.setattr(lm, "MOST_HOT", 1)
    plain = lm.train(df)
    assert len(hot) >= 3 and not len(lm.Scorer(plain).hot)
    a, b = scores(dealt), scores(plain)
    assert a.keys() == b.keys() and all(a[i] == pytest.approx(b[i], rel=1e-6) for i in a)


def test_ids_of_odd_texts():
    path, pattern = queries.tokenizer_path()
    ids = packing.Ids(path, pattern, most=50)
    assert ids.first is not None
    rng = random.Random(5)
    alphabet = ["a", "B", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", " ", "　", "\x1c", "\x85", "é", "中", "🙂", "12", ".", "!!", "_", "<|endoftext|>", "\r\n", "ﬁ", "é"]
    for _ in range(400):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))
        assert ids.encode(t) == np.array(ids.slow.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), repr(t)


def test_differencing():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 700):
        sizes = rng.integers(1, 513, n)
        w = packing.windows(sizes, 2048)
        assert sorted(i for s in w for i in s) == list(range(n)) and max(sizes[s].sum() for s in w) <= 2048
    sums = [sum([8, 7, 6, 5, 4][i] for i in s) for s in packing.difference(np.array([8, 7, 6, 5, 4]), 2)]
    assert sorted(sums) == [14, 16]


def test_png_filters_and_damage():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (40, 64), dtype=np.uint8)
    png = media.encode_png(x)
    assert (media.decode_png(png) == x).all()
    smooth = np.cumsum(rng.integers(0, 3, (40, 64), dtype=np.uint8), axis=0, dtype=np.uint8)
    assert (media.decode_png(media.encode_png(smooth)) == smooth).all()
    for k in range(5):  # rows of every filter kind, made by hand
        rows = np.zeros((40, 65), np.uint8)
        rows[:, 0] = [(k + y) % 5 for y in range(40)]
        for y in range(40):
            up = x[y - 1].astype(int) if y else np.zeros(64, int)
            left = np.concatenate(([0], x[y, :-1])).astype(int)
            corner = np.concatenate(([0], up[:-1]))
            p = left + up - corner
            pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
            paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
            rows[y, 1:] = (x[y] - [np.zeros(64, int), left, up, (left + up) // 2, paeth][rows[y, 0]]) % 256
        whole = media.SIGNATURE + png[8:33] + media._chunk(b"IDAT", zlib.compress(rows.tobytes())) + media._chunk(b"IEND", b"")
        assert (media.decode_png(whole) == x).all()
    for at in (0, 20, len(png) // 2, len(png) - 5):
        bad = bytearray(png)
        bad[at] ^= 255
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    assert (media.cosine_hash(np.stack([media.shrink(x)])) == media.cosine_hash(np.stack([media.shrink(x)]))).all()


def test_word_hashes_ignore_only_the_named_white_space():
    h, b = word_hashes(["Ab c\td", None, "AB C D"])
    assert list(np.diff(b)) == [2, 0, 2] and h[0] != h[1]
    assert h[0] == word_hashes(["aB c"])[0][0]


def near_copies(n, length, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "pct"), [(3, 90), (5, 80)])
def test_jaccard_chains_and_large_groups(spark, k, pct, monkeypatch):
    """Large groups of near copies, of which many reach each other only by others, and chance neighbours of one hot passage."""
    monkeypatch.setattr(jaccard, "SMALL", 6)
    monkeypatch.setattr(jaccard, "BLOCK", 20)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(jaccard, "HOT", 5)
    texts = near_copies(70, 120, 8, 1) + near_copies(30, 60, 5, 2) + near_copies(20, 300, 12, 3)
    rng = random.Random(4)
    hot = " ".join(f"h{i}" for i in range(25))
    texts += [f"{hot} " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 12))) for _ in range(60)]
    texts += ["", "one", "one", "One", "one two", "three four"] + texts[:3]
    rows = {i * 3 + 1: t for i, t in enumerate(texts)}
    df = spark.createDataFrame([(i, t) for i, t in rows.items()], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, k, pct).collect()}
    assert got == brute_components(rows, k, pct)


def test_jaccard_of_repeated_ids(spark):
    rng = random.Random(8)
    a, b = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join(w[:59] + ["other"])
    rows = [(7, " ".join(a)), (7, " ".join(b)), (2, near(a)), (3, near(b)), (9, "x y z"), (9, "x y z"), (9, None), (5, None), (5, None), (None, " ".join(a)), (4, "x  y\tz")]
    df = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, n long, row long, key string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(df, 3, 90).collect()), key=str)
    assert got == sorted([(7, 2), (7, 2), (2, 2), (3, 2), (9, 4), (9, 4), (9, 4), (5, 5), (5, 5), (None, None), (4, 4)], key=str)


def test_signatures_that_say_nothing():
    sig = np.zeros((4, jaccard.SIG), np.int32)
    sig[2:, 0] = 100, 10
    to = jaccard.near_members(sig, np.array([100, 95, 100, 10]), np.arange(4), np.full(4, 2), 90)
    assert to[0] == to[1] == to[2] != to[3]


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 50)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(Work(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert all(got[n] == find(n) for e in edges for n in e if e[0] != e[1])


def test_line_dedup_both_ways(spark, monkeypatch):
    rows = [(i, f"header\nbody {i}\n  footer  \nfooter", "en", "a" if i % 2 else "b") for i in range(40)] + [(90, None, "en", "a"), (91, "", "en", "a"), (92, "header", "en", None), (93, "header", "en", "a")]
    rows += [(94, "\theader\r\nbody\r\nfooter\r\n", "en", "a")]
    df = docs_of(spark, rows)
    one = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.drop_boilerplate(df, ratio=0.2).collect()}
    assert one[94] == ("body\r\n", 4, 2)
    assert one[0] == ("body 0", 4, 3) and one[90] == (None, 0, 0) and one[91] == ("", 1, 0) and one[92] == ("header", 1, 0) and one[93] == ("", 1, 1)
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    assert one == {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in linededup.drop_boilerplate(df, ratio=0.2).collect()}


def test_plan():
    totals = {"hot": 1000, "a": 100, "b": 50}
    p = mixing.plan(totals, max_repeats=2.0)
    r = p.budgets / p.tokens
    assert r.min() == pytest.approx(1) and r.max() == pytest.approx(2, rel=1e-2) and 0 < p.exponent < 1
    q = mixing.plan(totals, target_entropy=0.8, budget=500)
    assert mixing.entropy(q.weights) == pytest.approx(0.8, abs=1e-6) and q.budgets.sum() == pytest.approx(500, abs=2)
    assert mixing.plan({"a": 5, "b": 5}, max_repeats=1.5).exponent == 0
    assert mixing.plan({}, max_repeats=1.5).sources == [] and mixing.plan({"a": 0}, max_repeats=1.5).weights.sum() == 0


def test_mixing_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", "hot" if i % 10 else "small") for i in range(600)]
    df = docs_of(spark, rows)
    out = mixing.mix(df, target_entropy=0.5, budget=900).toPandas()
    p = mixing.plan({r["source"]: r["n"] for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()}, target_entropy=0.5, budget=900)
    for s, b in zip(p.sources, p.budgets, strict=True):
        assert b - 7 <= out[out.source == s].n_tokens.sum() <= b
    again = mixing.mix(df.repartition(5), target_entropy=0.5, budget=900).toPandas()
    assert sorted(zip(out.doc_id, out["pass"], out.order_key, strict=True)) == sorted(zip(again.doc_id, again["pass"], again.order_key, strict=True))


def test_licence_texts(spark):
    s = licenses.SENTENCES
    mit = "\n".join([s["mit-grant"], "by the way.", s["mit-keep"], s["mit-asis"].lower()])
    rows = [(1, mit, "en", "a"), (2, f"{s['bsd-grant']}\n{s['bsd-source']}\n{s['bsd-binary']}", "en", "a"), (3, s["mit-asis"], "en", "a"), (4, f"x. {s['gpl3-notice']} {s['apache-notice']}", "en", "a")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert got == {1: ["MIT"], 2: ["BSD-2-Clause"], 3: [], 4: ["Apache-2.0", "GPL-3.0"]}


def test_wrapped_licences(spark):
    s = licenses.SENTENCES
    apache = [f"Copyright 2020 A. Body\n{s['apache-notice-long']} You may obtain a copy of the License at", "http://www.apache.org/licenses/LICENSE-2.0", f"{s['apache-asis']} {s['apache-see']}"]
    bsd = [f"Copyright (c) 2020, A. Body\n{s['reserved']}", s["bsd-grant"], f"1. {s['bsd-source']}", f"2. {s['bsd-binary']}", f"3. {s['bsd-endorse']}"]
    texts = {"Apache-2.0": apache, "MIT": ["MIT License", s["mit-grant"], s["mit-keep"], s["mit-asis"] + " IN NO EVENT"], "BSD-3-Clause": bsd, "ISC": [f"Copyright 2020 A. Body\n{s['isc-grant']}"], "GPL-2.0-or-later": [s["gpl2-redistribute"], s["gpl-hope"] + " See the licence."]}
    rows, want = [], {}
    for name, paragraphs in texts.items():
        for width in (40, 72, 80, 10_000):
            for mark, end in (("", "\n"), (" * ", "\n"), ("# ", "\r\n"), ("// ", "\n")):
                lines = [x for p in paragraphs for part in p.split("\n") for x in [*textwrap.wrap(part, width, break_long_words=False), *[""] * (part == p.split("\n")[-1])]]
                want[len(rows)] = [name]
                rows.append((len(rows), end.join(mark + x for x in lines), "en", "a"))
    # a line of its own between lines that end nowhere, and words of a sentence that begin within a line
    want |= {900: ["MIT"], 901: [], 902: []}
    rows += [(900, f"first words\n{s['mit-notice']}\nlast words", "en", "a"), (901, "it is not released under\nthe MIT License.", "en", "a"), (902, "Released under the. MIT License.", "en", "a")]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, rows)).collect()}
    assert {i: r["licenses"] for i, r in got.items()} == want
    assert got[900]["n_sentences"] == 2 and {got[i]["n_sentences"] for i in range(16, 32)} == {5}


def test_every_licence_sentence_and_rule(spark):
    s = {k: f"{a} the University of Somewhere {b}" for k, (a, b) in licenses.NAMED.items()} | licenses.SENTENCES
    rows = [(i, x, "en", "a") for i, x in enumerate(s.values())]
    rows += [(100 + i, "\n".join(textwrap.wrap(x, 50)), "en", "a") for i, x in enumerate(s.values())]
    rows += [(200 + i, "\n".join(s[k] for k in seq), "en", "a") for i, (_, seq) in enumerate(licenses.RULES)]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, rows)).collect()}
    for i, k in enumerate(s):
        assert got[i]["sentence_ids"] == got[100 + i]["sentence_ids"] == [k]
    for i, (name, seq) in enumerate(licenses.RULES):
        assert got[200 + i]["sentence_ids"] == seq and got[200 + i]["licenses"] == [name]


def invented(rng, letters, n):
    """Text of n words of a made-up language."""
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(700)]
    return lambda: " ".join(rng.choice(words) for _ in range(n))


def test_long_texts_count_whole():
    rng = random.Random(3)
    speak = {"a": invented(rng, "abcdefghij", 2_000), "b": invented(rng, "efghijklmn", 2_000)}
    model = langid.LangModel({k: f().encode() for k, f in speak.items()})
    long = {k: " ".join(f() for _ in range(140)) for k, f in speak.items()}
    texts = [long["a"][:300_000] + " " + long["b"], long["b"][:300_000] + " " + long["a"], long["a"], long["b"]]
    assert [(lang, rejected) for lang, _, rejected in langid.classify(texts, model)] == [("b", False), ("a", False), ("a", False), ("b", False)]
    assert all("".join(langid.slices(t, 50)) == t and max(map(len, langid.slices(t, 50))) <= 50 for t in ["", " ", "x" * 120, " a bc" * 90])


def test_rare_language_leaves_the_others_whole(spark):
    rng = random.Random(4)
    speak = {k: invented(rng, letters, 150) for k, letters in (("a", "abcdefghij"), ("b", "efghijklmn"), ("c", "ijklmnopqr"), ("d", "mnopqrstuv"))}
    # c has few documents, of which only beginnings were read; d has less text than a dictionary holds
    rows = [(i, speak["ab"[i % 2]](), "ab"[i % 2], "s") for i in range(600)]
    rows += [(700 + i, " ".join(speak["c"]() for _ in range(30)), "c", "s") for i in range(5)] + [(800, " ".join(speak["d"]() for _ in range(4)), "d", "s")] + [(900 + i, "abc def", "e", "s") for i in range(300)]
    model = langid.learn(docs_of(spark, rows), fold=None)
    assert {len(x) for x in model.contents.values()} == {65_536}
    assert all(len(set(model.contents[k].split())) > 600 for k in "abc") and model.contents["d"].count(rows[605][1].encode()) > 12
    assert [lang for lang, _, _ in langid.classify([f() for f in speak.values()] * 20, model)] == list("abcd") * 20


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "LISTED", 8)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 24))
    near = base[0] + 0.05 * rng.normal(size=(60, 24))
    x = np.concatenate((base, near, near[:5], 3 * base[:3]))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(500, None), (501, [0.0] * 24), (502, [float("nan")] * 24), (503, [None, 1.0]), (504, [float("inf")] + [1.0] * 23), (505, []), (None, base[0].tolist()), (506, [1.0, 2.0])]
    got = {r["vec_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert [got[i]["n_links"] for i in range(len(x))] == want.tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(500, 507))
    assert got[None]["component_id"] is None and not got[None]["kept"]
    assert got[len(base)]["component_id"] == 0
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_vectors_of_repeated_ids_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(4, 16))
    near = lambda i: (base[i] + 0.02 * rng.normal(size=16)).tolist()
    # id 7 has two vectors, one near 2's and one near 3's; 9 has one vector twice; 4 is alone
    rows = [(7, near(0)), (7, near(1)), (2, near(0)), (3, near(1)), (9, base[2].tolist()), (9, base[2].tolist()), (4, base[3].tolist())]
    df = spark.createDataFrame([(i, v, 1, 2, 3, "x", True) for i, v in rows], "vec_id long, embedding array<double>, rep long, size int, k1 int, id string, kept boolean")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert got == [(2, 1, 2, True), (3, 1, 2, False), (4, 0, 4, True), (7, 1, 2, False), (7, 1, 2, False), (9, 1, 9, True), (9, 1, 9, True)]


def test_hot_classes(spark):
    rows = spark.range(4000).select(F.when(F.col("id") < 2500, 0).otherwise(F.col("id")).alias("k"), "id")
    classes = rows.groupBy("k").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    got = join_classes(rows, classes, ["k"], 4000)
    assert got.count() == 4000 and got.where("k = 0 and least = 0 and size = 2500").count() == 2500


@pytest.mark.parametrize(("dim", "pairs"), [(64, 1500), (384, 300), (768, 150)])
def test_recall_at_the_threshold(dim, pairs):
    x, y = neardup.at_cosine(pairs, dim, 0.9, seed=3)
    met = neardup.meetings(x, y, neardup.tables_for(dim, 0.9)).any(axis=1)
    assert met.mean() >= 0.97


def test_pairs_at_the_threshold_meet(spark):
    x, y = neardup.at_cosine(400, 64, 0.9005, seed=11)
    rows = [(2 * i + j, v.tolist()) for i, pair in enumerate(zip(x, y, strict=True)) for j, v in enumerate(pair)]
    rows += [(5000 + j, v[0].tolist()) for j, v in enumerate(neardup.at_cosine(1, 20, 0.97))]
    got = {r["vec_id"]: r["n_links"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(got[2 * i] for i in range(400)) >= 392 and got[5000] == got[5001] == 1
    assert neardup.tables_for(64, 0.9) < neardup.tables_for(256, 0.9)


def test_label_model_and_classifier():
    rng = np.random.default_rng(2)
    y = (rng.random(4000) < 0.1).astype(int)
    rate = np.array([[0.5, 0.01], [0.4, 0.02], [0.3, 0.005], [0.1, 0.1]])
    v = (rng.random((4000, 4)) < np.where(y[:, None] == 1, rate[:, 0], rate[:, 1])).astype(np.uint8)
    v = np.hstack([v, v[:, :1]])  # a copy of the first voter
    q, p1, p0, share = toxicity.label_model(v, 0.1)
    assert share[0] == share[4] == 0.5 and share[1] == 1 and p1[0] > 10 * p0[0] and p1[3] < 5 * p0[3]
    assert abs(p1[0] - 0.5) < 0.15 and abs(p1[1] - 0.4) < 0.15 and q[y == 1].mean() > 0.6 > 0.08 > q[y == 0].mean()
    w, b = toxicity.fit_linear(v, q)
    assert w[0] > 0.5 and abs(w[3]) < w[1]
    z = v @ w + b
    cut = toxicity.calibrate(z, y)
    got = np.array([cut.score(t) for t in z])
    assert ((got >= 0.7) == (y == 1)).mean() > 0.95 and ((got - y) ** 2).mean() < 0.05 and cut.score(cut.at) == pytest.approx(0.7)


def test_toxicity_of_several_languages(spark):
    """Fixed lexicons and patterns speak for languages of which no label is known; long texts count to their end."""
    rng = random.Random(9)
    say = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    calm = {"en": "the a house road of in river".split(), "de": "der die haus straße von fluss".split(), "es": "la el casa camino de río".split()}
    bad = {"en": ["idiot", "scum", "moron"], "de": ["vollidiot", "abschaum"], "es": ["basura", "gilipollas"]}
    rows, labels = [], []
    for i in range(900):
        la = ("en", "de", "es")[i % 3]
        toxic = i % 9 < 3 and i % 2 == 0
        words = say(calm[la], 30).split() + (rng.sample(bad[la], 2) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words) + f" n{i}", la, "s"))
        labels += [(i, int(toxic))] if la == "en" else []
    rows += [(1000, say(calm["en"], 200_000) + " you are an idiot and scum", "en", "s"), (1001, say(calm["en"], 200_000), "en", "s"), (1002, None, None, None), (1003, "", "en", "s")] + [rows[0]] * 2
    df = docs_of(spark, rows)
    model = toxicity.learn(df, spark.createDataFrame(labels, "doc_id long, toxic int"), fold=(3, 1))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(df, model).collect()}
    want = {i: int(i % 9 < 3 and i % 2 == 0) for i in range(900)} | {1000: 1, 1001: 0, 1002: 0, 1003: 0}
    hit = [i for i in want if got[i] == 1]
    assert sum(want[i] for i in hit) / len(hit) > 0.97 and sum(got[i] for i in want if want[i]) / sum(want.values()) > 0.9
    assert got[1000] == 1 and got[1001] == got[1002] == got[1003] == 0


def test_number_signs_are_no_letters(spark):
    assert langid.plain("½ ② ³ 12 _ x²y Ⅷ") .split() == ["x", "y"] and not langid.plain("½ ② ³").strip()


def test_few_maps_give_the_same_scores(spark, monkeypatch):
    """A scorer that may hold one shard's file at a time says the same as one that holds all."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17} v{(i + j) % 13}" for j in range(40))) for i in range(60)], "doc_id long, text string")
    monkeypatch.setattr(lm, "SHARD_BYTES", 500)
    model = lm.train(docs, fold=None)
    texts = [r["text"] for r in docs.collect()]
    whole = lm.Scorer(model).score(texts)
    monkeypatch.setattr(lm, "MOST_MAPS", 1)
    few = lm.Scorer(model)
    assert all(np.array_equal(a, b) for a, b in zip(whole, few.score(texts), strict=True)) and len(few.held) == 1


@pytest.mark.parametrize("hashes", [2, 4])
def test_recall_with_other_hashes(hashes):
    x, y = neardup.at_cosine(400, 64, 0.9)
    assert neardup.meetings(x, y, neardup.tables_for(64, 0.9, hashes), hashes).any(axis=1).mean() >= 0.97
    assert neardup.hashes_for(10**3, 64, 0.9) <= neardup.hashes_for(10**9, 64, 0.9) <= 6


def test_generated_notices_and_named_clauses(spark):
    """Every generated notice is found as its licence; a clause that names a holder makes three clauses of two; longer names win."""
    made = [(k.removeprefix("notice:"), t) for k, ts in licenses.notices().items() for t in ts]
    assert len(made) > 10_000 and len({k for k, _ in made}) == 49
    b = licenses.SENTENCES
    two = "\n".join(b[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))
    texts = {
        "BSD-3-Clause": two + "\nNeither the name of the University of California nor the names of its contributors may be used to endorse or promote products derived from this software\n without specific prior written permission.",
        "BSD-2-Clause": two + "\nNeither the name nor the fame is meant.",
        "GPL-3.0-or-later": "This program is released under the GPLv3 or later.", "LGPL-2.1": "# SPDX-License-Identifier: LGPL-2.1-only", "CC-BY-SA-4.0": "This work is licensed under a\n  Creative Commons Attribution-ShareAlike 4.0 International License.",
        "MIT": "This project is licensed under the MIT License.", "EPL-2.0": "// SPDX-License-Identifier: EPL-2.0\nint x;",
    }
    rows = [(i, f"Some words. {t}", "en", "a") for i, (_, t) in enumerate(made)] + [(100_000 + i, t, "en", "a") for i, t in enumerate(texts.values())] + [(200_000, "It was released under the MIT License of old", "en", "a")]
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs_of(spark, rows)).collect()}
    names = {licenses.norm(t): name for k, t in b.items() for name, seq in licenses.RULES if seq == [k]}
    wrong = [(t, k, got[i]) for i, (k, t) in enumerate(made) if got[i] != [names.get(licenses.norm(t), k)]]
    assert not wrong, wrong[:5]
    assert [got[100_000 + i] for i in range(len(texts))] == [[k] for k in texts] and got[200_000] == []


@pytest.mark.parametrize("how", [{"max_repeats": 1.5}, {"target_entropy": 1.2}, {"max_repeats": 2.0, "budget": 900}])
def test_many_sources_are_mixed_alike(spark, monkeypatch, how):
    """Totals that stay a table give the same rows as totals on the driver."""
    rows = [(i, "w " * (1 + i % 7), "en", f"s{min(i % 9, 4)}") for i in range(120)] + [(500, None, "en", "empty"), (501, "x", "en", None)]
    df = docs_of(spark, rows).repartition(3)
    few = sorted((r["doc_id"], r["pass"], r["block"], r["order_key"]) for r in mixing.mix(df, **how).collect())
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    assert sorted((r["doc_id"], r["pass"], r["block"], r["order_key"]) for r in mixing.mix(df, **how).collect()) == few


def test_toxicity_scores_restated(spark):
    """Scores of all rows, from the model's numbers, by plain search of each feature in the whole text."""
    import re

    sf = "/root/testdata/sf0.001"
    model = queries.toxic_model(spark, sf)
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    got = {r["doc_id"]: r for r in queries.op6_toxicity(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        words = set(re.findall(r"\w+", t.lower()))
        has = lambda f: bool(re.search(toxicity.PATTERNS[f], t)) if f in toxicity.PATTERNS else any(len(w) > len(f) - 1 and w.startswith(f[:-1]) for w in words) if f.endswith("*") else f in words  # noqa: B023, E731
        z = model.bias + sum(w for f, w in model.weights.items() if has(f)) - model.cut.at
        odds = np.log(0.7 / 0.3) + z * (model.cut.below if z < 0 else model.cut.above)
        want = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        assert abs(got[i]["score"] - want) < 1e-9 and got[i]["predicted"] == (want >= 0.7) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
