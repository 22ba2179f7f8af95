"""The corpus pipeline, stage by stage, on the smallest tables."""

import numpy as np
import pandas as pd
import pytest

from tests.llm.test_queries import brute_components

SF = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, before = docs.columns, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == names
        a, b = before.toPandas(), now.toPandas()
        if name == "toxicity":
            toxic = pd.read_parquet(f"{SF}/labels.parquet").query("toxic == 1").doc_id
            assert set(b.doc_id) <= set(a.doc_id) and len(b) > 0.9 * len(a) - len(toxic)
        elif name == "line_dedup":
            assert sorted(a.doc_id) == sorted(b.doc_id) and (b.n_chars == b.text.str.len()).all()
        elif name == "jaccard_join":
            want = brute_components(dict(zip(a.doc_id, a.text, strict=True)), 5, 80)
            assert sorted(b.doc_id) == sorted(i for i, (_, c) in want.items() if i == c)
        elif name == "mixing":
            assert set(b.doc_id) == set(a.doc_id) and len(b) >= len(a)
        else:
            assert b.groupby("sequence_id").length.sum().max() <= 2048
            firsts = b[b.start == 0].groupby("doc_id").size()
            assert (firsts == a.groupby("doc_id").size()).all()
            assert b.length.sum() == (b[b.start == 0].doc_tokens).sum()
        before = now


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).toPandas()
    assert len(rows) and np.all(rows.length > 0)


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties and repeated rows, an empty table, and columns of names that stages use themselves."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    texts = ["the quick brown fox jumps over the dog"] * 2 + [None, "", " \t\n ", long, "12 !!", "été à la plage ce matin là bas"]
    rows = [(i if i != 3 else None, t, "en" if i % 3 else None, "a" if i % 2 else None, len(t) if t else None, 0.5, 1, "k", 7) for i, t in enumerate(texts)]
    rows += [rows[0], (0, "another text under the same number as before", "en", "a", 44, 0.1, 2, "j", 8)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, key string, pass int"
    before = spark.createDataFrame(rows, schema)
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        empty = stage(spark, before.limit(0), SF)
        assert empty.count() == 0 and empty.columns == out.columns
        if name != "packing":
            assert out.columns == before.columns
            out = spark.createDataFrame(out.collect(), out.schema)
        counts[name] = out.count()
        before = out
    assert counts["toxicity"] == counts["line_dedup"] == len(rows)
    # the repeated row and its copy leave one; other rows of no words, of no number, or alone stay
    assert counts["jaccard_join"] == len(rows) - 2
