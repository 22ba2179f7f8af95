"""Registered queries of this subpackage, their parameters in production, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import html, jaccard, langid, licenses, linededup, lm, media, mixing, neardup, packing, repair, toxicity, trie
from docmill.llm.common import Work, crc_mod, table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> tuple[str, str]:
    """(file, pre-tokenising pattern) of an installed public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lm.train(docs, fold=(5, 1))
    out = lm.score(docs, model)
    held = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_path()
    work = Work(spark, "op2")
    pieces = work.keep(packing.tokenize_pieces(table(spark, sf_dir, "documents"), path, pattern))
    return packing.pack(pieces).drop("row")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "op3")
    stored = work.keep(media.as_media(table(spark, sf_dir, "documents")), "media")
    return media.media_features(stored).drop("feature_bits")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, fold=(4, 2))
    out = langid.identify(docs, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.drop_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", "text", "n_lines", "n_dropped")


def toxic_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicModel:
    return toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold=(3, 1))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), toxic_model(spark, sf_dir))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, pct=90)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


#: No source's documents are passed over more than so many times.
MAX_REPEATS = 1.5


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS)
    return out.select("doc_id", "source", "pass", "block", "order_key", "n_tokens")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damage(table(spark, sf_dir, "conversations")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("node")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_packing": op2_packing,
    "op3_media_columns": op3_media_columns,
    "op4_line_dedup": op4_line_dedup,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_license_scan": op8_license_scan,
    "op9_embedding_neardup": op9_embedding_neardup,
    "op10_mixing": op10_mixing,
    "op11_html_extraction": op11_html_extraction,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_prefix_trie": op13_prefix_trie,
}

#: All pairs, for comparison only: the queries themselves never pair all rows.
_OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.n >= 90 * (x.n + y.n - o.n)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = d.doc_id"""

_OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT x.vec_id, coalesce(l.n, 0) AS n_links, c.c AS component_id, x.vec_id = c.c AS kept
FROM embeddings x LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY a) l ON l.a = x.vec_id JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = x.vec_id"""


def _crc32(ascii_text: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit: every byte is followed by seven zeros, each element shifts once."""
    bits = f"list_concat([4294967295::BIGINT], flatten(list_transform(string_split({ascii_text}, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])))"
    return f"xor(list_reduce({bits}, lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295::BIGINT)"


_INS = "lambda p: {'c': p.c + 3, 'a': p.a || 'I', 's': CASE WHEN p.s = 2 THEN 3 ELSE 2 END, 'o': p.o || chr(10) || CASE WHEN p.s = 2 THEN 'assistant:' ELSE 'user:' END}"


def _closed(rows: str) -> str:
    """The least way into each state, with up to three insertions behind each of `rows`."""
    once = f"list_transform({rows}, {_INS})"
    twice = f"list_transform({once}, {_INS})"
    ways = f"list_concat({rows}, {once}, {twice}, list_transform({twice}, {_INS}))"
    return f"list_filter(list_transform([0, 1, 2, 3], lambda st: list_min(list_filter({ways}, lambda p: p.s = st))), lambda p: p IS NOT NULL)"


#: The least way into each state is found over whole audit strings here, by recursion over the turns.
_OP12_SQL = rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("conv_id || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM k WHERE k <> 0),
n AS (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again, lag(left(role, 1)) OVER w || left(role, 1) AS step,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
f AS (SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM n),
g AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (step NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM f GROUP BY conv_id),
v AS (SELECT conv_id, 0::BIGINT AS i, {_closed("[{'c': 0, 'a': '', 's': 0, 'o': ''}]")} AS live FROM g
 UNION ALL SELECT conv_id, i, {_closed("ways")} FROM (
  SELECT v.conv_id, f.i, list_filter(list_concat(
    list_transform(v.live, lambda p: {{'c': p.c + 4, 'a': p.a || 'D', 's': p.s, 'o': p.o}}),
    list_transform(v.live, lambda p: CASE WHEN f.fault NOT IN ('b', 'd') AND (CASE p.s WHEN 0 THEN left(f.role, 1) IN ('s', 'u') WHEN 2 THEN left(f.role, 1) = 'a' ELSE left(f.role, 1) = 'u' END)
      THEN {{'c': p.c + CASE f.fault WHEN 't' THEN 3 ELSE 0 END, 'a': p.a || 'K', 's': CASE left(f.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'o': p.o || chr(10) || f.role || ':' || f.text}} END),
    list_transform(v.live, lambda p: CASE WHEN f.fault NOT IN ('b', 'd') THEN {{'c': p.c + 3 + CASE f.fault WHEN 't' THEN 3 ELSE 0 END, 'a': p.a || 'R', 's': CASE WHEN p.s = 2 THEN 3 ELSE 2 END,
      'o': p.o || chr(10) || CASE WHEN p.s = 2 THEN 'assistant:' ELSE 'user:' END || f.text}} END)), lambda p: p IS NOT NULL) AS ways
  FROM v JOIN f ON f.conv_id = v.conv_id AND f.i = v.i + 1) AS step),
e AS (SELECT v.conv_id, list_min(list_filter(v.live, lambda p: p.s IN (0, 3))) AS p FROM v JOIN g ON g.conv_id = v.conv_id AND v.i = g.rows)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(p.c, 0)::BIGINT AS cost, coalesce(p.a, '') AS audit, sha256(coalesce(substr(p.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g ON g.conv_id = c.conv_id LEFT JOIN e ON e.conv_id = c.conv_id"""

_OP13_SQL = rf"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT conv_id, sha256(length(role) || ':' || role || text) AS x, len(regexp_extract_all(text, '[^ 	-
]+')) AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS i FROM o),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS b, {_crc32("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS src, i, x, w FROM c JOIN t ON t.conv_id = c.b AND t.i <= c.h UNION ALL SELECT c.conv_id, 1, i, x, w FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
p AS (SELECT c.conv_id, coalesce(xs, []) AS xs, coalesce(ws, []) AS ws FROM c LEFT JOIN (SELECT conv_id, list(x ORDER BY src, i) AS xs, list(w ORDER BY src, i) AS ws FROM r GROUP BY conv_id) q ON q.conv_id = c.conv_id),
m AS (SELECT conv_id, xs, ws, unnest(range(0, len(xs) + 1)) AS d FROM p),
n AS (SELECT array_to_string(xs[1:d], ',') AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(ws[d]), 0) AS w, any_value(CASE WHEN d > 0 THEN array_to_string(xs[1:d - 1], ',') END) AS parent,
  coalesce(string_agg(CASE WHEN len(xs) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM m GROUP BY node, d),
k AS (SELECT parent, count(*) AS n FROM n WHERE d > 0 GROUP BY parent),
s AS (SELECT a.node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((b.n_convs - 1) * b.w) AS saved FROM n a JOIN n b ON starts_with(b.node, a.node) LEFT JOIN k ON k.parent = b.node GROUP BY a.node)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN s ON s.node = n.node LEFT JOIN k ON k.parent = n.node LEFT JOIN n u ON u.node = n.parent"""

ORACLE_SQL: dict[str, str] = {"op4_line_dedup": linededup.oracle(), "op7_jaccard_join": _OP7_SQL, "op9_embedding_neardup": _OP9_SQL, "op12_conversation_repair": _OP12_SQL, "op13_prefix_trie": _OP13_SQL}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
