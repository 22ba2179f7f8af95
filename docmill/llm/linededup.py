"""Line dedup by site-relative frequency: lines on too large a share of a host's pages are boilerplate. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import Work

#: Boilerplate lines (16 bytes each) up to which the lists by host are broadcast; beyond, hosts are joined in salted parts.
BROADCAST_LINES = 500_000
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _key(line: Column) -> Column:
    """A line's identity: two independent hashes of the line without outer blanks, tabs and carriage returns, 96 bits."""
    t = _bare(line)
    return F.struct(F.xxhash64(t).alias("a"), F.hash(t).alias("b"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """(host, k): keys of lines that stand on at least min_pages pages and on more than `ratio` of all pages of their host.

    A line counts once a page; blank lines never count; pages with a null text count as pages; pages of a null host are left out.
    At most (mean lines a page) / ratio lines a host can pass.
    """
    pages = docs.select(F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("t")).where("host is not null")
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), lambda x: _bare(x) != ""), _key))
    seen = pages.select("host", F.explode(keys).alias("k")).groupBy("host", "k").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    return seen.join(totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("total")).select("host", "k")


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 5, work: Work | None = None) -> DataFrame:
    """All rows and columns of `docs`, with boilerplate lines taken out of the text, and `n_lines`, `n_dropped` (replaced if there).

    Null texts stay null with 0 lines; rows without a host, empty texts and repeated rows keep their place; a text all of
    boilerplate becomes empty. Nothing but keys of lines is shuffled while the lists fit a broadcast.
    """
    work = work or Work(docs.sparkSession, "lines")
    found = work.keep(boilerplate(docs, host_col, text_col, ratio, min_pages))
    lists = found.groupBy("host").agg(F.collect_set("k").alias("_drop")).select(F.col("host").alias("_host"), "_drop")
    n = found.count()
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    src = docs.withColumn("_h", F.col(host_col).cast("string"))
    if n <= BROADCAST_LINES:
        both = src.join(F.broadcast(lists), F.col("_h") == F.col("_host"), "left")
    else:
        salted = lists.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        src = src.withColumn("_s", F.pmod(F.xxhash64(text_col), F.lit(SALTS)).cast("int"))
        both = src.join(salted, (F.col("_h") == F.col("_host")) & (F.col("_s") == F.col("_salt")), "left")
    text = F.col(text_col).cast("string")
    kept = F.when(F.col("_drop").isNull(), _lines(text)).otherwise(F.filter(_lines(text), lambda x: ~F.array_contains(F.col("_drop"), _key(x)) | (_bare(x) == "")))
    both = both.withColumn("_kept", kept).withColumn("n_lines", F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long"))
    both = both.withColumn("n_lines", F.when(text.isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))
    both = both.withColumn("n_dropped", F.when(text.isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size("_kept")).cast("long"))
    return both.withColumn(text_col, F.when(F.col("n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(text)).select(*names, "n_lines", "n_dropped")


def oracle(ratio: float = 0.05, min_pages: int = 5) -> str:
    return f"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
seen AS (SELECT source, line, count(*) AS pages FROM (
  SELECT source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line
  FROM pages WHERE source IS NOT NULL) GROUP BY source, line),
totals AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
boiler AS (SELECT s.source, list(s.line) AS lines FROM seen s JOIN totals t ON s.source = t.source
  WHERE s.pages >= {min_pages} AND s.pages > {ratio} * t.total GROUP BY s.source),
cut AS (SELECT p.doc_id, p.source, p.text, p.ls,
  CASE WHEN b.lines IS NULL THEN p.ls ELSE list_filter(p.ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR NOT list_contains(b.lines, trim(x, ' ' || chr(9) || chr(13)))) END AS kept
  FROM pages p LEFT JOIN boiler b ON p.source = b.source)
SELECT doc_id, source,
  CASE WHEN len(kept) < len(ls) THEN array_to_string(kept, chr(10)) ELSE text END AS text,
  CAST(coalesce(len(ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ls) - len(kept), 0) AS BIGINT) AS n_dropped
FROM cut"""
