"""Names inside texts: all names at once by one automaton, instead of a comparison a name."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of names that one automaton holds (some 100 bytes each in a worker).
SHARD_CHARS = 4_000_000
#: Characters of texts that one task matches.
BLOCK_CHARS = 64_000_000
#: Parts in which the pairs of a name are made.
SPREAD = 16


def contained_names(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_id: str, name_col: str) -> DataFrame:
    """(id, name_id): which names each text holds, in any case; a name of several spellings or a text of repeated ids gives each pair once.

    A text is read once a shard of names; shards and blocks of texts follow the counted characters, one shard as a rule. Null and empty names are in
    nothing. Texts meet distinct names, whose ids are joined to what was found, so a task holds no pair of copies. Each task builds the automaton of its shard, so no names come to the driver; matches of a text are told apart before they leave it.
    """
    t = texts.select(F.col(id_col).alias("id"), F.lower(F.col(text_col)).alias("text")).where("text is not null")
    n = names.select(F.col(name_id).alias("name_id"), F.lower(F.col(name_col)).alias("name")).where("name <> ''").distinct()
    words = n.select("name").distinct()
    chars = lambda df, c: df.agg(F.sum(F.length(c))).first()[0] or 0
    shards, blocks = max(1, -(-chars(words, "name") // SHARD_CHARS)), max(1, -(-chars(t, "text") // BLOCK_CHARS), texts.sparkSession.sparkContext.defaultParallelism)
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = t.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int").alias("a"), every(shards).alias("b"))
    right = words.select("name", F.pmod(F.xxhash64("name"), F.lit(shards)).cast("int").alias("b"), every(blocks).alias("a"))
    kind = t.schema["id"].dataType.simpleString()

    def find(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(x) and len(y):
            known = ahocorasick.Automaton()
            for name in y["name"]:
                known.add_word(name, name)
            known.make_automaton()
            for i, text in zip(x["id"], x["text"], strict=True):
                out.extend((i, name) for name in {name for _, name in known.iter(text)})
        return pd.DataFrame(out, columns=["id", "name"])

    got = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(find, f"id {kind}, name string").distinct()
    # a name that many copies share meets many texts, so its pairs are made in SPREAD parts, in as many tasks as a shuffle has
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = got.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")).repartition(tasks, "name", "s")
    spelt = n.withColumn("n", F.count("*").over(Window.partitionBy("name_id"))).withColumn("s", every(SPREAD)).repartition(tasks, "name", "s")
    pairs = parts.join(spelt.hint("shuffle_hash"), ["name", "s"])
    of = lambda held: pairs.where(held).select(F.col("id").alias(id_col), F.col("name_id").alias(name_id))
    # a pair comes once, but for names of several spellings
    return of("n = 1").union(of("n > 1").distinct())


def matches(texts: Iterator[str], names: list[str]) -> Iterator[set[str]]:
    """The same for a few texts in one process."""
    words = ahocorasick.Automaton()
    for name in names:
        if name:
            words.add_word(name.lower(), name)
    words.make_automaton()
    for text in texts:
        yield {n for _, n in words.iter(text.lower())} if len(words) else set()
