"""Temperature mixing of sources: a bisected exponent on token shares, realised as budgeted block permutations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm.common import WORD_RE, Work

#: Rows of a block of a source's permutation; tasks that look inside a block hold about so many narrow rows.
BLOCK_ROWS = 4096
#: One total a source comes to the driver for up to so many sources (100 MB there); the totals of more stay a table, and sums over them come instead.
MOST_SOURCES = 1_000_000


@dataclass(frozen=True)
class Plan:
    exponent: float
    sources: list[str]
    tokens: np.ndarray
    weights: np.ndarray
    budgets: np.ndarray  # whole tokens a source


def _weights(tokens: np.ndarray, a: float) -> np.ndarray:
    x = np.where(tokens > 0, np.maximum(tokens, 1) / tokens.max(), 0.0)
    w = np.where(x > 0, x**a, 0.0)
    return w / w.sum()


def entropy(w: np.ndarray) -> float:
    w = w[w > 0]
    return float(-(w * np.log(w)).sum())


def plan(totals: dict[str, int], target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> Plan:
    """Weights proportional to (token share) ** exponent, exponent in [0, 1], by bisection.

    With target_entropy (nats): the largest exponent whose weights have at least that entropy (0 if even equal weights have
    less). With max_repeats: the least exponent at which no source is passed over more than max_repeats times (1 if none is
    small enough). One of the two is needed. Without a budget it is the least at which every source is passed
    over once at least, so that mixing drops nothing. Sources without tokens get no weight.
    """
    names = sorted(totals)
    n = np.array([totals[k] for k in names], float)
    if not len(n) or n.max() <= 0:
        return Plan(1.0, names, n, np.zeros(len(n)), np.zeros(len(n), np.int64))
    some = n > 0

    def spend(a: float) -> tuple[np.ndarray, np.ndarray]:
        w = _weights(n, a)
        b = float(budget) if budget is not None else float((n[some] / w[some]).max())
        return w, w * b

    def enough(a: float) -> bool:  # true for a up to / from the exponent sought
        w, b = spend(a)
        if target_entropy is not None:
            return entropy(w) >= target_entropy
        return bool((b[some] / n[some]).max() <= max_repeats * (1 + 1e-12))

    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("one of target_entropy and max_repeats")
    falling = target_entropy is not None  # entropy falls with the exponent, so do repeats
    lo, hi = 0.0, 1.0
    if falling:
        a = 1.0 if enough(1.0) else 0.0
        if a == 0.0 and enough(0.0):
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if enough(mid) else (lo, mid)
            a = lo
    else:
        a = 0.0 if enough(0.0) else 1.0
        if a == 1.0 and enough(1.0):
            for _ in range(60):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if enough(mid) else (mid, hi)
            a = hi
    w, b = spend(a)
    return Plan(a, names, n, w, np.rint(b).astype(np.int64))


def plan_table(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None) -> tuple[float, DataFrame]:
    """(exponent, (s, n, rows, budget)) as plan() has it, for totals (s, n, rows) that stay a table: a step of the bisection is two sums over it.

    With x = n / max(n) and Z = sum of x ** a: weights are x ** a / Z, their entropy ln Z - (sum of x ** a ln x) / Z * a, the budget by which every source is
    passed over once max(n) * Z, and the most repeats fall to the smallest source.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("one of target_entropy and max_repeats")
    some = totals.where("n > 0")
    high, low = some.agg(F.max("n"), F.min("n")).first()
    if high is None:
        return 1.0, totals.withColumn("budget", F.lit(0).cast("long"))
    x = F.col("n") / F.lit(float(high))

    def sums(a: float) -> tuple[float, float]:
        z, s = some.agg(F.sum(F.pow(x, F.lit(a))), F.sum(F.pow(x, F.lit(a)) * F.log(x))).first()
        return z, s

    def enough(a: float) -> bool:
        if target_entropy is None and budget is None:
            return (low / high) ** (a - 1) <= max_repeats * (1 + 1e-12)
        z, s = sums(a)
        if target_entropy is not None:
            return np.log(z) - a * s / z >= target_entropy
        return budget / (z * high) * (low / high) ** (a - 1) <= max_repeats * (1 + 1e-12)

    falling = target_entropy is not None
    first, last = (1.0, 0.0) if falling else (0.0, 1.0)
    a = first if enough(first) else last
    if a == last and enough(last):
        good, bad = last, first
        for _ in range(60):
            mid = (good + bad) / 2
            good, bad = (mid, bad) if enough(mid) else (good, mid)
        a = good
    z, _ = sums(a)
    whole = float(budget) if budget is not None else high * z
    return a, totals.withColumn("budget", F.when(F.col("n") > 0, F.rint(F.pow(x, F.lit(a)) / F.lit(z) * F.lit(whole))).otherwise(0).cast("long"))


def mix(docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: int | None = None, seed: int = 7, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", work: Work | None = None, extras: bool = True) -> DataFrame:
    """`docs` with each row as often as its source's budget says; extra columns pass, block, order_key, n_tokens, if `extras`.

    A source's rows are permuted by a hash; its budget takes whole passes, then of one more pass the rows of the permutation
    up to which tokens stay within the budget (rows of equal hash together). Tokens are words. Rows without a source are the
    source ''; null texts have no tokens and go with whole passes; a source without any token keeps its rows once. Repeated
    rows are rows. Only (source, hash, tokens) of the rows is shuffled, pre-summed by block; texts stay where they are read.
    """
    spark = docs.sparkSession
    work = work or Work(spark, "mix")
    if extras:
        docs = docs.drop("pass", "block", "order_key", "n_tokens")
    names = docs.columns
    src = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    tokens = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD_RE)), F.lit(0)).cast("long")
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 52))
    narrow = work.keep(docs.select(src.alias("s"), unit.alias("u"), tokens.alias("n")))
    totals = narrow.groupBy("s").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    rows = totals.limit(MOST_SOURCES + 1).collect()
    small = len(rows) <= min(MOST_SOURCES, 100_000)  # 4 MB
    if len(rows) > MOST_SOURCES:
        _, wide = plan_table(work.keep(totals, "totals"), target_entropy, max_repeats, budget)
        passes = F.when(F.col("n") > 0, F.floor(F.col("budget") / F.col("n"))).otherwise(1).cast("long")
        wide = wide.withColumn("passes", passes)
        info = work.keep(wide.select("s", "passes", F.when(F.col("n") > 0, F.col("budget") - F.col("passes") * F.col("n")).otherwise(0).cast("long").alias("rest"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("long").alias("blocks")), "plan")
    else:
        p = plan({r["s"]: r["n"] for r in rows}, target_entropy, max_repeats, budget)
        total = dict(zip(p.sources, p.tokens, strict=True))
        give = dict(zip(p.sources, p.budgets, strict=True))
        passes = {s: int(give[s] // total[s]) if total[s] else 1 for s in give}
        rest = {s: int(give[s] - passes[s] * total[s]) if total[s] else 0 for s in give}
        blocks = {r["s"]: max(1, -(-r["rows"] // BLOCK_ROWS)) for r in rows}
        info = spark.createDataFrame([(s, passes[s], rest[s], blocks[s]) for s in give], "s string, passes long, rest long, blocks long")
    side = F.broadcast(info) if small else info
    block = F.floor(F.col("u") / F.lit(float(1 << 52)) * F.col("blocks")).cast("long")
    placed = narrow.join(side, "s").withColumn("b", block)
    sums = placed.groupBy("s", "b").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    w = Window.partitionBy("s").orderBy("b")
    # the block in which the budget of the last pass ends, and what is left for it
    ends = sums.withColumn("upto", F.sum("n").over(w)).where("upto > rest and upto - n <= rest").groupBy("s").agg(F.min(F.struct("b", (F.col("rest") - F.col("upto") + F.col("n")).alias("left"))).alias("e")).select(F.col("s").alias("es"), "e.b", "e.left")
    ends = work.keep(ends)
    inside = placed.select("s", "u", "n", F.col("b").alias("pb")).join(F.broadcast(ends) if small else ends, (F.col("s") == F.col("es")) & (F.col("pb") == F.col("b")))
    tied = inside.groupBy("s", "u").agg(F.sum("n").alias("n"), F.first("left").alias("left"))
    cut = tied.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("u"))).where("upto > left").groupBy("s").agg(F.min("u").alias("cut"))
    info = work.keep(info.join(cut, "s", "left").select(F.col("s").alias("_s"), F.col("passes").alias("_p"), F.col("rest").alias("_r"), F.col("cut").alias("_cut"), F.col("blocks").alias("_bl")))
    full = docs.withColumn("_src", src).withColumn("_u", unit)
    both = full.join(F.broadcast(info) if small else info, F.col("_src") == F.col("_s"))
    reps = (F.col("_p") + F.when((F.col("_r") > 0) & (F.col("_cut").isNull() | (F.col("_u") < F.col("_cut"))), 1).otherwise(0)).cast("int")
    out = both.where(reps > 0).select(*names, "_u", "_bl", F.explode(F.sequence(F.lit(1), reps)).alias("_pass"))
    if not extras:
        return out.select(*names)
    at = F.floor(F.col("_u") / F.lit(float(1 << 52)) * F.col("_bl")).cast("long")
    key = F.pmod(F.xxhash64("_u", "_pass"), F.lit(1 << 52))
    return out.select(*names, F.col("_pass").alias("pass"), at.alias("block"), key.alias("order_key"), tokens.alias("n_tokens"))
