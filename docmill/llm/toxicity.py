"""Toxicity by weak supervision: voters from lexicons, patterns and mined terms, a generative label model of their votes, a linear classifier on its posteriors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import crc_mod

_TOKEN = re.compile(r"\w+")
#: Stem patterns: so many first letters of longer words.
STEMS = (4, 5, 6, 7)
#: Common insults of four languages.
LEXICON = (
    "idiot", "moron", "stupid", "loser", "pathetic", "worthless", "scum", "trash", "disgusting", "clown", "imbecile", "dumb",
    "idiote", "imbécile", "crétin", "abruti", "débile", "connard", "connasse", "salaud", "salope", "ordure", "raclure", "minable",
    "dummkopf", "trottel", "blödmann", "vollidiot", "arschloch", "abschaum", "versager", "drecksack", "erbärmlich", "widerlich", "schlampe", "missgeburt",
    "idiota", "imbécil", "estúpido", "estúpida", "tonto", "cretino", "cabrón", "gilipollas", "basura", "patético", "asqueroso", "inútil",
)
#: Patterns of abuse that need no word list.
PATTERNS = {
    "#shout": r"(?:\b[^\W\d_a-zß-öø-ÿ]{4,}\b\W+){4}",
    "#marks": r"[!?]{4,}",
    "#stretch": r"([^\W\d_])\1{4,}",
    "#wish": r"(?i)\b(?:go to hell|drop dead|shut up|fuck (?:you|off)|ta gueule|va te faire|halt(?:'s| die) (?:maul|klappe)|verpiss dich|vete a la mierda|cállate)\b",
    "#you": r"(?i)\b(?:you (?:are|re)|you're|tu es|t'es|du bist|eres)\s+(?:such\s+)?(?:an?|une?|eine?|una?)?\s*(?:%s)\b" % "|".join(LEXICON),
}
_PATTERNS = {k: re.compile(v) for k, v in PATTERNS.items()}
#: What marks a feature as a stem pattern.
MARK = "*"


#: From this score on a text counts as toxic.
THRESHOLD = 0.7


@dataclass(frozen=True)
class Calibration:
    """From the classifier's sums to scores: THRESHOLD at `at`, with a slope of its own below and above it."""

    at: float
    below: float
    above: float

    def score(self, z: float) -> float:
        t = z - self.at
        return float(1 / (1 + np.exp(-np.clip(np.log(THRESHOLD / (1 - THRESHOLD)) + t * (self.below if t < 0 else self.above), -40, 40))))


@dataclass
class ToxicModel:
    """Voters, the label model's view of them, the classifier's weights by feature, and its calibration."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -4.0
    cut: Calibration = Calibration(0.0, 1.0, 1.0)
    voters: dict[str, tuple[float, float, float]] = field(default_factory=dict)  # feature -> P(vote | toxic), P(vote | clean), share of its group

    def score(self, text: str | None) -> float:
        return self.cut.score(self.bias + sum(self.weights[f] for f in features(text, self.weights)))


def features(text: str | None, known: dict[str, float] | set[str]) -> set[str]:
    """The known features of a whole text: words, stems of longer words, and patterns."""
    if not text:
        return set()
    out = {k for k, p in _PATTERNS.items() if k in known and p.search(text)}
    for w in set(_TOKEN.findall(text.lower())):
        if w in known:
            out.add(w)
        for n in STEMS:
            if len(w) <= n:
                break
            if (s := w[:n] + MARK) in known:
                out.add(s)
    return out


def candidate_terms(labelled: DataFrame, most: int) -> tuple[list[tuple[str, int, int]], int, int]:
    """(term, toxic rows, clean rows) of the terms that lean most to toxic rows, and the numbers of rows."""
    totals = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).first()
    n, p = totals["n"], totals["p"]
    if not p or p == n:
        return [], int(p), int(n - p)
    words = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)))
    forms = lambda w: F.array_compact(F.array(w, *[F.when(F.length(w) > k, F.concat(F.substring(w, 1, k), F.lit(MARK))) for k in STEMS]))
    # a row's terms are made distinct in place; only partial counts are shuffled
    terms = labelled.select("y", F.explode(F.array_distinct(F.flatten(F.transform(words, forms)))).alias("f"))
    share = p / n
    counts = terms.groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("c"))
    z = (F.col("a") - share * F.col("c")) / F.sqrt(F.col("c") * share * (1 - share) + 1)
    top = counts.where((F.col("a") >= 2) & (F.col("a") >= F.col("c") * (0.5 + share / 2))).select("f", "a", "c", z.alias("z")).where("z > 2").orderBy(F.desc("z"), F.length("f"), "f").limit(most).collect()
    return [(r["f"], int(r["a"]), int(r["c"] - r["a"])) for r in top], int(p), int(n - p)


def choose_voters(hits: np.ndarray, y: np.ndarray, most: int = 64, least_p: float = 1e-9) -> list[int]:
    """Greedy cover: the column that explains most toxic rows not yet explained, while that is no accident.

    The chance of an accident is bounded by (toxic share) ** rows explained; least_p allows for the millions of terms
    among which the columns were found.
    """
    left, chosen = y == 1, []
    share = max(float(y.mean()), 1e-3)
    clean = hits[y == 0].sum(axis=0)
    while len(chosen) < most and left.any():
        gain = hits[left].sum(axis=0) - 2.0 * clean
        gain[chosen] = -np.inf
        j = int(np.argmax(gain))
        now = left.sum() / max(1, left.sum() + (y == 0).sum())
        if gain[j] < 2 or min(share, max(now, 1e-3)) ** gain[j] > least_p:
            break
        chosen.append(j)
        left = left & (hits[:, j] == 0)
    return chosen


def label_model(votes: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A generative model of binary votes by EM, without labels: (posteriors, P(vote|1), P(vote|0), shares).

    A voter that finds nothing abstains: it says nothing for a clean label, as toxic texts of one language or style set off few voters.
    Each voter has its own two rates (its accuracy). Votes that correlate beyond their label - residual correlation over 0.5 in
    either class, by the last posteriors - form groups, and a voter's evidence counts by 1 / (correlated voters, itself
    included), so that copies of a voter are one voice. `prior`, the share of toxic rows, is given, as abstaining voters cannot tell
    it: what the rows with votes leave of it is spread over those without. Rows that set off several voters begin as the likeliest.
    """
    n, k = votes.shape
    if not n or not k:
        return np.full(n, prior), np.zeros(k), np.zeros(k), np.ones(k)
    x = votes.astype(float)
    # a voter that speaks more often than toxic rows can be is a weak sign from the start
    rare = np.minimum(1.0, prior / np.maximum(x.mean(axis=0), 1e-9))
    q = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + 4.0 * (x * rare).sum(axis=1).clip(0, 5))))
    silent = ~x.any(axis=1)
    share = np.ones(k)
    for r in range(rounds):
        one, zero = q.sum(), (1 - q).sum()
        p1, p0 = (q @ x + 0.5) / (one + 1), ((1 - q) @ x + 0.05) / (zero + 1)
        if r % 10 == 5:
            linked = np.zeros((k, k), bool)
            for w, p in ((q, p1), (1 - q, p0)):
                c = x - p
                cov = (c * w[:, None]).T @ c / max(w.sum(), 1e-9)
                sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
                linked |= (cov / np.outer(sd, sd) > 0.5) & (np.minimum.outer(w @ x, w @ x) >= 5)
            np.fill_diagonal(linked, True)
            share = 1 / linked.sum(axis=1)
        z = np.log(prior / (1 - prior)) + x @ (share * np.log(p1 / p0))
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        new[silent] = np.clip((prior * n - new[~silent].sum()) / max(1, silent.sum()), 1e-4, prior)
        done = np.abs(new - q).max() < 1e-6 and r > 12
        q = new
        if done:
            break
    return q, p1, p0, share


def fit_linear(x: np.ndarray, q: np.ndarray, ridge: float = 0.0005, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels, by Newton steps; classes weigh the same."""
    n, k = x.shape
    pos = max(q.sum(), 1e-6)
    w = q * (n / (2 * pos)) + (1 - q) * (n / (2 * max(n - pos, 1e-6)))
    target = q * (n / (2 * pos)) / np.maximum(w, 1e-12)
    a = np.hstack([x.astype(float), np.ones((n, 1))])
    b = np.zeros(k + 1)
    reg = np.full(k + 1, ridge * np.sqrt(n))
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        g = a.T @ (w * (p - target)) + reg * b
        h = (a * (w * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ a + np.diag(reg + 1e-9)
        step = np.linalg.solve(h, g)
        b -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return b[:-1], float(b[-1])


def learn(docs: DataFrame, labels: DataFrame, fold: tuple[int, int] | None = (3, 1), most_rows: int = 20_000, most_terms: int = 2_000, most_voters: int = 64, most_features: int = 256, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicModel:
    """Fit on a bounded sample of rows outside the fold, drawn by a hash of the id: about `most_rows` labelled and as many without a label; exact copies of a text once.

    The voters are the fixed lexicons and patterns and at most `most_voters` mined ones: of the `most_terms` words and word beginnings
    that lean most to toxic labelled rows, a greedy cover of the toxic rows. The label model sees the votes on all rows of the sample, labelled
    or not, and no label; a fixed voter found in more clean labelled rows than toxic ones (and one more) is left out first, which settles the orientation. Its posteriors
    train the linear classifier, whose features are the voters and other mined terms, `most_features` in all. Labels calibrate it, so that
    predictions at THRESHOLD agree best with the labelled rows. Rows with a null id or text teach nothing. With
    no toxic row among the labelled, the lexicon alone is the model.
    """
    d = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t")).where("d is not null and t is not null")
    y = labels.select(F.col(id_col).alias("d2"), F.col(label_col).cast("int").alias("y")).where("d2 is not null and y in (0, 1)").groupBy("d2").agg(F.max("y").alias("y"))
    if fold:
        d = d.where(crc_mod("d", fold[0]) != fold[1])
        y = y.where(crc_mod("d2", fold[0]) != fold[1])
    n, m = y.count(), d.count()
    share = lambda c, of: F.pmod(F.xxhash64(c), F.lit(1 << 40)) / F.lit(float(1 << 40)) < min(1.0, most_rows / max(1, of))
    # bounded by most_rows, so a broadcast; the texts stay where they are read
    y = F.broadcast(y.where(share("d2", n)))
    sample = d.join(y, d["d"] == y["d2"], "left").where(F.col("y").isNotNull() | share("d", m))
    sample = sample.groupBy(F.xxhash64("t").alias("h")).agg(F.first("t").alias("t"), F.max("y").alias("y"), F.min("d").alias("d")).select("d", "t", "y").persist()
    try:
        terms, pos, neg = candidate_terms(sample.where("y is not null"), most_terms)
        names = list(dict.fromkeys([*LEXICON, *PATTERNS, *(t[0] for t in terms)]))
        at = {f: i for i, f in enumerate(names)}

        def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = []
                for t in b["t"]:
                    v = np.zeros(len(at), bool)
                    v[[at[f] for f in features(t, at)]] = True
                    rows.append(np.packbits(v).tobytes())
                yield pd.DataFrame({"y": b["y"].fillna(-1).astype("int32"), "d": b["d"].astype("int64"), "v": rows})

        got = sample.withColumn("d", F.xxhash64("d")).mapInPandas(hits, "y int, d long, v binary").collect()
    finally:
        sample.unpersist()
    if not got or not pos or not neg:
        return ToxicModel({f: 6.0 for f in LEXICON})
    got.sort(key=lambda r: (r["d"], r["v"], r["y"]))
    x = np.unpackbits(np.frombuffer(b"".join(r["v"] for r in got), np.uint8).reshape(len(got), -1), axis=1)[:, : len(names)]
    gold = np.array([r["y"] for r in got])
    known = gold >= 0
    toxic, clean = x[gold == 1].sum(axis=0, dtype=int), x[gold == 0].sum(axis=0, dtype=int)
    fixed = [j for j in range(len(LEXICON) + len(PATTERNS)) if toxic[j] + 1 >= clean[j] and x[:, j].any()]
    voters = list(dict.fromkeys([*choose_voters(x[known], gold[known], most_voters), *fixed]))
    prior = float((gold == 1).sum() / known.sum())
    q, p1, p0, weight = label_model(x[:, voters], prior)
    others = [j for j in (at[t[0]] for t in terms) if j not in set(voters)][: max(0, most_features - len(voters))]
    used = [*voters, *others]
    w, bias = fit_linear(x[:, used].astype(np.float32), q)
    cut = calibrate(x[known][:, used] @ w + bias, gold[known])
    weights = {names[j]: float(a) for j, a in zip(used, w, strict=True)}
    # lexicon words that the sample never showed keep a general weight
    usual = float(np.median([a for a in w[: len(voters)] if a > 0])) if (w[: len(voters)] > 0).any() else 6.0
    weights |= {f: usual for f in LEXICON if not x[:, at[f]].any()}
    return ToxicModel(weights, bias, cut, {names[j]: (float(a), float(b), float(s)) for j, a, b, s in zip(voters, p1, p0, weight, strict=True)})


def calibrate(z: np.ndarray, y: np.ndarray) -> Calibration:
    """The threshold lies where it agrees best with y (by F0.5, so that clean rows count more), in the middle between two
    values; slopes give the median row on either side the toxic share of that side."""
    order = np.argsort(-z, kind="stable")
    s, hit = z[order], np.cumsum(y[order] == 1)
    f = 1.25 * hit / (np.arange(1, len(s) + 1) + 0.25 * max(1, (y == 1).sum()))
    cut = np.append(s[1:], s[-1] - 2)
    f[s - cut < 1e-6] = -1
    best = int(np.argmax(f))
    at = (s[best] + cut[best]) / 2
    logit = lambda p: np.log(p / (1 - p))
    slopes = []
    for side, least, most in ((z < at, 0.001, 0.6), (z > at, 0.75, 0.999)):
        share = np.clip((y[side] == 1).mean(), least, most) if side.any() else most
        slopes.append(abs(logit(share) - logit(THRESHOLD)) / max(1e-6, np.median(abs(z[side] - at))) if side.any() else 1.0)
    return Calibration(float(at), *map(float, slopes))


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """(id, score, predicted) for every row, or with `keep` all of its columns and these two (replaced if there).

    Null and empty texts score by the bias alone. Only the text is read by a score, so equal texts score alike, repeated rows and ids are scored each by
    themselves, and ties need no rule; an empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series([m.score(t) for t in texts], dtype=float)

    cols = [F.col(c) for c in docs.columns if c not in ("score", "predicted")] if keep else [F.col(id_col)]
    out = docs.select(*cols, of(F.col(text_col).cast("string")).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
