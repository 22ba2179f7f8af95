"""Functions of numbers and vectors, and predicates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# When two figures differ, what a reserve can be, how much a confidence can be.
REL_DIFF, ABS_DIFF, RESERVE_MAX, CONF_CAP, CONF_ACCEPT = 0.02, 0.01, 100_000.0, 0.97, 0.75


def differs(a: Column, b: Column) -> Column:
    """Apart by more than 0.01 and by more than 2 % of the larger."""
    return F.abs(a - b) > F.greatest(F.lit(ABS_DIFF), F.lit(REL_DIFF) * F.greatest(F.abs(a), F.abs(b)))


def out_of_range(kind: Column, category: Column, unit: Column, value: Column) -> Column:
    """Why a figure is implausible (the last rule that holds), null if it isn't."""
    v = format_quantity(value)
    return (
        F.when((category == "stripping_ratio") & (value <= 0), F.concat(F.lit("stripping ratio "), v, F.lit(" must be positive")))
        .when(F.contains(F.coalesce(unit, F.lit("")), F.lit("percent")) & ~value.between(0, 110), F.concat(F.lit("percentage "), v, F.lit("% outside 0-100")))
        .when((kind == "reserve") & ((value < 0) | (value > RESERVE_MAX)), F.concat(F.lit("reserve quantity "), v, F.lit(" "), F.coalesce(unit, F.lit("")), F.lit(" is out of plausible range")))
    )


def format_quantity(value: Column, unit: Column | None = None) -> Column:
    """Up to six decimals without trailing zeros, and the unit with blanks."""
    text = F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", "")
    return text if unit is None else F.trim(F.concat_ws(" ", text, F.replace(F.coalesce(unit, F.lit("")), F.lit("_"), F.lit(" "))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a vector is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def route(confidence: Column, accept: float = CONF_ACCEPT) -> Column:
    return F.when(confidence >= accept, "auto_accepted").otherwise("needs_review")


def score(base: Column, source_kind: Column, word_conf: Column, matched: Column, value: Column) -> Column:
    """Confidence of an extracted value: recognised text, long spans and bare short numbers count less; at most 0.97."""
    c = base * F.when(source_kind == "ocr", F.when(word_conf.isNull(), 0.75).otherwise(0.6 + 0.35 * word_conf)).otherwise(1.0)
    c = c * F.when(F.length(matched) > 90, 0.9).otherwise(1.0)
    c = c * F.when(value.rlike(r"^[\d.,]+$") & (F.length(matched) < 12), 0.85).otherwise(1.0)
    return F.round(F.least(c, F.lit(CONF_CAP)), 3)


def word_confidence(words: Column, value: Column) -> Column:
    """Mean recognition confidence of the words that are tokens of the value, null if none is."""
    tokens = F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    hits = F.filter(words, lambda w: F.array_contains(tokens, F.lower(w["text"])))
    total = F.aggregate(hits, F.lit(0.0), lambda s, w: s + w["ocr_conf"].cast("double"))
    return F.try_divide(total, F.size(hits))


def union_box(words: Column, value: Column) -> Column:
    """Smallest box around the page's words that make up the value: for each part of it the first word that equals, holds or is held by it."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9.]+", "")
    parts = F.filter(F.transform(F.split(F.trim(value), r"\s+"), bare), lambda t: t != "")
    known = F.filter(F.transform(words, lambda w: F.struct(bare(w["text"]).alias("t"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"))), lambda w: w["t"] != "")
    hits = F.filter(F.transform(parts, lambda p: F.get(F.filter(known, lambda w: F.contains(w["t"], p) | F.contains(p, w["t"])), F.lit(0))), lambda w: w.isNotNull())
    edge = lambda h, f, k: f(F.transform(h, lambda w: w[k])).alias(k)
    # the hits are found once and handed to the four edges; a page without words has none
    box = lambda h: F.when(F.size(h) > 0, F.struct(edge(h, F.array_min, "x0"), edge(h, F.array_min, "y0"), edge(h, F.array_max, "x1"), edge(h, F.array_max, "y1")))
    return F.when(F.size(words) > 0, F.get(F.transform(F.array(hits), box), F.lit(0)))


# ---------------------------------------------------------------- predicates


def scope(owner: Column, principal: object | None) -> Column:
    """Rows of the principal's own unit and rows of none; a principal of None sees all."""
    return F.lit(True) if principal is None else (owner == F.lit(principal)) | owner.isNull()


def valid_at(start: Column, end: Column, at: Column) -> Column:
    """Validity on a date, bounds included, null bounds open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def equal_if_given(**wanted: object) -> Column:
    """All given equalities; None asks for nothing."""
    out = F.lit(True)
    for name, value in wanted.items():
        if value is not None:
            out = out & (F.col(name) == F.lit(value))
    return out


def like_any(pattern: str, *cols: Column) -> Column:
    """Case-insensitive substring in any of the columns; % and _ keep their meaning."""
    out = F.lit(False)
    for c in cols:
        out = out | c.ilike(f"%{pattern}%")
    return out


def rank_of(c: Column, order: Iterable[str]) -> Column:
    """Place of a value in a given order, the rest last."""
    out = None
    names = list(order)
    for i, v in enumerate(names):
        out = F.when(c == v, i) if out is None else out.when(c == v, i)
    return out.otherwise(len(names)) if out is not None else F.lit(0)
