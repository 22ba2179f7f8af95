"""Findings on figures of one thing across documents: five detectors, and an idempotent merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import values as V
from docmill.operators import relational

SIGNATURE, TREND_N, TREND_SIGMA = 290, 4, 2.5
FINDING = ["kind", "severity", "anchor", "title", "detail", "signature", "evidence"]


def facts(entities: DataFrame, relations: DataFrame, fields: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """Fact nodes as rows: node, kind, anchor, anchor_name, category, unit, value, as_on, document_id, field_id; with fields and documents also
    filename, page_no and field_key, by which evidence is shown and re-uploads of a file are taken together.

    A node's anchor is the source of its first has_reserve or produces edge, by edge id.
    """
    if fields is not None and docs is not None:
        f = facts(entities, relations).join(fields.select("field_id", "page_no", "field_key"), "field_id", "left")
        f = f.join(docs.select("document_id", "filename"), "document_id", "left")
        return f.withColumn("field_key", F.coalesce("field_key", "category"))
    a = F.col("attrs")
    nodes = entities.where(F.col("kind").isin("reserve", "production_figure"))
    into = relations.where(F.col("predicate").isin("has_reserve", "produces")).groupBy("dst").agg(F.min_by("src", "id").alias("anchor"))
    names = entities.select(F.col("id").alias("anchor"), F.col("name").alias("anchor_name"))
    out = nodes.join(into, nodes["id"] == into["dst"], "left").join(names, "anchor", "left")
    value = F.coalesce(a["quantity"], a["value"]).try_cast("double")
    category = F.coalesce(a["category"], a["metric"], "name")
    return out.select(F.col("id").alias("node"), "kind", "anchor", "anchor_name", category.alias("category"), a["unit"].alias("unit"), value.alias("value"), F.coalesce(a["as_on"], a["period"]).alias("as_on"), "document_id", "field_id").where("value is not null")


def group_differs(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Groups in which any two values differ: exactly those whose least and greatest do."""
    g = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    return g.where((F.col("n") > 1) & V.differs(F.col("low"), F.col("high")))


def _item(f: DataFrame) -> Column:
    """A figure's evidence; with file names, re-uploads of one file (equal field, value and date) are neighbours in its order."""
    if "filename" not in f.columns:
        return F.struct("document_id", "category", "value", "as_on")
    return F.struct(F.coalesce("filename", "document_id").alias("file"), "field_key", "value", "as_on", "document_id", "filename", "page_no", "category")


def _collapsed(items: Column, f: DataFrame) -> Column:
    """Sorted evidence, of equal files, fields, values and dates the first only."""
    if "filename" not in f.columns:
        return items
    same = lambda a, b: (a["file"] == b["file"]) & a["field_key"].eqNullSafe(b["field_key"]) & (a["value"] == b["value"]) & a["as_on"].eqNullSafe(b["as_on"])
    return F.filter(items, lambda x, i: (i == 0) | ~F.coalesce(same(F.get(items, i - 1), x), F.lit(False)))


def _evidence(f: DataFrame) -> Column:
    return _collapsed(F.array_sort(F.collect_set(_item(f))), f)


def _titled(name: str, rest: Column) -> Column:
    return F.concat(F.coalesce(F.concat(F.col(name), F.lit(": ")), F.lit("")), rest)


def out_of_range(f: DataFrame) -> DataFrame:
    bad = V.out_of_range(F.col("kind"), F.col("category"), F.col("unit"), F.col("value"))
    one = f.withColumn("detail", bad).where("detail is not null")
    return one.select(F.lit("out_of_range").alias("kind"), F.lit("high").alias("severity"), "anchor", _titled("anchor_name", F.concat("category", F.lit(" — implausible value"))).alias("title"), "detail", F.concat(F.lit("oor:"), "node").alias("signature"), F.array(_item(f)).alias("evidence"))


def revisions_and_contradictions(f: DataFrame) -> DataFrame:
    """One finding an anchor and kind: figures that differ under several dates are revisions, under one date contradictions."""
    day = F.coalesce("as_on", F.lit(""))
    g = f.groupBy("anchor", "anchor_name", "category").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        # two dates or more, without a distinct count, which would aggregate and shuffle everything once more by date
        F.coalesce(F.min("as_on") < F.max("as_on"), F.lit(False)).alias("rev"),
        F.min(F.struct(day, "value", "node")).alias("first"), F.max(F.struct(day, "value", "node")).alias("last"),
        F.collect_set("document_id").alias("docs"), _evidence(f).alias("evidence"),
    )
    g = g.where((F.col("n") > 1) & V.differs(F.col("low"), F.col("high")))
    when = lambda s: F.coalesce(F.nullif(s["col1"], F.lit("")), F.lit("n/d"))
    span = F.concat(V.format_quantity(F.col("first.value")), F.lit(" ("), when(F.col("first")), F.lit(") -> "), V.format_quantity(F.col("last.value")), F.lit(" ("), when(F.col("last")), F.lit(")"))
    g = g.withColumn("line", F.concat(F.replace("category", F.lit("_"), F.lit(" ")), F.lit(" "), span))
    a = g.groupBy("anchor", "anchor_name", "rev").agg(F.array_sort(F.collect_list("line")).alias("lines"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"), _collapsed(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))), f).alias("evidence"))
    n = F.size("lines")
    fields = F.concat(F.lit("("), n.cast("string"), F.when(n == 1, " field)").otherwise(" fields)"))
    body = F.array_join("lines", "; ")
    title = F.when(F.col("rev"), F.concat(F.lit("figures revised across reports "), fields)).otherwise(F.concat(F.lit("conflicting figures for the same period "), fields))
    detail = F.when(F.col("rev"), F.concat(F.lit("Historical vs current figures differ — "), body, F.lit(". Confirm the revision is intentional and supersedes the earlier report."))).otherwise(F.concat(F.lit("Two sources give different values for the same as-on date — "), body, F.lit(".")))
    sig = F.left(F.concat(F.when(F.col("rev"), "rev:").otherwise("con:"), F.coalesce("anchor", F.lit("")), F.lit(":"), F.array_join("docs", ",")), F.lit(SIGNATURE))
    return a.select(F.when(F.col("rev"), "revision").otherwise("contradiction").alias("kind"), F.when(F.col("rev"), "medium").otherwise("high").alias("severity"), "anchor", _titled("anchor_name", title).alias("title"), detail.alias("detail"), sig.alias("signature"), "evidence")


def sum_mismatch(f: DataFrame) -> DataFrame:
    """Anchors and dates with all of proved, indicated, inferred and total, whose parts do not add up; of several figures the last node's counts."""
    cats = ["proved", "indicated", "inferred", "total"]
    d = f.where(F.col("anchor").isNotNull() & F.col("category").isin(cats)).withColumn("day", F.coalesce("as_on", F.lit("n/d")))
    p = d.groupBy("anchor", "anchor_name", "day").agg(*[F.max_by("value", F.when(F.col("category") == c, F.col("node"))).alias(c) for c in cats], _evidence(f).alias("evidence"), *[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in cats])
    p = p.where(" and ".join(f"n_{c} > 0" for c in cats)).withColumn("sum", F.col("proved") + F.col("indicated") + F.col("inferred")).where(V.differs(F.col("sum"), F.col("total")))
    detail = F.concat(F.format_string("proved+indicated+inferred = %.2f but total states %.2f (as on ", "sum", "total"), "day", F.lit(")."))
    return p.select(F.lit("sum_mismatch").alias("kind"), F.lit("high").alias("severity"), "anchor", _titled("anchor_name", F.lit("reserve categories do not sum to the stated total")).alias("title"), detail.alias("detail"), F.left(F.concat(F.lit("sum:"), "anchor", F.lit(":"), "day"), F.lit(SIGNATURE)).alias("signature"), "evidence")


def outliers(df: DataFrame, keys: list[str], value: str = "value", least: int = TREND_N, sigma: float = TREND_SIGMA) -> DataFrame:
    """Rows further than sigma population deviations from their group's mean, in groups of `least` at least.

    Moments come from a grouped aggregate with partial sums, not a window, so that a large group is not one task's rows.
    """
    g = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd")).where(f"_n >= {least} and sd > 0")
    return df.join(g, keys).where(F.abs(F.col(value) - F.col("mean")) > sigma * F.col("sd")).drop("_n")


def trend_breaks(f: DataFrame) -> DataFrame:
    o = outliers(f.where("anchor is not null"), ["anchor", "category"])
    v = V.format_quantity(F.col("value"))
    detail = F.concat(v, F.format_string(" is >2.5σ from the mean of %.2f for this metric.", "mean"))
    return o.select(F.lit("trend_break").alias("kind"), F.lit("low").alias("severity"), "anchor", _titled("anchor_name", F.concat("category", F.lit(" — outlier vs history"))).alias("title"), detail.alias("detail"), F.left(F.concat(F.lit("trend:"), "anchor", F.lit(":"), "category", F.lit(":"), v), F.lit(SIGNATURE)).alias("signature"), F.array(_item(f)).alias("evidence"))


def detect(f: DataFrame) -> DataFrame:
    """All findings, one a signature."""
    parts = [out_of_range(f), revisions_and_contradictions(f), sum_mismatch(f), trend_breaks(f)]
    both = reduce(DataFrame.unionByName, [p.select(*FINDING) for p in parts])
    w = Window.partitionBy("signature").orderBy("kind", "detail")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge(stored: DataFrame, found: DataFrame, carry: list[str], sig: str = "signature") -> DataFrame:
    """Stored findings after a scan, with `change`: created, updated (open ones take new values), kept (reviewed ones), auto_resolved (open, gone), gone."""
    s = stored.select(F.col(sig), F.col("status").alias("_status"), *[F.col(c).alias(f"_old_{c}") for c in carry])
    n = found.select(F.col(sig), F.lit(True).alias("_new"), *[F.col(c).alias(f"_new_{c}") for c in carry])
    j = s.join(n, sig, "full_outer")
    new, old = F.coalesce("_new", F.lit(False)), F.col("_status").isNotNull()
    is_open = F.coalesce(F.col("_status") == "open", F.lit(False))
    change = F.when(~old, "created").when(new & is_open, "updated").when(is_open, "auto_resolved").when(new, "kept").otherwise("gone")
    status = F.when(~old, "open").when(is_open & ~new, "resolved").otherwise(F.col("_status"))
    return j.select(sig, status.alias("status"), change.alias("change"), *[F.when(new & (~old | is_open), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in carry])


def scan(stored: DataFrame, f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, statistics): detect, merge with the stored findings by signature, and count the changes by kind.

    stored: signature, kind, status, severity, anchor, title, detail.
    """
    carry = ["kind", "severity", "anchor", "title", "detail"]
    merged = merge(stored, detect(f), carry)
    n = lambda what: F.count_if(F.col("change") == what)
    return merged, merged.groupBy("kind").agg(n("created").alias("created"), n("updated").alias("updated"), n("auto_resolved").alias("resolved"), n("kept").alias("kept"))


def review(stored: DataFrame, decisions: DataFrame, sig: str = "signature") -> DataFrame:
    """Reviewers' new states (not back to open) over the stored ones; of several on one finding the last counts (see last_decisions())."""
    d = decisions.where("decision in ('acknowledged', 'resolved', 'dismissed')")
    d = relational.last_decisions(d.select(sig, "decision", *[c for c in ("decided_at",) if c in d.columns]), sig)
    return stored.join(d, sig, "left").withColumn("status", F.coalesce("decision", "status")).drop("decision")


def listing(findings: DataFrame, owner: str | None = None, status: str | None = None, kind: str | None = None, severity: str | None = None, limit: int = 100) -> DataFrame:
    """Findings that a principal may see (owner null: everyone's), open ones first, then by severity, the newest first; at most `limit`, 1 to 500.

    findings: signature, kind, status, severity, owner, updated_at and more."""
    from docmill.functions.values import rank_of

    seen = findings.where(V.scope(F.col("owner"), owner)).where(V.equal_if_given(status=status, kind=kind, severity=severity))
    # The order of states and severities.
    order = [rank_of(F.col("status"), ["open", "acknowledged", "resolved", "dismissed"]), rank_of(F.col("severity"), ["high", "medium", "low"]), F.desc("updated_at"), F.asc("signature")]
    return relational.page(seen, order, limit, cap="findings")


def scoped_summary(findings: DataFrame, owner: str | None = None) -> DataFrame:
    """(what, name, n) over the findings that a principal may see: total, open, and counts by kind and severity."""
    seen = findings.where(V.scope(F.col("owner"), owner))
    parts = [seen.agg(F.count("*").alias("n")).select(F.lit("total").alias("what"), F.lit(None).cast("string").alias("name"), "n"), seen.agg(F.count_if(F.col("status") == "open").alias("n")).select(F.lit("open").alias("what"), F.lit(None).cast("string").alias("name"), "n")]
    parts += [seen.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(c).alias("what"), F.col(c).alias("name"), "n") for c in ("kind", "severity")]
    return reduce(DataFrame.unionByName, parts)
