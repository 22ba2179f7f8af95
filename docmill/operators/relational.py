"""Small relational building blocks that several dataflows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows a caller gets at most, by endpoint.
CAPS = {"documents": 200, "review": 300, "audit": 500, "search": 50, "findings": 500}


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: str | None = None) -> DataFrame:
    """A page of an order; the caller's limit is clamped by the endpoint's cap."""
    n = min(limit, CAPS[cap]) if cap else limit
    return df.orderBy(*order).offset(offset).limit(n)


def newest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key in the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of several tables."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def matrix(df: DataFrame, row: str, col: str, values: list[str]) -> DataFrame:
    """Counts of row by column, zeros where there are none."""
    return df.groupBy(row).pivot(col, values).count().na.fill(0, values)


def summary(df: DataFrame, *cols: str) -> DataFrame:
    """(column, value, n) for each of the columns, and the total with nulls: one pass by grouping sets."""
    sets = ", ".join(f"({c})" for c in cols) + ", ()"
    name = "m_" + "_".join(cols)
    df.createOrReplaceTempView(name)
    pick = " ".join(f"WHEN grouping({c}) = 0 THEN '{c}'" for c in cols)
    value = " ".join(f"WHEN grouping({c}) = 0 THEN CAST({c} AS STRING)" for c in cols)
    return df.sparkSession.sql(f"SELECT CASE {pick} END AS dimension, CASE {value} END AS value, count(*) AS n FROM {name} GROUP BY GROUPING SETS ({sets})")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows, replaced or joined by the new ones of their key; null keys are equal."""
    cols = [c for c in old.columns if c not in keys]
    cond = None
    o, n = old.alias("o"), new.alias("n")
    for k in keys:
        c = F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
        cond = c if cond is None else cond & c
    mark = n.withColumn("_new", F.lit(True)).alias("n")
    j = o.join(mark, cond, "full_outer")
    is_new = F.coalesce(F.col("n._new"), F.lit(False))
    return j.select(*[F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in [*keys, *cols]]).select(*old.columns)


def page_with_total(df: DataFrame, order: list[Column], limit: int, offset: int = 0, cap: str | None = None) -> DataFrame:
    """A page whose rows carry `total`, the number of rows it is a page of: one count, one partial top-k."""
    return page(df, order, limit, offset, cap).withColumn("total", F.lit(df.count()))


def sum_counts(df: DataFrame, key: str, n: str = "n") -> DataFrame:
    """A keyed count with each key's share of the total."""
    total = F.lit(df.agg(F.sum(n)).first()[0])
    return df.select(key, n, total.alias("total"), F.try_divide(F.col(n), total).alias("share"))


def cached_first(pairs: DataFrame) -> DataFrame:
    """Verified answers, the most used first, then the newest; unknown counts and times lead, as in the store's own order."""
    return pairs.where("status = 'verified'").orderBy(F.desc_nulls_first("hit_count"), F.desc_nulls_first("verified_at"), "qa_id")


def by_page(fields: DataFrame) -> DataFrame:
    """(document_id, fields): a document's fields by page (none counts as 0), the most certain first."""
    key = F.struct(F.coalesce("page_no", F.lit(0)).alias("page_no"), (-F.col("confidence")).alias("c"), "field_key")
    return fields.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(key)), lambda f: f["field_key"]).alias("fields"))


def last_decisions(decisions: DataFrame, key: str, at: str = "decided_at") -> DataFrame:
    """One row a key: of several decisions on one thing the last by time counts (without a time column, the greatest), so that none multiplies rows."""
    rest = [c for c in decisions.columns if c not in (key, at)]
    order = F.struct(*([at] if at in decisions.columns else []), *rest)
    return decisions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_d")).select(key, "_d.*")
