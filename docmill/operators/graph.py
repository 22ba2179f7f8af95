"""A temporal property graph in two tables: built set-wise from accepted fields, read by joins."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docmill.functions import text as T
from docmill.functions import values as V
from docmill.sources.store import Store

ACCEPTED = ["auto_accepted", "verified"]
# Reserve fields and their categories, production fields and their metrics.
RESERVES = {
    "proved_reserve": "proved", "indicated_reserve": "indicated", "inferred_reserve": "inferred",
    "total_geological_reserve": "total", "revised_value": "revised", "superseded_value": "superseded",
}
PRODUCTION = {
    "coal_production_actual": "coal_production", "ob_removal_actual": "overburden_removal", "stripping_ratio": "stripping_ratio",
    "cil_production": "cil_coal_production", "cil_target": "cil_production_target",
}


def best_fields(fields: DataFrame) -> DataFrame:
    """One accepted row a document and key: highest confidence, then first page, then id."""
    w = Window.partitionBy("document_id", "field_key").orderBy(F.desc("confidence"), F.asc_nulls_last("page_no"), "field_id")
    return fields.where(F.col("status").isin(ACCEPTED)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def _hashed(*parts: Column | str) -> Column:
    """An id of natural keys: 128 bits, as ids are most of a graph's room and do not compress."""
    return F.left(F.sha2(F.concat_ws("\u001f", *parts), 256), F.lit(32))


def _node_id(kind: Column, key: Column, owner: Column) -> Column:
    return _hashed(kind, key, F.coalesce(owner, F.lit("\u0000")))


def _id_of(end: str) -> Column:
    """The id of an edge's end that is told as (kind, key, owner)."""
    return _node_id(*[F.col(f"{end}.{c}") for c in ("kind", "key", "owner")])


#: What an attribute map can hold.
ATTRS = ["doc_type", "doc_date", "subject", "code", "is_borehole", "grade", "commodity", "answer_date", "risk", "action_due", "category", "quantity", "unit", "as_on", "metric", "value", "period"]
KEYS = [*RESERVES, *PRODUCTION, "mine_name", "mention_mine", "block_name", "borehole_id", "mention_borehole_id", "principal_seam", "mention_seam", "average_grade", "mention_grade", "mention_subsidiary", "mention_org", "question_reference", "finding", "risk_rating", "area", "action_due", "reserves_as_on", "answer_date", "month", "subject"]


def match_unit(own: Column, code: Column, org: Column, units: list[tuple[str, str, str]]) -> Column:
    """The organisational unit (id, code, name) of a document: its own, else one of the mentioned code, else the first whose name holds, or is
    held by, the mentioned organisation. `units` is a fixed list of reference rows."""
    kind = "array<struct<id:string,code:string,name:string,by:string>>"
    if not units:
        return F.get(F.array().cast(kind), F.lit(0))
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("id", "code", "name"), u, strict=True)]) for u in units])
    low = F.lower(org)
    pick = lambda by, ok: F.get(F.transform(F.filter(rows, ok), lambda u: F.struct(u["id"].alias("id"), u["code"].alias("code"), u["name"].alias("name"), F.lit(by).alias("by"))), F.lit(0))
    return F.coalesce(
        pick("own", lambda u: u["id"] == own), pick("code", lambda u: u["code"] == F.upper(F.trim(code))),
        pick("org", lambda u: F.contains(low, F.lower(u["name"])) | F.contains(F.lower(u["name"]), low)),
    )


def build_graph(docs: DataFrame, fields: DataFrame, units: list[tuple[str, str, str]] | None = None, ends: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of all documents at once; a rerun gives the same rows. See sightings(), merge_nodes() and merge_edges().

    With `ends`, relations also have src_node and dst_node (kind, key, owner), which a join with the entities would otherwise bring.
    """
    nodes, edges = sightings(docs, fields, units)
    return merge_nodes(nodes), merge_edges(edges, ends)


def evidence(docs: DataFrame, fields: DataFrame, units: list[tuple[str, str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """sightings() with the ids of nodes and of the ends of edges, as a table that is kept and followed (follow())."""
    return tuple(evidence_ids(t) for t in sightings(docs, fields, units))


def evidence_ids(seen: DataFrame) -> DataFrame:
    """Sightings of nodes with their ids, those of edges with the ids of their ends."""
    return seen.withColumns({c: _id_of(c) for c in ("src", "dst")} if "src" in seen.columns else {"id": _node_id(F.col("kind"), F.col("key"), F.col("owner"))})


def sightings(docs: DataFrame, fields: DataFrame, units: list[tuple[str, str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what each document says, one row a sighting, from which the graph is merged and kept up to date (follow()).

    An edge's src and dst are (kind, key, owner); hashes of them come after merging, as they are long and do not compress. `alone` marks what no
    other row can share: a document's own nodes, and edges at them, where the document is one row of `docs`. These need no merging.

    `docs`: document_id, doc_type, doc_date, subsidiary_id, created_at, filename; `fields`: field_id, document_id, field_key, value_text,
    value, unit, iso, confidence, page_no, status; `units`: (id, code, name) of the known organisational units. Facts (reserves, production
    figures, findings) are a document's own nodes, named things are shared by kind, key and owner. Edges never join a node to itself.
    """
    best = best_fields(fields)
    # a map by key, which is one value a document; a pivot would hand each field to an aggregate a key
    cell = F.struct("value_text", "value", "unit", "iso", "confidence", "field_id")
    held = best.where(F.col("field_key").isin(KEYS)).groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("field_key", cell.alias("cell")))).alias("held"))
    wide = held.select("document_id", *[F.col("held")[k].alias(k) for k in KEYS])
    d = docs.select("document_id", "doc_type", F.col("doc_date").cast("date").alias("doc_date"), F.col("subsidiary_id").cast("string").alias("owner"), "created_at", "filename").join(wide, "document_id", "left")
    d = d.withColumn("as_on", F.coalesce(F.col("reserves_as_on.iso"), F.col("answer_date.iso"), F.col("doc_date").cast("string")))
    d = d.withColumn("period", F.coalesce("as_on", F.col("month.iso"))).withColumn("unit", match_unit(F.col("owner"), F.col("mention_subsidiary.value_text"), F.col("mention_org.value_text"), units or []))
    d = d.withColumn("one", F.col("document_id").isNotNull() & (F.count("*").over(Window.partitionBy("document_id")) == 1))
    null = F.lit(None).cast("string")
    nothing = F.lit(None).cast("struct<value_text:string,value:double,unit:string,iso:string,confidence:double,field_id:string>")
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names])
    attr = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v.cast("string"))])
    none = F.create_map().cast("map<string,string>")
    owner, doc = F.col("owner"), F.col("document_id").cast("string")

    def node(kind: str, key: Column, name: Column, own: Column, attrs: Column, source: Column, when: Column) -> Column:
        k = F.lit(kind)
        return F.when(when, F.struct(k.alias("kind"), key.alias("key"), T.clean_name(name).alias("name"), own.alias("owner"), attrs.alias("attrs"), F.coalesce(source["confidence"], F.lit(0.0)).alias("confidence"), source["field_id"].alias("field_id")))

    d = d.withColumn("f_sub", F.when(F.col("unit.by") == "org", F.col("mention_org")).otherwise(F.col("mention_subsidiary")))
    d = d.withColumn("f_mine", pick("mine_name", "mention_mine")).withColumn("f_hole", pick("borehole_id", "mention_borehole_id")).withColumn("f_seam", pick("principal_seam", "mention_seam")).withColumn("f_grade", pick("average_grade", "mention_grade")).withColumn("f_finding", pick("finding", "risk_rating"))
    text = lambda name: F.col(f"{name}.value_text")
    code = F.coalesce(F.col("unit.code"), F.upper(F.trim(text("f_sub"))))
    grade = F.upper(F.trim(text("f_grade")))
    period = F.col("period")
    made = {
        "report": node("report", F.concat(F.lit("report:"), doc), F.col("filename"), owner, attr(doc_type=F.col("doc_type"), doc_date=F.col("doc_date"), subject=text("subject")), nothing, F.lit(True)),
        "subsidiary": node("subsidiary", F.concat(F.lit("sub:"), code), F.coalesce(F.col("unit.name"), code), F.col("unit.id"), attr(code=code), F.col("f_sub"), code.isNotNull()),
        "mineral": node("mineral", F.concat(F.lit("mineral:coal:"), grade), F.concat(F.lit("Coal ("), grade, F.lit(")")), null, attr(grade=grade, commodity=F.lit("coal")), F.col("f_grade"), grade.isNotNull()),
        "inquiry": node("inquiry", F.concat(F.lit("inquiry:"), T.norm_key(text("question_reference"))), text("question_reference"), null, attr(answer_date=text("answer_date")), F.col("question_reference"), text("question_reference").isNotNull()),
        "finding": node("finding", F.concat(F.lit("finding:"), doc), F.coalesce(text("area"), F.lit("Inspection finding")), owner, attr(risk=text("risk_rating"), action_due=text("action_due")), F.col("f_finding"), F.col("f_finding").isNotNull()),
    }
    for name, kind, source, attrs in (("mine", "mine", "f_mine", none), ("block", "block", "block_name", none), ("hole", "block", "f_hole", attr(is_borehole=F.lit("true"))), ("seam", "seam", "f_seam", none)):
        made[name] = node(kind, T.norm_key(text(source)), text(source), owner, attrs, F.col(source), F.coalesce(T.norm_key(text(source)), F.lit("")) != "")
    for key, category in RESERVES.items():
        c = F.col(key)
        made[key] = node("reserve", F.concat(F.lit("reserve:"), doc, F.lit(f":{key}")), F.lit(f"{category.title()} reserve"), owner, attr(category=F.lit(category), quantity=c["value"], unit=F.coalesce(c["unit"], F.lit("million_tonnes")), as_on=F.col("as_on")), c, c["value"].isNotNull())
    for key, metric in PRODUCTION.items():
        c = F.col(key)
        made[key] = node("production_figure", F.concat(F.lit("prod:"), doc, F.lit(f":{key}")), F.lit(metric.replace("_", " ").title()), owner, attr(metric=F.lit(metric), value=c["value"], unit=F.coalesce(c["unit"], F.lit("")), period=period), c, c["value"].isNotNull())
    # nodes in the order in which a document's are seen
    order = ["report", "subsidiary", "mine", "block", "hole", "seam", "mineral", *RESERVES, *PRODUCTION, "inquiry", "finding"]
    d = d.select("document_id", "created_at", "as_on", "period", "one", *[F.col(f"{f}.{x}").alias(f"{f}_{x}") for f in ("f_sub", "f_mine", "f_hole", "f_seam", "f_grade", "f_finding", "block_name", "question_reference", *RESERVES, *PRODUCTION) for x in ("field_id", "confidence")], *[made[n].alias(f"n_{n}") for n in order])
    # stored, so that fields are ranked and pivoted once for nodes and edges, whatever is derived from them later
    d = Store(d.sparkSession, "evidence").write(d, "documents")
    one = d.select("document_id", "created_at", "one", F.posexplode(F.array(*[F.col(f"n_{n}") for n in order])).alias("pos", "n")).where("n is not null")
    one = one.select("document_id", "created_at", "pos", "n.*", (F.col("one") & F.col("n.kind").isin(OWN)).alias("alone"))

    end = lambda n: F.when(F.col(f"n_{n}").isNotNull(), F.struct(*[F.col(f"n_{n}.{c}").alias(c) for c in ("kind", "key", "owner")]))

    def edge(src: Column | str, dst: str, predicate: str, source: str, since: Column = null) -> Column:
        return F.struct((end(src) if isinstance(src, str) else src).alias("src"), end(dst).alias("dst"), F.lit(predicate).alias("predicate"), since.alias("valid_from"), F.col(f"{source}_field_id").alias("field_id"), F.coalesce(F.col(f"{source}_confidence"), F.lit(0.0)).alias("confidence"))

    first = lambda a, b: F.coalesce(end(a), end(b))
    # a block that is told as a hole too has its edges once
    hole = lambda e: F.when(~end("hole").eqNullSafe(end("block")), e)
    edges = [F.when(F.col("f_sub_field_id").isNotNull(), edge("report", "subsidiary", "mentions", "f_sub"))]
    edges += [edge("mine", "report", "reported_in", "f_mine"), edge("mine", "subsidiary", "located_in", "f_mine")]
    edges += [edge("block", "report", "reported_in", "block_name"), edge("block", "mine", "located_in", "block_name"), hole(edge("hole", "report", "reported_in", "f_hole")), hole(edge("hole", "mine", "located_in", "f_hole"))]
    edges += [edge("block", "seam", "contains", "f_seam"), edge("seam", "mineral", "for_mineral", "f_grade")]
    for key in RESERVES:
        edges += [edge(key, "report", "reported_in", key, F.col("as_on")), edge(first("block", "mine"), key, "has_reserve", key, F.col("as_on")), edge(key, "mineral", "for_mineral", key)]
    edges.append(edge("superseded_value", "revised_value", "supersedes", "revised_value"))
    for key in PRODUCTION:
        edges += [edge(key, "report", "reported_in", key, F.col("period")), edge(first("mine", "subsidiary"), key, "produces", key, F.col("period"))]
    edges += [edge("report", "inquiry", "responds_to", "question_reference"), edge("finding", "report", "reported_in", "f_finding"), edge("mine", "finding", "mentions", "f_finding")]
    rel = d.select("document_id", "created_at", "one", F.explode(F.array(*edges)).alias("e")).where("e.src is not null and e.dst is not null and e.src <> e.dst")
    return one, rel.select("document_id", "created_at", "e.*", (F.col("one") & (F.col("e.src.kind").isin(OWN) | F.col("e.dst.kind").isin(OWN))).alias("alone"))


#: Kinds of nodes whose keys hold their document's id.
OWN = ["report", "reserve", "production_figure", "finding"]
NODE_KEY, EDGE_KEY = ["id"], ["src", "dst", "predicate", "valid_from"]


def _split(rows: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Rows that stand alone, and those to be merged."""
    return (rows.where("alone"), rows.where(~F.col("alone"))) if "alone" in rows.columns else (None, rows)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Entities from sightings: name and provenance of the first, the highest confidence (0 where no field backs it), attributes merged in order of
    sighting, the last value of each. Sightings that are alone are passed on without a shuffle."""
    alone, rest = _split(nodes)
    at = F.struct("created_at", "document_id", "pos")
    merged = [F.max_by(F.col("attrs")[k], F.when(F.map_contains_key("attrs", k), at)).alias(f"a_{k}") for k in ATTRS]
    entities = rest.groupBy("kind", "key", "owner").agg(F.min_by("name", at).alias("name"), F.max("confidence").alias("confidence"), F.min_by("document_id", at).alias("document_id"), F.min_by(F.struct("field_id"), at).alias("f"), *merged)
    cols = ["kind", "key", "owner", "name", "confidence", "document_id"]
    entities = entities.select(*cols, F.col("f.field_id").alias("field_id"), *[f"a_{k}" for k in ATTRS])
    if alone is not None:
        entities = alone.select(*cols, "field_id", *[F.col("attrs")[k].alias(f"a_{k}") for k in ATTRS]).unionByName(entities)
    attrs = F.map_filter(F.create_map(*[x for k in ATTRS for x in (F.lit(k), F.col(f"a_{k}"))]), lambda _, v: v.isNotNull())
    return entities.select(_node_id(F.col("kind"), F.col("key"), F.col("owner")).alias("id"), "kind", "key", "owner", "name", "confidence", attrs.alias("attrs"), "document_id", "field_id")


def merge_edges(edges: DataFrame, ends: bool = False) -> DataFrame:
    """Relations from sightings: the first one's provenance, and `backing`, the documents behind it; an edge lives while one document backs it.
    Sightings that are alone are passed on without a shuffle. With `ends`, told ends are kept as src_node and dst_node."""
    alone, rest = _split(edges)
    seen = F.struct("created_at", "document_id")
    relations = rest.groupBy(*EDGE_KEY).agg(F.min_by(F.struct("document_id", "field_id", "confidence"), seen).alias("p"), F.count_distinct("document_id").alias("backing"))
    relations = relations.select(*EDGE_KEY, "p.*", "backing")
    if alone is not None:
        relations = alone.select(*EDGE_KEY, "document_id", "field_id", "confidence", F.lit(1).cast("long").alias("backing")).unionByName(relations)
    told = isinstance(edges.schema["src"].dataType, StructType)
    src, dst = (_id_of(c) if told else F.col(c) for c in ("src", "dst"))
    nodes = [F.col(c).alias(f"{c}_node") for c in ("src", "dst")] if ends else []
    relations = relations.select(src.alias("src"), dst.alias("dst"), "predicate", F.to_date("valid_from").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), "document_id", "field_id", "confidence", F.create_map().cast("map<string,string>").alias("attrs"), "backing", *nodes)
    return relations.select(*relations.columns[:10], _hashed("src", "dst", "predicate", F.coalesce(F.col("valid_from").cast("string"), F.lit(""))).alias("id"), *relations.columns[10:])


#: Keys of touched things up to which they are broadcast (hashes of 64 characters); more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def _small(keys: DataFrame) -> DataFrame:
    """The keys, broadcast if they are counted to be few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def follow(graph: tuple[DataFrame | None, DataFrame | None], stored: tuple[DataFrame | None, DataFrame | None], changed: DataFrame, docs: DataFrame, fields: DataFrame, units: list[tuple[str, str, str]] | None = None) -> tuple[tuple[DataFrame | None, DataFrame | None], tuple[DataFrame | None, DataFrame | None]]:
    """((entities, relations), (nodes, edges)) after some documents changed, went or came: equal to a new build, without building the rest anew.

    graph and stored: the graph and its evidence before; changed: document_id of all documents that differ; docs, fields: what these are now (rows of
    other documents are passed over, a document that is gone has none). Their old sightings are taken back, their new ones put in, and only the
    nodes and edges that either touches are merged again, from all documents that still back them; the rest of the graph is passed on unread by
    any shuffle. A node or edge that nothing backs any more is gone. Neither side needs the other: one that is None in both is left out. Edges may be
    those of sightings(), with relations that keep their told ends (merge_edges(ends=True)): these are known by the ends, and need no ids.
    """
    gone = changed.select("document_id").distinct()
    store = Store(docs.sparkSession, "touched")
    few = _small(store.write(gone, "documents"))
    nodes, edges = sightings(docs.join(few, "document_id", "left_semi"), fields.join(few, "document_id", "left_semi"), units)
    graph_now, stored_now = [], []
    for table, old, fresh, key, merge in zip(graph, stored, (nodes, edges), (NODE_KEY, EDGE_KEY), (merge_nodes, merge_edges), strict=True):
        if old is None:
            graph_now.append(None)
            stored_now.append(None)
            continue
        told = key is EDGE_KEY and isinstance(old.schema["src"].dataType, StructType)
        fresh = (fresh if told else evidence_ids(fresh)).select(*old.columns)
        kept = old.join(few, "document_id", "left_anti")
        now = kept.unionByName(fresh)
        # stored, as it is counted and read twice
        touched = store.write(old.join(few, "document_id", "left_semi").select(*key).union(fresh.select(*key)).distinct().select(*[F.col(k).alias(f"t_{k}") for k in key]), "keys")
        names, here = _small(touched), {"src": "src_node", "dst": "dst_node"} if told else {}
        held = lambda at: [F.col(at.get(k, k)).eqNullSafe(F.col(f"t_{k}")) for k in key]
        rows = now.join(names, held({}), "left_semi")
        again = merge(rows, ends=True) if told else merge(rows)
        same = table.withColumn("valid_from", F.col("valid_from").cast("string")) if "valid_from" in key else table
        same = same.join(names, held(here), "left_anti").select(*[F.to_date(c).alias(c) if c == "valid_from" else F.col(c) for c in table.columns])
        graph_now.append(same.unionByName(again.select(*table.columns)))
        stored_now.append(now)
    return tuple(graph_now), tuple(stored_now)


def totals_by_document(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(document_id, entities, relations): what each document was the first to bring."""
    e = entities.groupBy("document_id").agg(F.count("*").alias("entities"))
    r = relations.groupBy("document_id").agg(F.count("*").alias("relations"))
    return e.join(r, "document_id", "full_outer").na.fill(0, ["entities", "relations"])


# ---------------------------------------------------------------- reads


def search(entities: DataFrame, text: str | None = None, kind: str | None = None, principal: str | None = None, limit: int = 200) -> DataFrame:
    out = entities.where(V.equal_if_given(kind=kind)).where(V.scope(F.col("owner"), principal))
    if text:
        out = out.where(V.like_any(text, F.col("name"), F.col("key")))
    return out.orderBy("kind", "name", "id").limit(limit)


def neighbours(edges: DataFrame, vertices: DataFrame | None, of: DataFrame, predicates: list[str] | None = None, as_of: dt.date | None = None, direction: str = "both") -> DataFrame:
    """Edges at the vertices in `of` (id), each with its other end and a direction; valid on a date if one is given.

    edges: src, dst, predicate, valid_from, valid_to; vertices: id and more, or None, if the other end's id is enough.
    """
    e = edges
    if predicates:
        e = e.where(F.col("predicate").isin(predicates))
    if as_of is not None:
        e = e.where(V.valid_at(F.col("valid_from"), F.col("valid_to"), F.lit(as_of)))
    at = of.select(F.col("id").alias("at"))
    # many vertices are still few beside the edges, so they are hashed: a merge join would sort all edges in a fixed number of tasks
    at = F.broadcast(at) if at.count() <= BROADCAST_KEYS else at.hint("shuffle_hash")
    parts = []
    if direction in ("both", "out"):
        parts.append(e.join(at, e["src"] == at["at"]).withColumn("other", F.col("dst")).withColumn("direction", F.lit("out")))
    if direction in ("both", "in"):
        parts.append(e.join(at, e["dst"] == at["at"]).withColumn("other", F.col("src")).withColumn("direction", F.lit("in")))
    both = reduce(DataFrame.unionByName, parts)
    if vertices is None:
        return both.withColumnRenamed("other", "other_id")
    v = vertices.select(*[F.col(c).alias(f"other_{c}") for c in vertices.columns])
    return both.join(v, both["other"] == v["other_id"]).drop("other")


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among the vertices (id)."""
    v = vertices.select("id")
    return edges.join(v.withColumnRenamed("id", "src"), "src", "left_semi").join(v.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def touched(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Vertices at an end of any of the edges."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return vertices.join(ends, "id", "left_semi")


def hop(frontier: DataFrame, edges: DataFrame, predicate: str | None = None) -> DataFrame:
    """One step out: (origin, id) to (origin, id of the next)."""
    e = edges.where(F.col("predicate") == predicate) if predicate else edges
    return frontier.join(e.select(F.col("src").alias("id"), "dst"), "id").select("origin", F.col("dst").alias("id")).distinct()


def stats(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(what, name, n): counts by kind and predicate, with a total row (null name) each."""
    k = entities.rollup("kind").agg(F.count("*").alias("n")).select(F.lit("entity").alias("what"), F.col("kind").alias("name"), "n")
    p = relations.rollup("predicate").agg(F.count("*").alias("n")).select(F.lit("relation").alias("what"), F.col("predicate").alias("name"), "n")
    return k.unionByName(p)
