"""Fields from pages: rules by document type, domain mentions, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.functions import values as V

# Parts of the patterns below.
_N = r"(\d[\d,]*\.?\d*)"
_VAL = r"([^\n]{3,60}?)(?=\s+[A-Z][A-Za-z]{2,}\s*:|\s{2,}|\n|$)"
_DATE = r"([0-3]?\d[./-][0-1]?\d[./-](?:19|20)\d\d)"

# Fixed values: (document type, field, kind, unit, entity, base confidence, pattern); the value is the pattern's last group.
SPECS: list[tuple[str, str, str, str | None, str | None, float, str]] = [
    ("geological_reserve_status", "proved_reserve", "number", "million_tonnes", "Reserve", 0.93, rf"proved[^\n]*?{_N}"),
    ("geological_reserve_status", "indicated_reserve", "number", "million_tonnes", "Reserve", 0.93, rf"indicated[^\n]*?{_N}"),
    ("geological_reserve_status", "inferred_reserve", "number", "million_tonnes", "Reserve", 0.93, rf"inferred[^\n]*?{_N}"),
    ("geological_reserve_status", "total_geological_reserve", "number", "million_tonnes", "Reserve", 0.9, rf"total geological reserve[^\n]*?{_N}"),
    ("geological_reserve_status", "principal_seam", "text", None, "Seam", 0.85, r"(?:principal seam|seam)\s*[:\-]?\s*([A-Z]-[IVXLC]{1,4}|Seam[-\s]?[IVXLC0-9]+)"),
    ("geological_reserve_status", "average_grade", "text", None, "Mineral", 0.85, r"(?:average grade|grade)\s*[:\-]?\s*(G-?\d{1,2})"),
    ("geological_reserve_status", "reserves_as_on", "date", None, None, 0.9, rf"reserves as on\s*[:\-]?\s*{_DATE}"),
    ("geological_reserve_status", "mine_name", "text", None, "Mine", 0.8, rf"(?:mine|colliery)\s*(?:/\s*colliery)?\s*[:\-]\s*{_VAL}"),
    ("geological_reserve_status", "block_name", "text", None, "Block", 0.8, rf"block\s*[:\-]\s*{_VAL}"),
    ("monthly_production_mis", "coal_production_target", "number", "lakh_tonnes", "ProductionFigure", 0.86, rf"coal production[^\n]*?{_N}"),
    ("monthly_production_mis", "coal_production_actual", "number", "lakh_tonnes", "ProductionFigure", 0.88, rf"coal production[^\n]*?{_N}\s+{_N}"),
    ("monthly_production_mis", "coal_production_achievement_pct", "number", "percent", None, 0.82, rf"coal production[^\n]*?{_N}\s+{_N}\s+{_N}"),
    ("monthly_production_mis", "ob_removal_actual", "number", "lakh_cubic_metre", "ProductionFigure", 0.85, rf"ob removal[^\n]*?{_N}\s+{_N}"),
    ("monthly_production_mis", "stripping_ratio", "number", "cubic_metre_per_tonne", None, 0.8, rf"stripping ratio[^\n]*?{_N}"),
    ("monthly_production_mis", "month", "date", None, None, 0.9, r"month\s*[:\-]\s*([A-Za-z]+\s+(?:19|20)\d\d)"),
    ("monthly_production_mis", "mine_name", "text", None, "Mine", 0.8, rf"mine\s*[:\-]\s*{_VAL}"),
    ("monthly_production_mis", "shortfall_reason", "text", None, None, 0.7, r"reason (?:for )?shortfall\s*[:\-]\s*([^\n]{5,140})"),
    ("parliamentary_qa_response", "question_reference", "text", None, "Inquiry", 0.9, r"((?:starred|unstarred) question no\.?\s*\d+)"),
    ("parliamentary_qa_response", "answer_date", "date", None, None, 0.9, rf"answered on\s*[:\-]?\s*{_DATE}"),
    ("parliamentary_qa_response", "subject", "text", None, None, 0.8, r"subject\s*[:\-]\s*([^\n]{5,140})"),
    ("parliamentary_qa_response", "question_topic", "text", None, None, 0.78, r"(?:subject|regarding|re)\s*[:\-]\s*([^\n]{5,140})"),
    ("parliamentary_qa_response", "cil_production", "number", "million_tonnes", "ProductionFigure", 0.85, rf"cil (?:coal )?production[^\n]*?{_N}\s*mt"),
    ("parliamentary_qa_response", "cil_target", "number", "million_tonnes", "ProductionFigure", 0.82, rf"target of\s*{_N}\s*mt"),
    ("inspection_report", "mine_name", "text", None, "Mine", 0.8, rf"mine\s*[:\-]\s*{_VAL}"),
    ("inspection_report", "inspection_date", "date", None, None, 0.85, rf"date\s*[:\-]?\s*{_DATE}"),
    ("inspection_report", "area", "text", None, None, 0.75, r"area\s*[:\-]\s*([^\n]{3,80})"),
    ("inspection_report", "finding", "text", None, None, 0.72, r"observations?\s*:?\s+1[.)]\s+([^\n]{10,150})"),
    ("inspection_report", "risk_rating", "text", None, None, 0.9, r"risk rating\s*[:\-]?\s*(high|medium|low|critical)"),
    ("inspection_report", "action_due", "date", None, None, 0.8, rf"(?:compliance|reported) by\s*{_DATE}"),
    ("borehole_log_summary", "borehole_id", "text", None, "Block", 0.9, r"borehole id\s*[:\-]?\s*(BH[-/][A-Z0-9-]+)"),
    ("borehole_log_summary", "collar_rl_m", "number", "metre", None, 0.85, rf"collar rl\s*[:\-]?\s*{_N}"),
    ("borehole_log_summary", "total_depth_m", "number", "metre", None, 0.9, rf"total depth\s*[:\-]?\s*{_N}"),
    ("borehole_log_summary", "date_completed", "date", None, None, 0.88, rf"date completed\s*[:\-]?\s*{_DATE}"),
    ("borehole_log_summary", "block_name", "text", None, "Block", 0.8, rf"block\s*[:\-]\s*{_VAL}"),
    ("borehole_log_summary", "mine_name", "text", None, "Mine", 0.7, r"block\s*[:\-]\s*([A-Z][A-Za-z]+)\s+(?:expansion|extension|incline|opencast|ocp)\b"),
    ("borehole_log_summary", "seams_intersected", "number", None, None, 0.82, rf"{_N}\s+(?:workable\s+|coal\s+)?seams?\s+(?:were\s+)?intersected"),
    ("borehole_log_summary", "core_recovery_pct", "number", "percent", None, 0.8, rf"core recovery\s*{_N}\s*%"),
    ("correspondence", "reference_no", "text", None, None, 0.75, r"no\.?\s*([A-Z]{2,6}[/-][A-Za-z0-9/\-]+)"),
    ("correspondence", "letter_date", "date", None, None, 0.7, r"(?:dt\.?|dated)\s*([0-3]?\d[-./][A-Za-z0-9]{2,9}[-./](?:19|20)?\d\d)"),
    ("correspondence", "subject", "text", None, None, 0.8, r"sub(?:ject)?\s*[:\-]\s*([^\n]{5,140})"),
    ("correspondence", "revised_value", "number", "million_tonnes", "Reserve", 0.75, rf"revised from\s*{_N}\s*mt"),
    ("correspondence", "superseded_value", "number", "million_tonnes", "Reserve", 0.6, rf"to\s*{_N}\s*mt"),
    ("correspondence", "mine_name", "text", None, "Mine", 0.62, r"\bat\s+([A-Z][a-z]+(?:\s+(?:North|South|East|West|OCP|Colliery|Extension))?)\s+(?:is|was|has|colliery|mine)"),
]
# Patterns and confidences of mentions.
SEAM = r"\b(?:Seam[-\s]?[IVXLC]+(?:\s+(?:Top|Bottom))?|[A-Z]-[IVXLC]{1,4}|Seam[-\s]?\d+)\b"
BOREHOLE = r"(?i)\bBH[-/][A-Z0-9]+(?:[-/][A-Z0-9]+)*\b"
#: Runs of capitalised words on one line, which may name an organisation.
ORG = r"\b[A-Z][A-Za-z&.]*(?:[ \t]+(?:of[ \t]+)?[A-Z][A-Za-z&.]*)+\b"
GRADE = r"\bG-?(?:1[0-7]|[1-9])\b"
SUBSIDIARIES = ["BCCL", "CCL", "CIL", "CMPDI", "ECL", "MCL", "NCL", "NEC", "SECL", "WCL"]
MENTION_CONF = {"mention_seam": 0.62, "mention_borehole_id": 0.68, "mention_grade": 0.60, "mention_subsidiary": 0.70, "mention_mine": 0.55, "mention_org": 0.50}

def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def extract_by_rules(pages: DataFrame, doc_col: str = "document_id", type_col: str = "doc_type", specs: list[tuple] | None = None) -> DataFrame:
    """One row per document and field of its type: the first page, in page order, on which the field's pattern holds.

    `pages`: document_id, doc_type, page_no, text, source_kind, words (array of text, ocr_conf, x0, y0, x1, y1). A page is searched once a rule of
    its type; everything else is read off what was found.
    """
    specs = specs or SPECS
    by_type: dict[str, list[int]] = {}
    for i, s in enumerate(specs):
        by_type.setdefault(s[0], []).append(i)
    found = None
    for kind, rules in by_type.items():
        hits = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.regexp_extract("text", f"(?i){specs[i][6]}", 0).alias("whole")) for i in rules]), lambda h: h["whole"] != "")
        found = F.when(F.col(type_col) == kind, hits) if found is None else found.when(F.col(type_col) == kind, hits)
    rows = pages.select(doc_col, "page_no", "source_kind", "text", "words", F.explode(found).alias("h")).select("*", "h.i", "h.whole").drop("h")
    # the rule's pattern and group are read by its number: a branch a rule would swell the generated code beyond what is compiled
    of_rule = lambda values: F.get(F.array(*[F.lit(v) for v in values]), F.col("i"))
    raw = F.trim(F.call_function("regexp_extract", F.col("whole"), of_rule([f"(?i){s[6]}" for s in specs]), of_rule([_groups(s[6]) for s in specs])))
    text = lambda v: F.lit(v).cast("string")
    known = F.array(*[F.struct(F.lit(s[1]).alias("field_key"), F.lit(s[2]).alias("kind"), text(s[3]).alias("unit"), text(s[4]).alias("entity_type"), F.lit(s[5]).alias("base")) for s in specs])
    rows = rows.withColumn("raw", raw).withColumn("spec", F.get(known, F.col("i")))
    kind = F.col("spec.kind")
    rows = rows.withColumn("value", F.when(kind == "number", T.to_number(F.col("raw")))).withColumn("iso", F.when(kind == "date", T.parse_date(F.col("raw")).cast("string"))).where((kind != "number") | F.col("value").isNotNull())
    shown = F.when(kind == "number", F.col("raw")).when(kind == "date", F.coalesce("iso", "raw")).otherwise(F.btrim(F.regexp_replace("raw", r"\s+", " "), F.lit(" .:-")))
    recognised = F.when(F.col("source_kind") == "ocr", V.word_confidence(F.col("words"), F.col("raw")))
    conf = V.score(F.col("spec.base"), F.col("source_kind"), recognised, F.col("whole"), F.col("raw"))
    best = F.struct(shown.alias("value_text"), "value", F.col("spec.unit").alias("unit"), "iso", F.col("spec.entity_type").alias("entity_type"), conf.alias("confidence"), T.snippet(F.col("text"), F.col("whole")).alias("source_snippet"), V.union_box(F.col("words"), F.col("raw")).alias("bbox"), "page_no", "source_kind")
    first = rows.select(doc_col, F.col("spec.field_key").alias("field_key"), best.alias("f")).groupBy(doc_col, "field_key").agg(F.min_by("f", "f.page_no").alias("f"))
    return first.select(doc_col, "field_key", "f.*", F.concat(F.lit("rule:"), F.col("field_key")).alias("extractor"))


def extract_mentions(pages: DataFrame, doc_col: str = "document_id") -> DataFrame:
    """Seams, boreholes, grades, subsidiaries, mines and organisations named on a page, each once a page whatever its case."""
    text = F.col("text")
    damp = F.when(F.col("source_kind") == "ocr", 0.8).otherwise(1.0)

    def rows(key: str, values: Column, entity: str) -> Column:
        conf = F.round(F.lit(MENTION_CONF[key]) * damp, 3)
        return F.transform(values, lambda v: F.struct(F.lit(key).alias("field_key"), v.alias("value_text"), F.lit(entity).alias("entity_type"), conf.alias("confidence")))

    every = lambda rx: F.regexp_extract_all(text, F.lit(rx), F.lit(0))
    codes = F.filter(F.array(*[F.when(T.has_word(text, c), F.lit(c)) for c in SUBSIDIARIES]), lambda x: x.isNotNull())
    lines = F.filter(F.split(text, "\n"), lambda x: T.looks_like_mine(x) & F.contains(x, F.lit(":")))
    mines = F.filter(F.transform(lines, lambda x: T.before_label(F.trim(F.regexp_extract(x, r":(.*)$", 1)))), lambda v: v != "")
    orgs = F.filter(F.transform(every(ORG), T.squeeze), T.plausible_org)
    found = F.concat(
        rows("mention_seam", every(SEAM), "Seam"), rows("mention_borehole_id", every(BOREHOLE), "Block"), rows("mention_grade", every(GRADE), "Mineral"),
        rows("mention_subsidiary", codes, "Subsidiary"), rows("mention_mine", mines, "Mine"), rows("mention_org", orgs, "Organisation"),
    )
    out = pages.select(doc_col, "page_no", "source_kind", F.posexplode(found).alias("pos", "m")).select(doc_col, "page_no", "source_kind", "pos", "m.*")
    w = Window.partitionBy(doc_col, "field_key", F.lower("value_text"), "page_no").orderBy("pos")
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n").withColumn("extractor", F.lit("gazetteer"))


def validate(fields: DataFrame, doc_col: str = "document_id", this_year: int | None = None) -> DataFrame:
    """Lower confidence and a note where a document's figures disagree: sums of reserves, dates, percentages."""
    w = Window.partitionBy(doc_col)
    # of several figures of a key the last row's counts: rules before mentions, then by page and text
    last = F.struct(F.coalesce(F.col("extractor") == "gazetteer", F.lit(False)), "page_no", "value_text")
    part = lambda k: F.max_by("value", F.when(F.col("field_key") == k, last)).over(w)
    parts = ["proved_reserve", "indicated_reserve", "inferred_reserve", "total_geological_reserve"]
    out = fields
    for k in parts:
        out = out.withColumn(f"_{k}", part(k))
    total = F.col("_total_geological_reserve")
    summed = F.col("_proved_reserve") + F.col("_indicated_reserve") + F.col("_inferred_reserve")
    off = F.coalesce(F.abs(summed - total) > F.greatest(F.lit(0.5), 0.015 * total), F.lit(False)) & F.col("field_key").isin(parts)
    year = F.substring("iso", 1, 4).cast("int")
    now = F.lit(this_year) if this_year else F.year(F.current_date())
    odd_date = F.coalesce((year < 1950) | (year > now + 1), F.lit(False))
    odd_pct = F.coalesce((F.col("unit") == "percent") & ~F.col("value").between(0, 100), F.lit(False))
    notes = F.array_compact(
        F.array(
            F.when(off, F.format_string("reserve categories sum to %.2f but total states %.2f", summed, total)),
            F.when(odd_date, F.concat(F.lit("implausible date "), F.col("iso"))),
            F.when(odd_pct, F.concat(F.lit("percentage out of range: "), F.col("value").cast("string"))),
        )
    )
    conf = F.col("confidence")
    conf = F.when(off, F.round(conf * 0.8, 3)).otherwise(conf)
    conf = F.when(odd_date, F.round(conf * 0.7, 3)).otherwise(conf)
    conf = F.when(odd_pct, F.round(conf * 0.7, 3)).otherwise(conf)
    return out.withColumn("notes", notes).withColumn("confidence", conf).drop(*[f"_{k}" for k in parts])


def extract_fields(pages: DataFrame, doc_col: str = "document_id", this_year: int | None = None) -> DataFrame:
    """Rules, then mentions of keys that no rule gave (mention_x for x), then validation and routing by confidence."""
    rules = extract_by_rules(pages, doc_col)
    mentions = extract_mentions(pages, doc_col).drop("pos")
    both = rules.unionByName(mentions, allowMissingColumns=True)
    # one pass over the union: a join would extract the rules' fields a second time
    ruled = F.max(F.col("extractor") != "gazetteer").over(Window.partitionBy(doc_col, "field_key"))
    both = both.withColumn("_ruled", ruled).where((F.col("extractor") != "gazetteer") | ~F.col("_ruled") | F.col(doc_col).isNull()).drop("_ruled")
    return validate(both, doc_col, this_year).withColumn("status", V.route(F.col("confidence")))


def document_status(fields: DataFrame, docs: DataFrame, doc_col: str = "document_id") -> DataFrame:
    """extracted without fields, needs_review while one waits, else ready."""
    n = fields.groupBy(doc_col).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "needs_review").alias("waiting"))
    state = F.when(F.coalesce("n", F.lit(0)) == 0, "extracted").when(F.col("waiting") > 0, "needs_review").otherwise("ready")
    return docs.select(doc_col).join(n, doc_col, "left").select(doc_col, state.alias("status"))
