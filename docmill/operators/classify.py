"""Document types by weighted keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T

# Keywords and weights by document type; ties go to the first type.
RULES: dict[str, list[tuple[str, int]]] = {
    "geological_reserve_status": [
        ("geological reserve", 5), ("reserve status", 4), ("proved", 2), ("indicated", 2), ("inferred", 2), ("geological reserve status report", 8),
        ("million tonnes", 1), ("भूवैज्ञानिक", 5), ("भंडार", 4), ("कोयला भंडार", 5), ("निक्षेप", 3), ("मिलियन टन", 1),
    ],
    "monthly_production_mis": [
        ("mis statement", 6), ("monthly production", 6), ("production / mis", 6), ("overburden", 2), ("ob removal", 2), ("target", 1),
        ("achievement", 2), ("stripping ratio", 3), ("lakh te", 2), ("मासिक उत्पादन", 6), ("उत्पादन विवरण", 6), ("लक्ष्य", 1), ("वास्तविक", 1),
        ("कोयला उत्पादन", 4), ("अधिभार", 2),
    ],
    "parliamentary_qa_response": [
        ("lok sabha", 6), ("rajya sabha", 6), ("starred question", 7), ("unstarred question", 7), ("to be answered on", 5), ("draft reply", 5),
        ("ministry of coal", 2), ("parliament", 3), ("लोक सभा", 6), ("राज्य सभा", 6), ("तारांकित प्रश्न", 7), ("अतारांकित प्रश्न", 7),
        ("कोयला मंत्रालय", 2), ("संसद", 3),
    ],
    "inspection_report": [
        ("inspection note", 6), ("safety inspection", 6), ("observations", 2), ("risk rating", 4), ("compliance", 2), ("inspection report", 6),
        ("निरीक्षण", 6), ("सुरक्षा निरीक्षण", 6), ("अवलोकन", 2), ("अनुपालन", 2),
    ],
    "borehole_log_summary": [
        ("borehole", 5), ("borehole log", 7), ("collar rl", 4), ("core recovery", 4), ("total depth", 2), ("seam", 1), ("exploration wing", 3),
        ("वेधछिद्र", 5), ("बोरहोल", 5), ("अन्वेषण", 3), ("कोर प्राप्ति", 4),
    ],
    "correspondence": [
        ("sub:", 3), ("subject:", 3), ("with reference to", 3), ("no.", 1), ("dt.", 2), ("chief geologist", 2), ("regional geologist", 2),
        ("letter", 2), ("विषय:", 3), ("संदर्भ", 2), ("पत्र", 2), ("मुख्य भूविज्ञानी", 2),
    ],
}
LEAST_SCORE = 3


def type_scores(haystack: Column, rules: dict[str, list[tuple[str, int]]] | None = None) -> dict[str, Column]:
    """Sum of the weights of the keywords that a lower-case text holds, by type."""
    out = {}
    for kind, words in (rules or RULES).items():
        total = F.lit(0)
        for w, n in words:
            total = total + F.when(F.contains(haystack, F.lit(w)), n).otherwise(0)
        out[kind] = total
    return out


def best_type(scores: dict[str, Column], least: int = LEAST_SCORE) -> Column:
    top = F.greatest(*scores.values())
    out = F.when(top < least, "unknown")
    for kind, s in scores.items():
        out = out.when(s == top, kind)
    return out


def classify(docs: DataFrame, text_col: str = "text", name_col: str | None = None) -> DataFrame:
    """Adds doc_type, language, doc_date; the file name counts as text."""
    name = F.coalesce(F.col(name_col), F.lit("")) if name_col else F.lit("")
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_hay = docs.withColumn("_hay", F.lower(F.concat(name, F.lit("\n"), text)))
    scores = type_scores(F.col("_hay"))
    with_scores = with_hay.select("*", *[s.alias(f"_s{i}") for i, s in enumerate(scores.values())])
    picked = best_type({k: F.col(f"_s{i}") for i, k in enumerate(scores)})
    out = with_scores.withColumn("doc_type", picked).withColumn("language", T.detect_language(text)).withColumn("doc_date", T.detect_date(text))
    return out.drop("_hay", *[f"_s{i}" for i in range(len(scores))])
