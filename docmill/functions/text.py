"""Text functions: keys, names, tokens, languages, dates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filler words that names lose when they become keys.
FILLERS = ["the", "a", "an", "ltd", "limited", "project", "colliery", "mine", "opencast", "oc", "underground"]

# Variants of one concept, by variant.
SYNONYMS = {
    "khadan": "mine", "khadaan": "mine", "colliery": "mine", "collieries": "mine", "opencast": "mine", "khan": "mine",
    "bhandar": "reserve", "reserves": "reserve", "utpadan": "production", "output": "production", "parat": "seam",
    "subsidiaries": "subsidiary", "suraksha": "safety", "conveyer": "conveyor",
}
# Romanised Hindi function words.
ROMAN_HINDI = {"aur": "and", "hai": "is", "ka": "of", "ki": "of", "ke": "of", "mein": "in", "se": "from", "ko": "to", "par": "on"}
# Words that say nothing about a topic.
STOPWORDS = [
    "coal", "india", "limited", "ltd", "report", "reporting", "statement", "note", "page", "date", "dated", "no", "sub", "subject",
    "ref", "reference", "shall", "system", "data", "government", "ministry", "lok", "sabha", "rajya", "question", "answered", "reply",
    "draft", "figures", "figure", "total", "category", "as", "on", "the", "and", "for", "with", "from", "this", "that", "was", "were",
    "are", "per", "cent", "percent", "mt", "te", "lakh", "million", "tonnes", "cum", "bccl", "ccl", "ecl", "mcl", "ncl", "secl", "wcl",
    "nec", "cmpdi", "cil", "eastern", "central", "northern", "western", "southern", "coalfields", "mahanadi", "bharat", "coking",
    "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december",
]
# Units by spelling.
UNITS = {
    "million tonnes": "million_tonnes", "mt": "million_tonnes", "lakh te": "lakh_tonnes", "lakh tonnes": "lakh_tonnes", "te": "tonnes",
    "lakh cum": "lakh_cubic_metre", "lakh cubic metre": "lakh_cubic_metre", "percent": "percent", "%": "percent", "m": "metre",
    "metre": "metre", "mtpa": "million_tonnes_per_annum", "cum/te": "cubic_metre_per_tonne",
}
# Words that tell of a mine.
MINE_WORDS = ["mine", "colliery", "opencast", "oc ", "project", "underground", "khadan"]
# Words of names of organisations.
ORG_WORDS = ["limited", "ltd", "coalfields", "colliery", "collieries", "ministry", "corporation", "cmpdi", "coal india", "department", "directorate", "authority"]

#: Word characters as the domain's patterns mean them, in Java's classes.
WORD = r"[\p{L}\p{N}_]"
TERM = r"[A-Za-zऀ-ॿ]{3,}"
# Labels and spellings of a dated line.
DATE_HINT = (
    r"(?i)(?:as on|dated?|dt\.?|answered on|date completed)\s*[:\-]?\s*"
    r"([0-3]?\d[./-][0-1]?\d[./-](?:19|20)\d\d|(?:19|20)\d\d[./-][0-1]?\d[./-][0-3]?\d|[0-3]?\d\s+[A-Za-z]{3,9}\.?\s*,?\s*(?:19|20)\d\d)"
)


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def squeeze(c: Column) -> Column:
    """White space runs as single blanks, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_key(name: Column) -> Column:
    """Key of a name: lower case, no punctuation, no filler words; a name of nothing else keeps its lower-case form."""
    bare = F.regexp_replace(F.lower(name), rf"[^\p{{L}}\p{{M}}\p{{N}}_\s-]", " ")
    bare = squeeze(F.regexp_replace(bare, rf"\b({'|'.join(FILLERS)})\b", " "))
    return F.coalesce(F.nullif(bare, F.lit("")), F.trim(F.lower(name)))


def clean_name(name: Column) -> Column:
    return F.btrim(F.regexp_replace(name, r"\s+", " "), F.lit(" .:-–"))


def normalize_question(q: Column) -> Column:
    """Lower case, no punctuation, at most 500 characters."""
    return F.left(squeeze(F.regexp_replace(F.lower(q), r"[^\p{L}\p{M}\p{N}_\s]", " ")), F.lit(500))


def concepts() -> dict[str, str]:
    """Concepts of variant words, romanised Hindi first."""
    known = {k: SYNONYMS.get(v, v) for k, v in ROMAN_HINDI.items()}
    return {k: v for k, v in SYNONYMS.items() if k not in known} | known


def canon(token: Column) -> Column:
    """A token's concept: romanised Hindi first, then variants."""
    low = F.lower(token)
    # the set tests are hashed, so the linear map lookups only run for the few variants
    both = concepts()
    return F.when(low.isin(list(both)), _lookup(both)[low]).otherwise(low)


def topic_tokens(text: Column) -> Column:
    """Runs of at least three Latin or Devanagari letters, as concepts, without stop words."""
    found = F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), canon)
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))


def normalized_text(text: Column) -> Column:
    return F.array_join(topic_tokens(text), " ")


def match_tokens(text: Column) -> Column:
    """Distinct lower-case ASCII tokens of more than two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2))


def detect_language(text: Column) -> Column:
    """en without Devanagari, hi if it is over a quarter of the word characters, else mixed."""
    dev = F.regexp_count(text, F.lit(r"[ऀ-ॿ]"))
    words = F.greatest(F.lit(1), F.regexp_count(text, F.lit(WORD)))
    return F.when(dev == 0, "en").when(dev / words > 0.25, "hi").otherwise("mixed")


DATE_FORMATS = ["d.M.yyyy", "d/M/yyyy", "d-M-yyyy", "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "d MMMM yyyy", "d MMM yyyy", "d-MMM-yyyy", "d-MMM-yy", "d.MMM.yyyy"]


def _spelt(text: Column, form: str) -> Column:
    """The day of a text in one spelling, else null. A text of another shape is not tried, as a failed parse costs a thrown exception."""
    sign = next(c for c in form if not c.isalpha())
    parts = [r"\D+" if "MMM" in p else r"[+-]?\d+" for p in form.split(sign)]
    return F.when(text.rlike("^" + f"[{sign}]".join(parts) + "$"), F.try_to_timestamp(text, F.lit(form)).cast("date"))


def parse_date(raw: Column) -> Column:
    """A day-first date in one of the known spellings, else null; "Month yyyy" is the first of the month."""
    tidy = F.initcap(squeeze(F.regexp_replace(raw, r"[.,]?\s+,?\s*", " ")))
    tidy = F.regexp_replace(tidy, r"-([a-z])", "-$1")

    def first(t: Column) -> Column:
        parts = F.split(t, "-")
        dashed = F.concat_ws("-", F.get(parts, F.lit(0)), F.initcap(F.get(parts, F.lit(1))), F.get(parts, F.lit(2)))
        tries = [_spelt(t, f) for f in DATE_FORMATS] + [_spelt(dashed, f) for f in ("d-MMM-yyyy", "d-MMM-yy")]
        return F.coalesce(*tries, *[_spelt(F.concat(F.lit("1 "), t), f) for f in ("d MMMM yyyy", "d MMM yyyy")])

    # a lambda: the tidy text is made once, and so many spellings do not swell a stage's generated code beyond what is compiled
    return F.get(F.transform(F.array(tidy), first), F.lit(0))


def detect_date(text: Column) -> Column:
    """The first labelled date of a text."""
    return parse_date(F.nullif(F.regexp_extract(text, DATE_HINT, 1), F.lit("")))


def to_number(raw: Column) -> Column:
    """Digits with thousands commas as a double, null for anything else."""
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")


def canon_unit(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.coalesce(_lookup(UNITS)[low], low)


def contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def looks_like_mine(line: Column) -> Column:
    return contains_any(line, MINE_WORDS)


def plausible_org(name: Column) -> Column:
    return (F.length(F.trim(name)) >= 6) & contains_any(name, ORG_WORDS)


def has_word(text: Column, word: str) -> Column:
    return text.rlike(rf"\b{word}\b")


def before_label(value: Column, most: int = 60) -> Column:
    """What stands before the next inline "Label :"."""
    return F.left(F.trim(F.split(value, r"\s+[A-Z][A-Za-z]{2,}\s*:")[0]), F.lit(most))


def snippet(text: Column, matched: Column, most: int = 140) -> Column:
    """The line that holds the match, else the first that holds its first token, else the match."""
    lines = F.transform(F.split(text, "\n"), F.trim)
    first = F.split(F.trim(matched), r"\s+")[0]
    hit = F.get(F.filter(lines, lambda x: F.contains(x, F.trim(matched))), F.lit(0))
    near = F.get(F.filter(lines, lambda x: (first != "") & F.contains(x, first)), F.lit(0))
    return F.left(F.coalesce(hit, near, matched), F.lit(most))


def markers(answer: Column) -> Column:
    """[n] as [[c:n]]."""
    return F.regexp_replace(answer, r"(?<!\[)\[(\d{1,2})\](?!\])", "[[c:$1]]")


def plain_markers(answer: Column) -> Column:
    """[[c:n]] as [n]."""
    return F.regexp_replace(answer, r"\[\[c:(\d+)\]\]", "[$1]")


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def runs(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of successive rows of a batch whose sizes sum to at most `most`; a larger row is a run of its own."""
    start = held = i = 0
    for i, n in enumerate(sizes, 1):
        if held and held + n > most:
            yield start, i - 1
            start, held = i - 1, 0
        held += n
    if i > start:
        yield start, i
