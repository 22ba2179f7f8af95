"""Language identification by compression: the language whose text helps most to compress a document."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import crc_mod

_LETTERS = re.compile(r"[^\W\d_]+")
#: Appended to what is compressed: without a compressible end, zstandard stores tiny texts raw, whatever the dictionary.
_TAIL = b" " * 256
#: Characters that are compressed at once: a longer frame would forget the dictionary, so that only a text's beginning counted.
SLICE = 16_384


def plain(text: str) -> str:
    """Lower-case runs of letters with single blanks; in texts of much repetition, runs of one word count once."""
    words = _LETTERS.findall(text.lower())
    if not all(map(str.isalpha, words)):  # signs of numbers (½, ②) are word characters but no letters
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    if 2 * len(set(words)) < len(words):
        words = [w for w, _ in groupby(words)]
    return f" {' '.join(words)} "


def slices(text: str, most: int | None = None) -> Iterator[str]:
    """The whole text in pieces of at most so many characters, cut before blanks where there are any."""
    most, start = most or SLICE, 0
    while len(text) - start > most:
        cut = text.rfind(" ", start + 1, start + most)
        cut = cut if cut > 0 else start + most
        yield text[start:cut]
        start = cut
    yield text[start:]


@dataclass(frozen=True)
class LangModel:
    """Raw-content dictionaries by language, and how they are used."""

    contents: dict[str, bytes]
    narrow: float = 0.01

    def coders(self) -> dict[str, zstandard.ZstdCompressor]:
        out = {}
        for lang in sorted(self.contents):
            d = zstandard.ZstdCompressionDict(self.contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(1, min_match=4, strategy=zstandard.STRATEGY_DFAST, window_log=18, hash_log=15, chain_log=15, write_content_size=False)
            out[lang] = zstandard.ZstdCompressor(dict_data=d, compression_params=p)
        return out


def learn(docs: DataFrame, fold: tuple[int, int] | None = (4, 2), dict_bytes: int = 65_536, sample_bytes: int = 524_288, most_langs: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LangModel:
    """Fit the dictionaries on a bounded sample of labelled rows.

    Bound: of each language about sample_bytes characters of whole documents, drawn by a hash of their id from all of its
    documents outside the fold (crc32(id) mod fold[0] == fold[1] is left out); documents are cut to dict_bytes characters only
    where one alone would fill a dictionary, at a place that the hash of its id sets. Documents of up to dict_bytes / 32 characters are
    drawn where there are enough of them, so that a dictionary has many authors. Whole documents go to the dictionary, up to dict_bytes bytes. Rows with a null id, text or language teach nothing; the most_langs languages of the most
    rows are learned. A language's dictionary holds equal lines once, unless that is all its text: then it is repeated to the
    length of the others, which are not cut.
    """
    src = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")).where("i is not null and t is not null and l is not null and length(t) > 0")
    if fold:
        src = src.where(crc_mod("i", fold[0]) != fold[1])
    size = F.length("t")
    usual = size <= dict_bytes // 32
    counts = src.groupBy("l").agg(F.count("*").alias("n"), F.sum(F.when(usual, size).otherwise(0)).alias("usual"), F.sum(F.least(size, F.lit(dict_bytes))).alias("chars"))
    counts = counts.orderBy(F.desc("n"), "l").limit(most_langs).collect()
    if not counts:
        return LangModel({})
    many = {r["l"]: r["usual"] >= sample_bytes for r in counts}
    share = {r["l"]: min(1.0, sample_bytes / (r["usual"] if many[r["l"]] else max(1, r["chars"]))) for r in counts}
    unit = F.pmod(F.xxhash64("i"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    of = F.create_map(*[x for k in share for x in (F.lit(k), F.struct(F.lit(share[k]).alias("share"), F.lit(many[k]).alias("usual")))])[F.col("l")]
    begin = F.when(size > dict_bytes, F.floor(F.pmod(F.xxhash64("i", F.lit(1)), size - dict_bytes)).cast("int")).otherwise(0) + 1
    drawn = src.where((unit < of["share"]) & (usual | ~of["usual"])).select("l", unit.alias("u"), "i", F.substring("t", begin, F.lit(dict_bytes)).alias("t")).collect()
    parts: dict[str, list[list[str]]] = {k: [] for k in share}
    for r in sorted(drawn, key=lambda r: (r["l"], r["u"], r["i"])):
        parts[r["l"]].append(r["t"].split("\n"))
    got = {k: dictionary(v, dict_bytes) for k, v in parts.items()}
    # dictionaries of one length, so that none helps by its size
    longest = max(map(len, got.values()))
    return LangModel({k: (v * -(-longest // len(v)))[:longest].ljust(8) for k, v in got.items() if v})


def dictionary(docs: list[list[str]], most: int) -> bytes:
    """Up to so many bytes of the documents' lines, equal lines once."""
    seen: set[str] = set()
    out, size = [], 0
    for lines in docs:
        fresh = [x for x in lines if x not in seen]
        seen.update(fresh)
        out.append(plain("\n".join(fresh)).encode("utf-8", "replace"))
        size += len(out[-1])
        if size >= most:
            break
    return b"".join(out)[:most]


def classify(texts: list[str | None], model: LangModel, coders: dict | None = None) -> list[tuple[str, float, bool]]:
    """(language, score from 0 to 1, rejected) of whole texts: sizes are summed over all slices.

    `und`, score 0, rejected for null texts and texts without a letter, or if nothing was learned. The
    score is the best language's share under weights 2 ** (-excess bytes / 2); a relative margin
    to the second language of at most `narrow` sets rejected (the best stays named); ties go to the first name.
    """
    coders = coders if coders is not None else model.coders()
    names = sorted(coders)
    out = []
    for t in texts:
        text = plain(t) if t and names else "  "
        if len(text) == 2:
            out.append(("und", 0.0, True))
            continue
        raws = [x.encode("utf-8", "replace") + _TAIL for x in slices(text)]
        size = np.array([sum(len(coders[n].compress(r)) for r in raws) for n in names], float)
        order = np.argsort(size, kind="stable")
        best, least = order[0], size[order[0]]
        second = size[order[1]] if len(names) > 1 else np.inf
        w = np.exp2(-np.minimum((size - least) * 0.5, 60))
        out.append((names[best], float(1 / w.sum()), bool(second - least <= model.narrow * least)))
    return out


def identify(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row, from the text alone; the dictionaries are bounded by learn()."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        coders = m.coders()
        for b in batches:
            got = classify([None if t is None else t for t in b["t"]], m, coders)
            yield pd.DataFrame({"id": b["i"].astype("Int64"), "lang_pred": [g[0] for g in got], "score": [g[1] for g in got], "rejected": [g[2] for g in got]}, columns=["id", "lang_pred", "score", "rejected"])

    src = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t"))
    return src.mapInPandas(run, "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
