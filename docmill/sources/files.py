"""Files into documents and pages, and tables out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The greatest upload, suffixes by kind.
MAX_BYTES = 40 * 1024 * 1024
IMAGES = ["png", "jpg", "jpeg", "tif", "tiff", "bmp"]
SUFFIXES = ["pdf", "txt", "png", "jpg", "jpeg", "tif", "tiff"]

WORDS = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double,ocr_conf:double>>"
PAGES = f"document_id string, page_no int, width double, height double, unit string, source_kind string, text string, words {WORDS}, dpi int"


def read_files(spark: SparkSession, *paths: str, suffixes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files below the paths, or at them: document_id, filename, ext, kind, sha256, storage_key, content, length; overlong ones are
    rejected with a reason (Spark's scan itself leaves out files without a byte). Only the suffixes are taken, in any case; the default is SUFFIXES.

    Lengths come from the listing, so rejected contents are not read for the check.
    """
    any_case = lambda s: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s)
    glob = "*.{" + ",".join(any_case(s) for s in suffixes or SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(list(paths))
    name = F.element_at(F.split("path", "/"), -1)
    reason = F.when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "too large")
    ok = describe(files.where(F.col("length").between(1, MAX_BYTES)).withColumn("filename", name))
    return ok, files.where(reason.isNotNull()).select("path", "length", reason.alias("reason"))


def kind_of(content_type: Column, filename: Column) -> Column:
    """pdf, image or text, by the MIME type, else by the suffix."""
    ct, name = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(filename)
    image = F.startswith(ct, F.lit("image/")) | name.rlike(rf"\.({'|'.join(IMAGES)})$")
    return F.when(F.contains(ct, F.lit("pdf")) | F.endswith(name, F.lit(".pdf")), "pdf").when(image, "image").otherwise("text")


def describe(files: DataFrame) -> DataFrame:
    """Adds sha256, document_id, ext, kind and the content-addressed storage_key to (filename, content and, if known, content_type)."""
    ext = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    kind = kind_of(F.col("content_type") if "content_type" in files.columns else F.lit(None).cast("string"), F.col("filename"))
    x = files.withColumn("sha256", F.sha2("content", 256)).withColumn("ext", F.when(ext == "", "bin").otherwise(ext)).withColumn("kind", kind)
    return x.withColumn("document_id", F.col("sha256")).withColumn("storage_key", F.concat(F.lit("docs/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256", F.lit("."), "ext"))


def new_only(files: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Each content once, and none that is stored already."""
    once = files.dropDuplicates(["sha256"])
    return once if stored is None else once.join(stored.select("sha256"), "sha256", "left_anti")


Decoder = Callable[[str, bytes], list[dict]]


def text_decoder(kind: str, content: bytes) -> list[dict]:
    """UTF-8 with replacement, form feeds part pages. The default for all kinds: PDF and image decoders are plugged in here."""
    return [{"page_no": i, "source_kind": "text", "text": t} for i, t in enumerate(content.decode("utf-8", "replace").split("\f"), 1)]


def pages(files: DataFrame, decoder: Decoder = text_decoder) -> DataFrame:
    """Pages of every file; a file that its decoder fails on gives one empty page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, k, c in zip(b["document_id"], b["kind"], b["content"], strict=True):
                try:
                    got = decoder(k, bytes(c))
                except Exception:  # a broken file must not end the job; it shows as an empty page
                    got = [{"page_no": 1, "source_kind": "failed", "text": ""}]
                rows += [(d, p["page_no"], p.get("width"), p.get("height"), p.get("unit"), p["source_kind"], p["text"], p.get("words") or [], p.get("dpi")) for p in got]
            yield pd.DataFrame(rows, columns=["document_id", "page_no", "width", "height", "unit", "source_kind", "text", "words", "dpi"]).astype({"dpi": "Int32", "width": "float64", "height": "float64"})

    return files.select("document_id", "kind", "content").mapInPandas(run, PAGES)


#: Fixed value: fewer characters than this are no text layer.
MIN_TEXT = 20


def layered_decoder(text_layer: Decoder, recognise: Callable[[bytes, int], dict]) -> Decoder:
    """A decoder that takes a page's own text where it has MIN_TEXT characters at least and recognises the page otherwise; a page that
    recognition fails on stays empty."""

    def decode(kind: str, content: bytes) -> list[dict]:
        out = []
        for page in text_layer(kind, content):
            if len(page["text"].strip()) < MIN_TEXT:
                try:
                    page = recognise(content, page["page_no"]) | {"page_no": page["page_no"], "source_kind": "ocr"}
                except Exception:  # one page must not cost the document
                    page = page | {"text": "", "words": []}
            out.append(page)
        return out

    return decode


def with_truth(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """Expected fields (stem, key, ...) joined to the documents whose file name has that stem."""
    stem = F.regexp_replace(F.element_at(F.split("filename", "/"), -1), r"\.[^.]+$", "")
    return docs.select("document_id", stem.alias("stem")).join(truth, "stem")


def ocr_lines(words: DataFrame) -> DataFrame:
    """Page texts from recognised words (document_id, page_no, block, par, line, pos, text)."""
    line = words.groupBy("document_id", "page_no", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda w: w["text"]), " ").alias("t"))
    return line.groupBy("document_id", "page_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "line", "t"))), lambda x: x["t"]), "\n").alias("text"))


def ocr_language(wanted: str, installed: list[str]) -> str:
    """The wanted languages that are installed, else English."""
    got = [x for x in wanted.split("+") if x in installed]
    return "+".join(got) or "eng"


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(stem, key, value_text, value): expected fields of JSON files, five top-level ones and those under `fields` but note."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("stem"), F.col("value").alias("j"))
    top = F.array(*[F.struct(F.lit(k).alias("key"), F.get_json_object("j", f"$.{k}").alias("v")) for k in ("mine", "block", "as_on", "date", "reference")])
    under = F.transform(F.map_entries(F.from_json(F.get_json_object("j", "$.fields"), "map<string,string>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("v")))
    rows = raw.select("stem", F.explode(F.concat(top, F.coalesce(under, F.array().cast("array<struct<key:string,v:string>>")))).alias("e")).select("stem", "e.key", "e.v").where("v is not null and key <> 'note'")
    inner = F.get_json_object("v", "$.value")
    return rows.select("stem", "key", F.coalesce(inner, "v").alias("value_text"), F.coalesce(inner, "v").try_cast("double").alias("value"))


def one_blob(chunks: DataFrame) -> DataFrame:
    """(document_id, text, embedding): chunks joined in order, with the first one's vector."""
    return chunks.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "text"))), lambda c: c["text"]), " ").alias("text"), F.min_by("embedding", "chunk_index").alias("embedding"))


def write_text(df: DataFrame, path: str, text_col: str) -> None:
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def replace_documents(df: DataFrame, path: str, buckets: int = 256, key: str = "document_id") -> None:
    """Write whole buckets of documents anew; buckets without rows in `df` stay. Callers pass all rows of the buckets that they touch."""
    out = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def seed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Reference rows by their natural key."""
    from docmill.operators.relational import upsert

    return upsert(old, new, keys)
