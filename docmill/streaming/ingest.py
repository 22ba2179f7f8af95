"""New files as a stream: deduplicated by content, decoded, classified, extracted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docmill.operators.classify import classify
from docmill.operators.extract import extract_fields
from docmill.sources import files

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def ingest(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, fields) of a batch of described files."""
    pages = files.pages(batch)
    whole = pages.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))
    docs = classify(batch.select("document_id", "filename", "sha256", "storage_key").join(whole, "document_id"), "text", "filename")
    typed = pages.join(docs.select("document_id", "doc_type"), "document_id")
    return docs, extract_fields(typed)


def start(spark: SparkSession, source: str, target: str, checkpoint: str, pattern: str = "*.txt") -> StreamingQuery:
    """Read what is there and stop; rerun to go on. Batches write documents and fields as Parquet, by batch, so a retried batch replaces itself. Contents that are
    stored already, by other batches, are told by the stored hashes, so the stream keeps no state that grows with what it has seen."""
    stream = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(source)
    named = stream.where(F.col("length").between(1, files.MAX_BYTES)).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    once = files.describe(named)

    def stored(n: int) -> DataFrame | None:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/documents")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return spark.read.schema("sha256 string, batch long").parquet(f"{target}/documents").where(F.col("batch") != n)

    def write(batch: DataFrame, n: int) -> None:
        docs, fields = ingest(files.new_only(batch, stored(n)))
        docs.write.mode("overwrite").parquet(f"{target}/documents/batch={n}")
        fields.write.mode("overwrite").parquet(f"{target}/fields/batch={n}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
