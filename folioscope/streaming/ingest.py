"""Continuous ingest: validate, categorise, chunk, and keep bad rows aside."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from folioscope.functions.jsontext import json_sections
from folioscope.operators.chunks import chunks_of, found_errors
from folioscope.operators.routing import categorize, check_requests, media_type, suffix_of
from folioscope.rules import CHUNK_CHARS, CHUNK_OVERLAP

#: Quarantine code of valid uploads whose content, or a page of it, could not be read.
UNREADABLE = "VALIDATION_ERROR"


def prepare(uploads: DataFrame) -> DataFrame:
    """Add error_code, media type and category to (filename, process_type, size_bytes, raw)."""
    typed = check_requests(uploads).withColumn("extension", suffix_of(F.col("filename"))).withColumn(
        "mime_type", media_type(F.col("filename"))
    )
    return categorize(typed)


def upload_key(*columns: str) -> Column:
    """Digest of an upload's name, kind, size and content: a repeated name keeps an outcome of its own for each content."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def ingest_batch(batch: DataFrame, batch_id: int, out: str, quarantine: str, manifest: str,
                 max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> None:
    """Write one micro-batch: chunks, uploads set aside, and last its row in the manifest.

    Each batch owns its folders, so a repeated batch overwrites itself. An upload and its errors are one row, so
    nothing is joined; an upload with one bad page is set aside and its good pages are chunked.
    """
    good = F.col("error_code").isNull()
    keyed = prepare(batch.withColumn("upload_key", upload_key("filename", "process_type", "size_bytes", "raw")))
    own = keyed.withColumn("parsed", F.when(good, json_sections(F.when(good, F.col("raw"))))).persist()  # parsed once for both sinks
    try:
        parsed = own.where(good).withColumnRenamed("filename", "source_file")
        chunks_of(parsed, max_chars, overlap, ("upload_key",)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        detail = F.when(good, F.array_min(found_errors(F.col("parsed")))["error"])
        aside = own.withColumn("error_detail", detail).where(~good | F.col("error_detail").isNotNull())
        aside.withColumn("error_code", F.coalesce("error_code", F.lit(UNREADABLE))).drop("raw", "parsed").write.mode("overwrite").parquet(
            f"{quarantine}/batch={batch_id}")
        own.agg(F.count("*").alias("uploads"), F.count_if(~good).alias("refused")).write.mode("overwrite").parquet(f"{manifest}/batch={batch_id}")
    finally:
        own.unpersist()


def committed(spark: SparkSession, folder: str, manifest: str, schema: StructType | str) -> DataFrame:
    """Rows of a sink (of the given columns, with their ``batch``) whose batch stands in the manifest; a batch that
    ended between its sinks is not seen, and a stream without any batch so far has no rows."""
    def batches(path: str, columns: StructType) -> DataFrame:
        try:
            return spark.read.schema(columns).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], columns)

    columns = StructType.fromDDL(schema) if isinstance(schema, str) else StructType(list(schema.fields))
    whole = batches(manifest, StructType().add("uploads", "long").add("batch", "long")).select("batch").distinct()
    return batches(folder, columns.add("batch", "long")).join(whole, "batch", "left_semi")


def stream_ingest(uploads: DataFrame, out: str, quarantine: str, manifest: str, checkpoint: str,
                  max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> StreamingQuery:
    return (
        uploads.writeStream.foreachBatch(lambda b, n: ingest_batch(b, n, out, quarantine, manifest, max_chars, overlap))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
