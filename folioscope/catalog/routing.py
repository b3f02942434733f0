"""Registered routing, projection and predicate queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.catalog.views import (
    DETECTIONS_SQL, LINES_SQL, REQUESTS_SQL, detections, ocr_documents, requests, table, with_sql,
)
from folioscope.functions.scores import damage_prediction, fallback_severity, region, severity, threshold_label, to_frame
from folioscope.functions.text import normalize_base_url, sanitize
from folioscope.operators import routing as ops
from folioscope.operators import telemetry as tel
from folioscope.operators.lines import confident_lines as keep_confident
from folioscope.operators.lines import flatten_lines
from folioscope.operators.quality import response_metrics as read_metrics

SUFFIX_CYCLE = (".PDF", ".jpg", ".md", ".json", ".tsv", ".docx", ".xml", ".bin", "", ".csv")


def _cycle(column: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (column % len(values) + 1).cast("int"))


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads: the url path as name, suffix and declared type by id."""
    pages = table(spark, sf_dir, "pages")
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), _cycle(F.col("page_id"), SUFFIX_CYCLE))
    return pages.select(
        "page_id", name.alias("filename"), ops.suffix_of(name).alias("extension"),
        ops.media_type(name, F.when(F.col("page_id") % 7 == 0, "text/csv").otherwise("")).alias("mime_type"),
    )


PAGE_FILES_SQL = """page_files AS (
  SELECT page_id, 'page-' || page_id || suffix AS filename, nullif(lower(suffix), '') AS extension,
         CASE WHEN page_id % 7 = 0 THEN 'text/csv' ELSE CASE lower(suffix)
           WHEN '.pdf' THEN 'application/pdf' WHEN '.jpg' THEN 'image/jpeg' WHEN '.md' THEN 'text/markdown'
           WHEN '.json' THEN 'application/json' WHEN '.tsv' THEN 'text/tab-separated-values'
           WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
           WHEN '.xml' THEN 'text/xml' WHEN '.csv' THEN 'text/csv' ELSE 'application/octet-stream' END END AS mime_type
  FROM (SELECT page_id, ['.PDF', '.jpg', '.md', '.json', '.tsv', '.docx', '.xml', '.bin', '', '.csv'][page_id % 10 + 1] AS suffix FROM pages))"""


def file_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.categorize(_page_files(spark, sf_dir)).select("page_id", "filename", "extension", "mime_type", "category", "suggested_process_type")


def media_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, mime = F.col("filename"), F.col("mime_type")
    return _page_files(spark, sf_dir).select("page_id", ops.is_pdf(name, mime).alias("is_pdf"), ops.is_image(name, mime).alias("is_image"))


def confident_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_confident(flatten_lines(ocr_documents(spark, sf_dir)), 0.5).select("doc_id", "line_index", "text", "confidence")


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, d = table(spark, sf_dir, "documents"), F.col("doc_id")
    return docs.select(
        "doc_id", F.when(d % 4 == 0, "car").when(d % 4 == 1, "mulkiya").when(d % 4 == 2, "pdf").otherwise("file").alias("process_type"),
        (d % 3 == 0).alias("is_pdf"), (d % 5 == 0).alias("skip_ocr"), (d % 7 != 0).alias("has_record"),
        ((d * 37 % 100) / 100.0).alias("card_probability"), ((d * 53 % 100) / 100.0).alias("car_confidence"),
        ((F.col("n_chars") % 100) / 100.0).alias("mean_line_confidence"),
    )


def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.route(_routed(spark, sf_dir)).select(
        "doc_id", "process_type", "confidence_score", "input_kind",
        F.coalesce("classification_label", F.lit("-")).alias("classification_label"), "note", "has_chunks",
    )


def validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    uploads = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(d % 11 != 0, F.concat(F.lit("f"), d.cast("string"))).alias("filename"),
        F.when(d % 6 == 5, "video").when(d % 2 == 0, "pdf").otherwise("file").alias("process_type"),
        (F.col("n_chars") * 10000).alias("size_bytes"),
    )
    ok, bad = ops.validate_requests(uploads)
    return ok.withColumn("error_code", F.lit("OK")).unionByName(bad).select("doc_id", "error_code")


def hitl_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("event_id") % 13 != 0, F.col("confidence"))
    return requests(spark, sf_dir).select("event_id", F.coalesce(ops.hitl(c), F.lit("none")).alias("decision"))


def threshold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("confidence")
    return requests(spark, sf_dir).select(
        "event_id", threshold_label(p, 0.65, "car", "not_car").alias("car"), threshold_label(p, 0.5, "card", "not card").alias("card"),
        damage_prediction(1.0 - p, p, 0.5).alias("damage"),
    ).select(
        "event_id", F.col("car.label").alias("car_label"), F.col("car.confidence").alias("car_confidence"),
        F.col("card.label").alias("card_label"), "damage.damage_detected", F.col("damage.confidence_score").alias("damage_confidence"),
    )


def _framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detections(spark, sf_dir).select(
        "image_id", "det_id", "score", *[to_frame(F.col(c)).alias(c) for c in ("cx", "cy", "w", "h")]
    )


def damage_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir).select(
        "image_id", "det_id", severity(F.col("w"), F.col("h")).alias("severity"), fallback_severity(F.col("score")).alias("fallback")
    )


def damage_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _framed(spark, sf_dir).select("image_id", "det_id", region(F.col("cx"), F.col("cy")).alias("region"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response payloads of six shapes, by event id: wrapped, bare, nested, textual, empty."""
    e, c = F.col("event_id"), F.col("confidence")
    body = F.struct(
        F.when(e % 6 == 0, c.cast("string")).alias("confidence_score"), F.when(e % 6 == 1, c).alias("overall_confidence"),
        F.when(e % 6 == 5, F.lit("n/a")).alias("confidence"),
        F.when(e % 6 == 2, F.struct(F.lit("card").alias("label"), c.alias("probability"))).alias("classification"),
        F.when(e % 6 == 3, F.struct((c >= 0.65).alias("is_car"), c.alias("confidence"))).alias("car_classification"),
        F.when(e % 6 == 1, c >= 0.5).alias("damage_detected"),
    )
    payload = F.when(e % 2 == 0, F.to_json(F.struct(F.lit(True).alias("success"), body.alias("data")))).otherwise(F.to_json(body))
    return requests(spark, sf_dir).withColumn("payload", payload)


RESPONSE_METRICS_SQL = """metrics AS (
  SELECT *, CASE WHEN event_id % 6 IN (0, 1, 2, 3) THEN confidence END AS confidence_score,
         CASE WHEN event_id % 6 = 2 THEN 'card' END AS classification_label,
         CASE WHEN event_id % 6 = 3 THEN confidence >= 0.65 END AS is_car,
         CASE WHEN event_id % 6 = 1 THEN confidence >= 0.5 END AS damage_detected
  FROM requests)"""


def response_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_metrics(responses(spark, sf_dir)).select(
        "event_id", F.coalesce("confidence_score", F.lit(-1.0)).alias("confidence_score"),
        F.coalesce("classification_label", F.lit("-")).alias("classification_label"),
        F.coalesce(F.col("is_car").cast("string"), F.lit("-")).alias("is_car"),
        F.coalesce(F.col("damage_detected").cast("string"), F.lit("-")).alias("damage_detected"),
    )


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tel.classify_errors(requests(spark, sf_dir))
    error = F.when(~F.col("ok"), F.struct(
        F.col("error_code").alias("code"), F.lit("request failed").alias("message"), F.col("retryable").alias("retryable"),
        F.lit(None).cast("string").alias("details")))
    rows = tel.envelope(
        e, F.struct("event_id", "confidence"), error, F.format_string("req-%d", "event_id"), F.format_string("/route/%d", "route_id"),
        F.col("elapsed_ms"), "1.0.0", F.col("ts"),
    )
    return rows.select(
        "meta.request_id", "success", F.coalesce("data.event_id", F.lit(-1)).alias("data_event_id"),
        F.coalesce("error.code", F.lit("-")).alias("error_code"), "meta.endpoint", "meta.timestamp", "meta.latency_ms",
    )


EXCEPTIONS = (
    "FileNotFoundError", "TimeoutError", "KeyError", "ValidationError", "UnsupportedMediaError", "PayloadTooLargeError",
    "ModelUnavailableError", "CircuitOpenError", "DependencyTimeoutError", "PipelineFailureError", "RuntimeError",
)


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = requests(spark, sf_dir)
    by_status = tel.classify_errors(reqs.where(~F.col("ok"))).select("event_id", F.lit("status").alias("source"), "error_code", "http_status", "retryable")
    failing = reqs.where(~F.col("ok")).withColumn(
        "exception", F.get(F.array(*[F.lit(c) for c in EXCEPTIONS]), (F.col("event_id") % len(EXCEPTIONS)).cast("int"))
    ).withColumn("code", F.when(F.col("event_id") % 23 == 0, "NOT_FOUND"))
    by_class = tel.classify_errors(failing, exception="exception", code="code").select("event_id", F.lit("exception").alias("source"), "error_code", "http_status", "retryable")
    return by_status.unionByName(by_class)


def sanitize_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", sanitize(F.concat(F.lit("/home/svc/app/run: "), "text", F.lit(" at /home/svc/.cache")), "/home/svc", "/srv").alias("message")
    )


def normalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.regexp_replace("url", "^(https?)://[^/]+/.*$", "$1://user:pw@localhost:8080/api//")
    bare = F.regexp_replace("url", "^(https?)://[^/]+/", "$1://LOCALHOST/")
    url = F.when(F.col("page_id") % 3 == 0, local).when(F.col("page_id") % 3 == 1, bare).otherwise(F.concat("url", F.lit("/")))
    return table(spark, sf_dir, "pages").select("page_id", normalize_base_url(url).alias("url"))


def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    incoming = F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("x"), F.col("event_id").cast("int") % 200))
    ids = requests(spark, sf_dir).select("event_id", incoming.alias("incoming"))
    out = ids.withColumn("request_id", tel.ensure_request_id(F.col("incoming")))
    return out.select("event_id", F.coalesce(F.col("request_id") == F.col("incoming"), F.lit(False)).alias("kept"), F.length("request_id").alias("n_chars"))


def server_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, ms = F.col("event_id"), F.col("elapsed_ms")
    headers = F.when(e % 4 == 0, F.create_map(F.lit("X-Process-Time-ms"), ms.cast("string"))).when(
        e % 4 == 1, F.create_map(F.lit("X-Process-Time-ms"), F.lit("soon"), F.lit("X-Process-Time"), (ms * 2).cast("string"))
    ).when(e % 4 == 2, F.create_map(F.lit("Date"), F.lit("today"))).otherwise(F.create_map(F.lit("X-Process-Time-MS"), F.lit("7.5")))
    return requests(spark, sf_dir).select("event_id", F.coalesce(tel.server_ms(headers), F.lit(-1.0)).alias("server_ms"))


QUERIES = {
    "file_category": file_category,
    "media_predicates": media_predicates,
    "confident_lines": confident_lines,
    "route_documents": route_documents,
    "validate_requests": validate_requests,
    "hitl_route": hitl_route,
    "threshold_label": threshold_labels,
    "damage_severity": damage_severity,
    "damage_region": damage_region,
    "response_metrics": response_metrics,
    "envelope": envelope,
    "error_taxonomy": error_taxonomy,
    "sanitize_messages": sanitize_messages,
    "normalize_urls": normalize_urls,
    "request_ids": request_ids,
    "server_time": server_time,
}

FRAMED_SQL = """framed AS (
  SELECT image_id, det_id, score, class_id, round(cx / 640, 4) AS cx, round(cy / 640, 4) AS cy, round(w / 640, 4) AS w, round(h / 640, 4) AS h
  FROM detections)"""
SEVERITY_CASE = "CASE WHEN w * h < 0.05 THEN 'minor' WHEN w * h < 0.15 THEN 'moderate' ELSE 'severe' END"
REGION_CASE = """CASE WHEN abs((cx - 0.5) / 0.5) < 0.3 AND abs((cy - 0.5) / 0.5) < 0.3 THEN 'center'
  ELSE CASE WHEN cy <= 0.5 THEN 'top' ELSE 'bottom' END || '_' || CASE WHEN cx <= 0.5 THEN 'left' ELSE 'right' END END"""
SPACE_RE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
COLLAPSED = f"trim(regexp_replace(text, '{SPACE_RE}', ' ', 'g'))"
STATUS_CASE = """CASE status_code WHEN 400 THEN 'VALIDATION_ERROR' WHEN 404 THEN 'NOT_FOUND' WHEN 413 THEN 'PAYLOAD_TOO_LARGE'
  WHEN 415 THEN 'UNSUPPORTED_MEDIA' WHEN 503 THEN 'MODEL_UNAVAILABLE' WHEN 504 THEN 'DEPENDENCY_TIMEOUT' ELSE 'INTERNAL_ERROR' END"""

ORACLES = {
    "file_category": with_sql(PAGE_FILES_SQL) + """
SELECT *, CASE category WHEN 'pdf' THEN 'pdf' WHEN 'image' THEN 'mulkiya' ELSE 'file' END AS suggested_process_type FROM (
  SELECT *, CASE WHEN mime_type = 'application/pdf' THEN 'pdf' WHEN mime_type LIKE 'image/%' THEN 'image'
    WHEN mime_type LIKE 'text/%' OR extension IN ('.md', '.xml') THEN 'text' WHEN extension = '.json' THEN 'json'
    WHEN extension IN ('.csv', '.tsv') THEN 'tabular' WHEN extension = '.docx' THEN 'archive' ELSE 'binary' END AS category
  FROM page_files)""",
    "media_predicates": with_sql(PAGE_FILES_SQL) + """
SELECT page_id, lower(filename) LIKE '%.pdf' OR mime_type = 'application/pdf' AS is_pdf,
       mime_type LIKE 'image/%' OR lower(filename) LIKE '%.jpg' AS is_image FROM page_files""",
    "confident_lines": with_sql(LINES_SQL) + f"""
SELECT doc_id, line_index, norm AS text, confidence FROM (
  SELECT *, trim(regexp_replace(nfkc, '{SPACE_RE}', ' ', 'g')) AS norm FROM (
    SELECT doc_id, line_index, confidence, nfc_normalize(text) AS nfkc FROM lines WHERE confidence >= 0.5))
WHERE norm <> ''""",
    "route_documents": """
SELECT doc_id, process_type,
       CASE process_type WHEN 'file' THEN 1.0e0 WHEN 'car' THEN (doc_id * 53 % 100) / 100.0e0 WHEN 'pdf' THEN (n_chars % 100) / 100.0e0
         ELSE CASE WHEN doc_id % 5 = 0 OR doc_id % 7 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN 0.0e0 ELSE (doc_id * 37 % 100) / 100.0e0 END
              ELSE (n_chars % 100) / 100.0e0 END END AS confidence_score,
       CASE process_type WHEN 'car' THEN 'image' WHEN 'mulkiya' THEN CASE WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'image' END ELSE process_type END AS input_kind,
       CASE WHEN process_type <> 'mulkiya' THEN '-' WHEN doc_id % 3 = 0 THEN 'unknown'
            WHEN (doc_id * 37 % 100) / 100.0e0 >= 0.5 THEN 'card' ELSE 'not card' END AS classification_label,
       CASE process_type WHEN 'file' THEN 'General file inspection executed without OCR.' WHEN 'car' THEN 'Car classification model executed.'
         WHEN 'pdf' THEN 'PDF OCR and text chunking executed.'
         ELSE CASE WHEN doc_id % 5 = 0 THEN 'Mulkiya classification executed without OCR.'
              WHEN doc_id % 7 <> 0 THEN 'Mulkiya pipeline executed with card inference and OCR extraction.'
              ELSE 'Mulkiya OCR ran but structured Mulkiya JSON was not created; returned OCR lines.' END END AS note,
       process_type IN ('file', 'pdf') OR (process_type = 'mulkiya' AND doc_id % 5 <> 0) AS has_chunks
FROM (SELECT *, ['car', 'mulkiya', 'pdf', 'file'][doc_id % 4 + 1] AS process_type FROM documents)""",
    "validate_requests": """
SELECT doc_id, CASE WHEN n_chars * 10000 > 26214400 THEN 'PAYLOAD_TOO_LARGE'
                    WHEN doc_id % 11 = 0 OR doc_id % 6 = 5 THEN 'VALIDATION_ERROR' ELSE 'OK' END AS error_code FROM documents""",
    "hitl_route": with_sql(REQUESTS_SQL) + """
SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'none' WHEN confidence >= 0.9 THEN 'auto_accept'
                      WHEN confidence < 0.6 THEN 'reject_or_reupload' ELSE 'human_review' END AS decision FROM requests""",
    "threshold_label": with_sql(REQUESTS_SQL) + """
SELECT event_id, CASE WHEN confidence >= 0.65 THEN 'car' ELSE 'not_car' END AS car_label,
       round(CASE WHEN confidence >= 0.65 THEN confidence ELSE 1 - confidence END, 4) AS car_confidence,
       CASE WHEN confidence >= 0.5 THEN 'card' ELSE 'not card' END AS card_label, confidence >= 0.5 AS damage_detected,
       round(CASE WHEN confidence >= 0.5 THEN confidence ELSE 1 - confidence END, 4) AS damage_confidence FROM requests""",
    "damage_severity": with_sql(DETECTIONS_SQL, FRAMED_SQL) + f"""
SELECT image_id, det_id, {SEVERITY_CASE} AS severity,
       CASE WHEN score >= 0.8 THEN 'severe' WHEN score >= 0.65 THEN 'moderate' ELSE 'minor' END AS fallback FROM framed""",
    "damage_region": with_sql(DETECTIONS_SQL, FRAMED_SQL) + f"SELECT image_id, det_id, {REGION_CASE} AS region FROM framed",
    "response_metrics": with_sql(REQUESTS_SQL, RESPONSE_METRICS_SQL) + """
SELECT event_id, coalesce(confidence_score, -1.0e0) AS confidence_score, coalesce(classification_label, '-') AS classification_label,
       coalesce(CAST(is_car AS VARCHAR), '-') AS is_car, coalesce(CAST(damage_detected AS VARCHAR), '-') AS damage_detected FROM metrics""",
    "envelope": with_sql(REQUESTS_SQL) + f"""
SELECT 'req-' || event_id AS request_id, ok AS success, CASE WHEN ok THEN event_id ELSE -1 END AS data_event_id,
       CASE WHEN ok THEN '-' ELSE {STATUS_CASE} END AS error_code, '/route/' || route_id AS endpoint,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, round(elapsed_ms, 2) AS latency_ms FROM requests""",
    "error_taxonomy": with_sql(REQUESTS_SQL) + f"""
SELECT event_id, 'status' AS source, {STATUS_CASE} AS error_code, status_code AS http_status, status_code IN (503, 504) AS retryable
FROM requests WHERE NOT ok
UNION ALL
SELECT event_id, 'exception', code, CASE code
         WHEN 'VALIDATION_ERROR' THEN 400 WHEN 'NOT_FOUND' THEN 404 WHEN 'PAYLOAD_TOO_LARGE' THEN 413 WHEN 'UNSUPPORTED_MEDIA' THEN 415
         WHEN 'PIPELINE_FAILURE' THEN 502 WHEN 'MODEL_UNAVAILABLE' THEN 503 WHEN 'CIRCUIT_OPEN' THEN 503 WHEN 'DEPENDENCY_TIMEOUT' THEN 504
         ELSE 500 END, code IN ('MODEL_UNAVAILABLE', 'CIRCUIT_OPEN', 'DEPENDENCY_TIMEOUT')
FROM (SELECT event_id, CASE WHEN event_id % 23 = 0 THEN 'NOT_FOUND' ELSE ['MODEL_UNAVAILABLE', 'DEPENDENCY_TIMEOUT', 'INTERNAL_ERROR',
        'VALIDATION_ERROR', 'UNSUPPORTED_MEDIA', 'PAYLOAD_TOO_LARGE', 'MODEL_UNAVAILABLE', 'CIRCUIT_OPEN', 'DEPENDENCY_TIMEOUT',
        'PIPELINE_FAILURE', 'INTERNAL_ERROR'][event_id % 11 + 1] END AS code FROM requests WHERE NOT ok) AS e""",
    "sanitize_messages": "SELECT doc_id, '~/app/run: ' || replace(replace(text, '/home/svc', '~'), '/srv', '.') || ' at ~/.cache' AS message FROM documents",
    "normalize_urls": """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN split_part(url, ':', 1) || '://user:pw@127.0.0.1:8080/api'
  WHEN 1 THEN rtrim(regexp_replace(url, '^(https?)://[^/]+/', '\\1://127.0.0.1/'), '/') ELSE rtrim(url, '/') END AS url FROM pages""",
    "request_ids": with_sql(REQUESTS_SQL) + """
SELECT event_id, event_id % 3 = 0 AND event_id % 200 BETWEEN 1 AND 128 AS kept,
       CASE WHEN event_id % 3 = 0 AND event_id % 200 BETWEEN 1 AND 128 THEN event_id % 200 ELSE 32 END AS n_chars FROM requests""",
    "server_time": with_sql(REQUESTS_SQL) + """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN elapsed_ms WHEN 1 THEN elapsed_ms * 2 WHEN 2 THEN -1.0e0 ELSE 7.5e0 END AS server_ms FROM requests""",
}
