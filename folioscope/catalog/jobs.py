"""Registered end-to-end jobs; each returns the table that summarises its outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.catalog.joins import nms_sql
from folioscope.catalog.ordered import pack_sql
from folioscope.catalog.records import auxiliary_cards
from folioscope.catalog.routing import COLLAPSED, REGION_CASE, SEVERITY_CASE
from folioscope.catalog.sources import CLASS_LIST, REPAIR_VALUES
from folioscope.catalog.views import (
    CLAIM_VIEWS_SQL, DETECTIONS_SQL, LINES_SQL, REQUESTS_SQL, claim_views, detections, ocr_documents, requests, table, with_sql,
)
from folioscope.operators.claims import priority_view
from folioscope.plans import jobs
from folioscope.rules import GENERAL_DAMAGE_ACTION, SERVER_TIME_HEADERS
from folioscope.session import written


def pdf_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as single-page OCR JSON: lines, confidence, chunks and errors per document.

    Every ninth document is cut off, every tenth has no lines, every eleventh a number for its lines.
    """
    # Confidences in 128ths have exact sums, so the mean does not depend on their order.
    exact = F.transform("lines", lambda x: x.withField("confidence", F.round(x["confidence"] * 100) / 128.0))
    pages = lambda lines: F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("page"), lines.alias("lines"))).alias("pages")))
    whole = pages(exact)
    k = F.col("doc_id")
    raw = F.when(k % 9 == 4, F.substring(whole, 1, 20)).when(k % 10 == 4, pages(F.slice(exact, 1, 0))).when(k % 11 == 4, pages(F.lit(5))).otherwise(whole)
    out = jobs.pdf_job(ocr_documents(spark, sf_dir).select("doc_id", raw.alias("raw")))
    n_lines = out["lines"].groupBy("doc_id").agg(F.count("*").alias("n_lines"))
    by_document = F.col("source_file").cast("bigint").alias("doc_id")
    n_chunks = out["chunks"].groupBy(by_document).agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chunk_chars"))
    n_errors = out["errors"].groupBy(by_document).agg(F.count("*").alias("n_errors"), F.min(F.coalesce("position", F.lit(0))).alias("error_at"))
    joined = out["confidence"]
    for other in (n_lines, n_chunks, n_errors):
        joined = joined.join(other, "doc_id", "left")
    return joined.select(
        "doc_id", F.round("confidence_score", 6).alias("confidence_score"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_lines", "n_chunks", "chunk_chars", "n_errors")),
        F.coalesce("error_at", F.lit(-1)).alias("error_at"))


def record_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with boxes through reading order, filter, extraction, fallback, notes and chunks."""
    def box(t, i):
        y = (i * 20).cast("double")
        return F.struct(F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(90.0).alias("x1"), (y + 12).alias("y1"), t.alias("text"), F.lit(0.9).alias("confidence"))

    cards = auxiliary_cards(spark, sf_dir)
    scanned = cards.withColumn("lines", F.reverse(F.transform("lines", box)))
    ordered = jobs.ordered_texts(scanned, "lines", 0.5, rtl=True)
    out = jobs.record_job(ordered)
    fields = out["fields"].groupBy("doc_id").agg(F.count("value").alias("n_fields"), F.count_if(F.col("value") != F.col("translation")).alias("n_translated"))
    chunks = out["chunks"].groupBy(F.col("source_file").cast("bigint").alias("doc_id")).agg(F.count("*").alias("n_chunks"))
    return out["records"].join(fields, "doc_id").join(chunks, "doc_id").select(
        "doc_id", "record.plate_number", F.coalesce("record.vin_or_chassis", F.lit("-")).alias("vin"), "record.notes", "n_fields", "n_translated", "n_chunks")


def _claim_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = F.get(F.array(F.lit("front"), F.lit("back"), F.lit("left"), F.lit("right")), F.split("det_id", "-")[0].cast("int") % 4)
    return detections(spark, sf_dir).withColumn("view", views).withColumnRenamed("image_id", "claim_id")


def _damage(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    views = claim_views(spark, sf_dir)
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))
    source = priority_view(views.where(F.col("car_prob") >= 0.65))
    plates = source.select("claim_id", "source_view", F.lit(True).alias("detected"), F.concat(F.lit("P"), F.col("claim_id").cast("string")).alias("plate_text"), F.lit(0.9).alias("confidence"))
    return jobs.damage_job(views, _claim_boxes(spark, sf_dir), claims, plates)


def damage_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damage(spark, sf_dir)["damages"].select(
        "claim_id", "view", "type", "severity", "confidence", "region", F.array_join(F.transform("bbox", lambda b: F.format_string("%.4f", b)), ",").alias("bbox"),
        F.size("parts_at_risk").alias("n_parts"), "repair_action", "replace")


def damage_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _damage(spark, sf_dir)["report"].select(
        "claim_id", "damage_detected", "overall_confidence", "total_views_analyzed", "plate.plate_text",
        F.coalesce("plate.source_view", F.lit("-")).alias("source_view"))


def damage_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view of the damage job as its report shows it; a ninth of the claims have a failed batch on every second view."""
    views = claim_views(spark, sf_dir)
    failed = (F.col("claim_id") % 9 == 2) & F.col("view").isin("front", "left")
    views = views.withColumn("view_error", F.when(failed, F.lit("INFERENCE: batch failed")))
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))
    report = jobs.damage_job(views, _claim_boxes(spark, sf_dir), claims)["report"]
    # Both kinds of views leave the report in one list: two reads of the report would run the job twice.
    shown = lambda e, state, damaged, score, n, error: F.struct(
        e["key"].alias("view"), F.lit(state).alias("state"), damaged.alias("view_damaged"), score.alias("score"), n.alias("n_damages"), error.alias("error"))
    seen = F.transform(F.map_entries("per_view"), lambda e: shown(
        e, "analysed", e["value"]["damage_detected"], F.round(e["value"]["confidence_score"], 4), F.size(e["value"]["damages"]), F.coalesce(e["value"]["error"], F.lit("-"))))
    skipped = F.transform(F.map_entries("skipped_views"), lambda e: shown(
        e, "not_a_car", F.lit(False), e["value"]["car_confidence"], F.lit(0), F.lit("-")).withField("state", e["value"]["reason"]))
    views = report.select("claim_id", "damage_detected", "any_view_error", F.explode_outer(F.concat(seen, skipped)).alias("v"))
    return views.where(F.col("v").isNotNull()).select("claim_id", "damage_detected", "any_view_error", "v.*")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark samples per scenario: rates, latency, server time, decisions, status codes, errors and identity lines."""
    e = F.col("event_id")
    line = lambda t: F.struct(t.alias("text"))
    shown = F.when(e % 7 == 0, F.array(line(F.lit("Name: A B")), line(F.format_string("1234 5678 %04d", e % 10000)), line(F.lit("DOB: 01/02/1990")))).when(
        e % 7 == 1, F.array(line(F.lit("plain line"))))
    body = F.struct(F.when(e % 6 < 4, F.col("confidence")).alias("confidence_score"), F.struct(shown.alias("lines")).alias("raw_ocr"))
    samples = requests(spark, sf_dir).select(
        "scenario", "ts", "event_id", "ok", "status_code", (F.col("elapsed_ms") * 1.0137).alias("elapsed_ms"),
        F.when(~F.col("ok"), F.concat(F.lit("HTTP "), F.col("status_code").cast("string"))).alias("error"),
        F.when(e % 3 != 0, F.create_map(F.lit(SERVER_TIME_HEADERS[1]), (F.col("elapsed_ms") * 0.503).cast("string"))).alias("headers"),
        F.to_json(F.struct(body["confidence_score"].alias("confidence_score"), body["raw_ocr"].alias("raw_ocr"))).alias("payload"))
    out = jobs.quality_job(samples, ["scenario"], ["ts", "event_id"], warmup=10, headers="headers")

    def wide(name: str, values: dict[str, str]) -> DataFrame:
        return out[name].groupBy("scenario").agg(*(
            F.coalesce(F.sum(F.when(F.col("category") == v, F.col("n"))), F.lit(0)).alias(c) for v, c in values.items()))

    joined = out["success"].join(out["latency"].select("scenario", "p50", "p95", "max"), "scenario")
    for other in (
        out["server"].select("scenario", F.col("p50").alias("server_p50"), F.col("max").alias("server_max"), F.col("n").alias("n_server")),
        out["confidence"].select("scenario", F.col("n").alias("n_scored")),
        wide("decisions", {d: d for d in ("auto_accept", "human_review", "reject_or_reupload")}),
        wide("status_codes", {c: f"status_{c}" for c in ("200", "415", "503", "504")}),
        wide("errors", {f"HTTP {c}": f"errors_{c}" for c in ("415", "503", "504")}), out["identity"],
    ):
        joined = joined.join(other, "scenario", "left")
    return joined.select(*(F.coalesce(c, F.lit(0)).alias(c) if c.startswith("errors_") else F.col(c) for c in joined.columns))


def file_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as files of every category, by id: (path, length, content)."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ("txt", "json", "csv", "tsv", "zip", "bin", "pdf", "md", "json", "xml"))), (k % 10).cast("int"))
    body = (
        F.when(kind == "json", F.when(k % 20 == 8, F.substring("text", 1, 40)).otherwise(F.to_json(F.struct("doc_id", "lang", F.array("source").alias("tags")))))
        .when(kind == "csv", F.concat(F.lit("id,lang\n"), k.cast("string"), F.lit(",\""), F.col("lang"), F.lit("\nx\"\n")))
        .when(kind == "tsv", F.concat(k.cast("string"), F.lit("\t"), F.col("lang")))
        .when(kind == "bin", F.concat(F.lit("\x01\x02"), F.col("lang"))).otherwise(F.col("text")))
    content = F.when(kind == "zip", F.unhex(F.concat(F.lit("504B0506"), F.lit("00" * 18)))).otherwise(F.encode(body, "utf-8"))
    return docs.select(F.concat(F.lit("/up/"), k.cast("string"), F.lit("."), kind).alias("path"), content.alias("content")).withColumn(
        "length", F.octet_length("content").cast("bigint")).withColumn(
        "declared_type", F.when(F.col("path").endswith(".csv") | F.col("path").endswith(".tsv"), "application/vnd.ms-excel"))


def file_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every output of the file inspection, a row for each file and output: what it is, and the figures it has there."""
    out = jobs.file_job(written(file_rows(spark, sf_dir), "uploads"))
    parts = [
        out["inventory"].select("path", F.lit("inventory").alias("output"), F.concat_ws("|", "category", "mime_type", "suggested_process_type").alias("value"), F.col("size_bytes").alias("n")),
        out["text"].select("path", F.lit("text"), F.concat_ws("|", "encoding_used", F.sha2("text_preview", 256)), F.col("line_count_preview")),
        out["json"].select("path", F.lit("json"), F.concat_ws("|", F.coalesce("top_level_type", F.lit("-")), F.array_join(F.coalesce("top_level_keys", F.array().cast("array<string>")), ",")), F.when(F.col("json_error").isNull(), 0).otherwise(1)),
        out["tables"].select("path", F.lit("table"), F.array_join(F.flatten("preview_rows"), "|"), F.size("preview_rows")),
        out["archives"].select("path", F.lit("archive"), F.array_join("archive_entries", "|"), F.size("archive_entries")),
        out["chunks"].select("source_file", F.lit("chunk"), F.col("text"), F.col("metadata.chunk_index")),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole.select("path", "output", "value", F.col("n").cast("bigint").alias("n"))


QUERIES = {
    "pdf_job": pdf_job,
    "record_job": record_job,
    "damage_job": damage_job,
    "damage_reports": damage_reports,
    "damage_views": damage_views,
    "quality_report": quality_report,
    "file_job": file_job,
}

_P = ", ".join(f"round(quantile_cont(ms, {p}), 2) AS {n}" for n, p in (("p50", 0.5), ("p95", 0.95)))

ORACLES = {
    "pdf_job": "WITH RECURSIVE " + LINES_SQL + f""", tidy AS (SELECT doc_id, line_index, {COLLAPSED} AS text FROM lines),
sized AS (SELECT doc_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS i, text FROM tidy WHERE text <> ''),
""" + pack_sql(1200, 3) + """,
sizes AS (SELECT key, len(chunks) AS n_chunks, CAST(list_sum(list_transform(chunks, lambda c: length(c))) AS BIGINT) AS chunk_chars FROM packed),
shape AS (SELECT doc_id, CASE WHEN doc_id % 9 = 4 THEN 'cut' WHEN doc_id % 10 = 4 THEN 'none' WHEN doc_id % 11 = 4 THEN 'bad' ELSE 'whole' END AS kind FROM documents)
SELECT doc_id, CASE WHEN any_value(kind) = 'whole' THEN round(avg(round(confidence * 100) / 128.0e0), 6) ELSE 0.0e0 END AS confidence_score,
       CASE WHEN any_value(kind) = 'whole' THEN count(*) ELSE 0 END AS n_lines, CASE WHEN any_value(kind) = 'whole' THEN any_value(n_chunks) ELSE 0 END AS n_chunks,
       CASE WHEN any_value(kind) = 'whole' THEN any_value(chunk_chars) ELSE 0 END AS chunk_chars,
       CASE WHEN any_value(kind) IN ('cut', 'bad') THEN 1 ELSE 0 END AS n_errors,
       CASE any_value(kind) WHEN 'cut' THEN 0 WHEN 'bad' THEN 1 ELSE -1 END AS error_at
FROM lines JOIN shape USING (doc_id) LEFT JOIN sizes ON key = doc_id GROUP BY 1""",
    "damage_job": "WITH RECURSIVE " + CLAIM_VIEWS_SQL + ", " + DETECTIONS_SQL + f""",
good AS (SELECT * FROM claim_views WHERE car_prob >= 0.65 AND prob_damaged >= 0.5),
boxes AS (SELECT (d.image_id, g.view) AS image_id, det_id, cx, cy, w, h, class_id, score FROM detections d JOIN good g
          ON g.claim_id = d.image_id AND g.view = ['front', 'back', 'left', 'right'][CAST(split_part(det_id, '-', 1) AS INT) % 4 + 1] WHERE score >= 0.5),
""" + nms_sql() + f""",
survivors AS (SELECT b.* FROM boxes b JOIN (SELECT image_id AS im, unnest(kept) AS k FROM final) f ON f.im = b.image_id AND f.k.det_id = b.det_id),
framed AS (SELECT image_id, det_id, score, class_id, round(cx / 640, 4) AS cx, round(cy / 640, 4) AS cy, round(w / 640, 4) AS w, round(h / 640, 4) AS h FROM survivors),
typed AS (SELECT image_id, score, printf('%.4f,%.4f,%.4f,%.4f', cx, cy, w, h) AS bbox, {CLASS_LIST}[class_id + 1] AS type, {SEVERITY_CASE} AS severity, {REGION_CASE} AS region FROM framed)
SELECT image_id[1] AS claim_id, image_id[2] AS view, t.type, t.severity, round(score, 4) AS confidence, region, bbox,
       CASE WHEN type = 'scratches' AND region = 'center' THEN 1 WHEN type = 'scratches' OR (type = 'lamp-crack' AND region = 'center') THEN 2 ELSE 3 END AS n_parts,
       r.c AS repair_action, r.d AS replace
FROM typed t JOIN {REPAIR_VALUES} r(a, b, c, d) ON t.type = r.a AND t.severity = r.b
UNION ALL
SELECT claim_id, view, 'general-damage', CASE WHEN prob_damaged >= 0.8 THEN 'severe' WHEN prob_damaged >= 0.65 THEN 'moderate' ELSE 'minor' END,
       round(prob_damaged, 4), 'unknown', '0.5000,0.5000,1.0000,1.0000', 1, '{GENERAL_DAMAGE_ACTION}', false
FROM good g WHERE NOT EXISTS (SELECT 1 FROM survivors s WHERE s.image_id = (g.claim_id, g.view))""",
    "damage_reports": with_sql(CLAIM_VIEWS_SQL) + """
SELECT o_orderkey AS claim_id, coalesce(bool_or(prob_damaged >= 0.5) FILTER (WHERE car_prob >= 0.65), false) AS damage_detected,
       round(coalesce(max(prob_damaged) FILTER (WHERE car_prob >= 0.65 AND prob_damaged >= 0.5), 0.0e0), 4) AS overall_confidence,
       count(*) FILTER (WHERE car_prob >= 0.65) AS total_views_analyzed,
       CASE WHEN count(*) FILTER (WHERE car_prob >= 0.65) > 0 THEN 'P' || o_orderkey ELSE '' END AS plate_text,
       coalesce(arg_min(view, list_position(['front', 'back', 'left', 'right'], view)) FILTER (WHERE car_prob >= 0.65), '-') AS source_view
FROM orders LEFT JOIN claim_views ON o_orderkey = claim_id GROUP BY 1""",
    "damage_views": "WITH RECURSIVE " + CLAIM_VIEWS_SQL + ", " + DETECTIONS_SQL + f""",
marked AS (SELECT *, CASE WHEN claim_id % 9 = 2 AND view IN ('front', 'left') THEN 'INFERENCE: batch failed' END AS view_error FROM claim_views),
good AS (SELECT * FROM marked WHERE car_prob >= 0.65 AND prob_damaged >= 0.5 AND view_error IS NULL),
boxes AS (SELECT (d.image_id, g.view) AS image_id, det_id, cx, cy, w, h, class_id, score FROM detections d JOIN good g
          ON g.claim_id = d.image_id AND g.view = ['front', 'back', 'left', 'right'][CAST(split_part(det_id, '-', 1) AS INT) % 4 + 1] WHERE score >= 0.5),
""" + nms_sql() + """,
found AS (SELECT image_id, len(kept) AS n FROM final)
SELECT m.claim_id, coalesce(bool_or(car_prob >= 0.65 AND prob_damaged >= 0.5 AND view_error IS NULL) OVER (PARTITION BY m.claim_id), false) AS damage_detected,
       bool_or(car_prob >= 0.65 AND view_error IS NOT NULL) OVER (PARTITION BY m.claim_id) AS any_view_error, m.view,
       CASE WHEN car_prob >= 0.65 THEN 'analysed' ELSE 'not_a_car' END AS state, car_prob >= 0.65 AND prob_damaged >= 0.5 AND view_error IS NULL AS view_damaged,
       CASE WHEN car_prob < 0.65 THEN round(1.0 - car_prob, 4) ELSE round(greatest(prob_damaged, 1.0 - prob_damaged), 4) END AS score,
       CASE WHEN car_prob >= 0.65 AND prob_damaged >= 0.5 AND view_error IS NULL THEN coalesce(n, 1) ELSE 0 END AS n_damages,
       CASE WHEN car_prob >= 0.65 THEN coalesce(view_error, '-') ELSE '-' END AS error
FROM marked m LEFT JOIN found f ON f.image_id = (m.claim_id, m.view)""",
    "quality_report": with_sql(REQUESTS_SQL) + f"""
SELECT scenario, count(*) AS runs, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed, round(avg(CAST(ok AS INT)), 4) AS success_rate,
       {_P}, round(max(ms), 2) AS max, round(quantile_cont(server, 0.5), 2) AS server_p50, round(max(server), 2) AS server_max, count(server) AS n_server,
       count(score) AS n_scored, count(*) FILTER (WHERE score >= 0.9) AS auto_accept,
       count(*) FILTER (WHERE score >= 0.6 AND score < 0.9) AS human_review, count(*) FILTER (WHERE score < 0.6) AS reject_or_reupload,
       {", ".join(f"count(*) FILTER (WHERE status_code = {c}) AS status_{c}" for c in (200, 415, 503, 504))},
       {", ".join(f"count(*) FILTER (WHERE status_code = {c}) AS errors_{c}" for c in (415, 503, 504))},
       count(*) FILTER (WHERE event_id % 7 < 2) AS with_lines, 3 * count(*) FILTER (WHERE event_id % 7 = 0) + count(*) FILTER (WHERE event_id % 7 = 1) AS ocr_lines,
       count(*) FILTER (WHERE event_id % 7 = 0) AS identity_found, 2 * count(*) FILTER (WHERE event_id % 7 = 0) AS identity_fields
FROM (SELECT *, elapsed_ms * 1.0137e0 AS ms, CASE WHEN event_id % 3 <> 0 THEN elapsed_ms * 0.503e0 END AS server, CASE WHEN event_id % 6 < 4 THEN confidence END AS score
      FROM requests QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY ts, event_id) > 10) GROUP BY 1""",
    "file_job": """
WITH up AS (
  SELECT doc_id, lang, source, text, ['txt', 'json', 'csv', 'tsv', 'zip', 'bin', 'pdf', 'md', 'json', 'xml'][doc_id % 10 + 1] AS kind FROM documents),
body AS (
  SELECT *, '/up/' || doc_id || '.' || kind AS path, CASE
    WHEN kind = 'json' AND doc_id % 20 = 8 THEN left(text, 40)
    WHEN kind = 'json' THEN '{"doc_id":' || doc_id || ',"lang":"' || lang || '","tags":["' || source || '"]}'
    WHEN kind = 'csv' THEN 'id,lang' || chr(10) || doc_id || ',"' || lang || chr(10) || 'x"' || chr(10)
    WHEN kind = 'tsv' THEN doc_id || chr(9) || lang WHEN kind = 'bin' THEN chr(1) || chr(2) || lang ELSE text END AS content FROM up),
typed AS (
  SELECT *, CASE WHEN kind IN ('txt', 'md', 'xml') THEN 'text' WHEN kind = 'json' THEN 'json' WHEN kind IN ('csv', 'tsv') THEN 'tabular'
              WHEN kind = 'zip' THEN 'archive' WHEN kind = 'pdf' THEN 'pdf' ELSE 'binary' END AS category,
         CASE kind WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'xml' THEN 'text/xml' WHEN 'json' THEN 'application/json'
              WHEN 'zip' THEN 'application/zip' WHEN 'pdf' THEN 'application/pdf' WHEN 'bin' THEN 'application/octet-stream' ELSE 'application/vnd.ms-excel' END AS mime,
         CASE WHEN kind = 'pdf' THEN 'pdf' ELSE 'file' END AS process, CASE WHEN kind = 'zip' THEN 22 ELSE strlen(content) END AS size,
         left(content, 4000) AS preview FROM body)
SELECT path, 'inventory' AS output, category || '|' || mime || '|' || process AS value, size AS n FROM typed
UNION ALL SELECT path, 'text', 'utf-8|' || sha256(preview), len(string_split(rtrim(preview, chr(10)), chr(10))) FROM typed WHERE category = 'text'
UNION ALL SELECT path, 'json', CASE WHEN doc_id % 20 = 8 THEN '-|' ELSE 'dict|doc_id,lang,tags' END, CAST(doc_id % 20 = 8 AS INT) FROM typed WHERE category = 'json'
UNION ALL SELECT path, 'table', CASE kind WHEN 'csv' THEN 'id|lang|' || doc_id || '|' || lang || chr(10) || 'x' ELSE doc_id || '|' || lang END,
                 CASE kind WHEN 'csv' THEN 2 ELSE 1 END FROM typed WHERE category = 'tabular'
UNION ALL SELECT path, 'archive', '', 0 FROM typed WHERE category = 'archive'
UNION ALL SELECT replace(path, '/up/', ''), 'chunk', 'filename: ' || replace(path, '/up/', '') || chr(10) || 'mime_type: ' || mime || chr(10) || 'extension: .' || kind
                 || chr(10) || 'size_bytes: ' || size || chr(10) || 'category: ' || category || chr(10) || 'suggested_process_type: ' || process, 1 FROM typed""",
}
