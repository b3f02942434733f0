"""Registered aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.catalog.joins import PREDICTION_TRUTH_SQL, PRIORITY_SQL, nms_sql, prediction_truth
from folioscope.catalog.routing import STATUS_CASE
from folioscope.catalog.views import (
    CLAIM_VIEWS_SQL, DETECTIONS_SQL, LINES_SQL, PAGE_LINES_SQL, REQUESTS_SQL, claim_views, detections, ocr_documents,
    ocr_pages, requests, table, with_sql,
)
from folioscope.functions.scores import damage_prediction
from folioscope.operators import claims
from folioscope.operators import lines as ln
from folioscope.operators import quality as q
from folioscope.operators import telemetry as tel
from folioscope.operators.detections import image_detections as report_images
from folioscope.operators.routing import hitl
from folioscope.rules import HISTOGRAM_BUCKETS, NO_CAR_MESSAGE

SWEEP = (0.1, 0.25, 0.5, 0.65, 0.8, 0.95)


def mean_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = ocr_pages(spark, sf_dir)
    return ln.mean_confidence(pages).select("doc_id", F.round("mean_confidence", 6).alias("mean_confidence"), "line_count")


def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = ln.page_stats(ocr_pages(spark, sf_dir))
    return stats.select("doc_id", "page", "lines", F.round("conf_mean", 6).alias("conf_mean"), "conf_min", "conf_max")


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Scaled so that no statistic lands on a rounding tie, which engines settle differently.
    scaled = requests(spark, sf_dir).withColumn("elapsed_ms", F.col("elapsed_ms") * 1.0137)
    return q.latency_summary(scaled, ["scenario", "route_id"])


def success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.success_rate(requests(spark, sf_dir), ["scenario", "route_id"])


def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.throughput(requests(spark, sf_dir), ["route_id"]).select("route_id", "runs", F.coalesce("throughput_rps", F.lit(-1.0)).alias("throughput_rps"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = requests(spark, sf_dir).withColumn("decision", hitl(F.when(F.col("event_id") % 13 != 0, F.col("confidence"))))
    parts = [q.category_counts(reqs, c, ["scenario"]).withColumn("kind", F.lit(c)) for c in ("decision", "status_code")]
    return parts[0].unionByName(parts[1])


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    path = F.concat(F.lit("/data/"), e.cast("string"), F.lit(".bin"))
    return requests(spark, sf_dir).select(
        "scenario", e.alias("run_index"),
        F.when(e % 2 == 0, F.create_map(F.lit("front"), path, F.lit("back"), path)).otherwise(F.create_map(F.lit("file"), path)).alias("upload_files"),
        F.when(e % 2 == 0, F.create_map(F.lit("front"), F.lit("jpg"), F.lit("back"), F.lit("png"))).otherwise(F.create_map(F.lit("file"), F.lit("pdf"))).alias("sample_formats"),
    )


def first_example(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.first_example(_samples(spark, sf_dir), ["scenario"])


def format_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.format_counts(_samples(spark, sf_dir), ["scenario"])


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tel.histogram(requests(spark, sf_dir), ["route_id", "scenario"], (F.col("elapsed_ms") - 20.0) / 100.0, clamp=True)
    return h.withColumn("sum_seconds", F.round("sum_seconds", 4))


def request_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tel.request_counters(requests(spark, sf_dir), ["route_id", "scenario"])


def latest_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "error", "open").when(F.col("event_type") == "click", "half_open").when(F.col("event_type") == "view", "closed").otherwise("lost")
    return tel.latest_gauge(events, "user_id", tel.circuit_level(state), ["ts", "event_id"])


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = claims.gate_in_place(claim_views(spark, sf_dir))
    p = F.col("prob_damaged")
    return views.withColumn("_p", damage_prediction(1.0 - p, p, 0.5)).select("claim_id", "view", "is_car", "car_confidence", "_p.*")


def claim_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"))
    odd = F.when((F.col("claim_id") % 5 == 0) & (F.col("view") == "left"), F.when(F.col("claim_id") % 2 == 0, "top"))
    views = _gated(spark, sf_dir).withColumn("view", F.when((F.col("claim_id") % 5 == 0) & (F.col("view") == "left"), odd).otherwise(F.col("view")))
    views = views.withColumn("view_error", F.when(F.col("claim_id") % 11 == 0, "INFERENCE"))
    report = claims.claim_rollup(views, orders)
    return report.select(
        "claim_id", "damage_detected", "overall_confidence", "total_views_analyzed", "any_view_error",
        F.coalesce("message", F.lit("-")).alias("message"), F.size("skipped_views").alias("n_skipped"),
        F.array_join(F.transform(F.map_entries("per_view"), lambda e: F.concat_ws(
            ":", e["key"], e["value"]["damage_detected"].cast("string"), F.format_string("%.2f", e["value"]["prob_damaged"]),
            F.coalesce(e["value"]["error"], F.lit("-")))), ",").alias("views"),
    )


def priority_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.priority_view(claim_views(spark, sf_dir).where(F.col("car_prob") >= 0.65))


def readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "user_id", F.when(F.col("event_id") % 12 != 0, F.col("event_type") != "error").alias("ready"), (F.col("event_id") % 4 == 0).alias("critical"),
        F.when(F.col("value") > 480, "open").otherwise("closed").alias("state"),
    )
    return tel.readiness(events, ["user_id"])


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.confusion(prediction_truth(spark, sf_dir), 0.65)


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.threshold_sweep(prediction_truth(spark, sf_dir), SWEEP)


def error_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = tel.classify_errors(requests(spark, sf_dir))
    return tel.error_tally(reqs.withColumn("error_code", F.when(~F.col("ok"), F.col("error_code"))))


def image_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = detections(spark, sf_dir)
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"))
    report = report_images(boxes.where(F.col("score") >= 0.25), images)
    return report.select(
        "image_id", "damage_detected", "max_confidence", F.array_join(F.col("detections")["det_id"], ",").alias("kept_ids")
    )


def plate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    exact = lambda x: x.withField("confidence", F.round(x["confidence"] * 100) / 128.0)
    docs = ocr_documents(spark, sf_dir).withColumn("lines", F.transform("lines", exact))
    standard = ln.plate_text(F.col("lines"))
    zoned = F.transform("lines", lambda f, i: F.struct(
        ((i % 2) + 1).alias("zone"), (-i).cast("double").alias("x"), f["text"].alias("text"), f["confidence"].alias("confidence")))
    regional = ln.plate_text(zoned, regional=True)
    return docs.select("doc_id", standard.alias("s"), regional.alias("r")).select(
        "doc_id", F.md5("s.plate_text").alias("plate_md5"), "s.confidence", F.md5("r.plate_text").alias("regional_md5"),
        F.col("r.confidence").alias("regional_confidence"),
    )


QUERIES = {
    "mean_confidence": mean_confidence,
    "page_stats": page_stats,
    "latency_summary": latency_summary,
    "success_rate": success_rate,
    "throughput": throughput,
    "category_counts": category_counts,
    "first_example": first_example,
    "format_counts": format_counts,
    "latency_histogram": latency_histogram,
    "request_counters": request_counters,
    "latest_gauge": latest_gauge,
    "claim_rollup": claim_rollup,
    "priority_view": priority_view,
    "readiness": readiness,
    "confusion_matrix": confusion_matrix,
    "threshold_sweep": threshold_sweep,
    "error_tally": error_tally,
    "image_detections": image_detections,
    "plate_text": plate_text,
}

_P = ", ".join(f"round(quantile_cont(elapsed_ms, {p}), 2) AS {n}" for n, p in q.PERCENTILES.items())
_BUCKETS = ", ".join(f"count(*) FILTER (WHERE s <= {le}) AS le_{str(le).replace('.', '_')}" for le in HISTOGRAM_BUCKETS)
_RATES = "round(tp / nullif(tp + fp, 0), 4) AS precision, round(tp / nullif(tp + fn, 0), 4) AS recall"
_CONFUSION = """count(*) FILTER (WHERE score >= {t} AND truth) AS tp, count(*) FILTER (WHERE score < {t} AND NOT truth) AS tn,
  count(*) FILTER (WHERE score >= {t} AND NOT truth) AS fp, count(*) FILTER (WHERE score < {t} AND truth) AS fn"""

ORACLES = {
    "mean_confidence": with_sql(PAGE_LINES_SQL) + "SELECT doc_id, round(avg(confidence), 6) AS mean_confidence, count(*) AS line_count FROM page_lines GROUP BY 1",
    "page_stats": with_sql(PAGE_LINES_SQL) + """
SELECT doc_id, page, count(*) AS lines, round(avg(confidence), 6) AS conf_mean, min(confidence) AS conf_min, max(confidence) AS conf_max
FROM page_lines GROUP BY 1, 2""",
    "latency_summary": with_sql(REQUESTS_SQL) + f"""
SELECT scenario, route_id, count(*) AS n, round(min(elapsed_ms), 2) AS min, round(avg(elapsed_ms), 2) AS mean, {_P}, round(max(elapsed_ms), 2) AS max
FROM (SELECT scenario, route_id, elapsed_ms * 1.0137e0 AS elapsed_ms FROM requests) GROUP BY 1, 2""",
    "success_rate": with_sql(REQUESTS_SQL) + """
SELECT scenario, route_id, count(*) AS runs, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS failed,
       round(avg(CAST(ok AS INT)), 4) AS success_rate FROM requests GROUP BY 1, 2""",
    "throughput": with_sql(REQUESTS_SQL) + """
SELECT route_id, count(*) AS runs, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 4) AS throughput_rps FROM requests GROUP BY 1""",
    "category_counts": with_sql(REQUESTS_SQL) + """
SELECT scenario, CASE WHEN confidence >= 0.9 THEN 'auto_accept' WHEN confidence < 0.6 THEN 'reject_or_reupload' ELSE 'human_review' END AS category,
       count(*) AS n, 'decision' AS kind FROM requests WHERE event_id % 13 <> 0 GROUP BY 1, 2
UNION ALL SELECT scenario, CAST(status_code AS VARCHAR), count(*), 'status_code' FROM requests GROUP BY 1, 2""",
    "first_example": with_sql(REQUESTS_SQL) + """
SELECT scenario, field, '/data/' || min(event_id) || '.bin' AS path FROM (
  SELECT scenario, event_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['front', 'back'] ELSE ['file'] END) AS field FROM requests) GROUP BY 1, 2""",
    "format_counts": with_sql(REQUESTS_SQL) + """
SELECT scenario, format, count(*) AS n FROM (
  SELECT scenario, unnest(CASE WHEN event_id % 2 = 0 THEN ['jpg', 'png'] ELSE ['pdf'] END) AS format FROM requests) GROUP BY 1, 2""",
    "latency_histogram": with_sql(REQUESTS_SQL) + f"""
SELECT route_id, scenario, {_BUCKETS}, count(*) AS le_inf, round(sum(s), 4) AS sum_seconds, count(*) AS observations
FROM (SELECT route_id, scenario, greatest(0.0, (elapsed_ms - 20.0) / 100.0) AS s FROM requests) GROUP BY 1, 2""",
    "request_counters": with_sql(REQUESTS_SQL) + """
SELECT route_id, scenario, (status_code // 100) || 'xx' AS status_class, count(*) AS requests FROM requests GROUP BY 1, 2, 3""",
    "latest_gauge": """
SELECT user_id, CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS value FROM events GROUP BY 1""",
    "claim_rollup": with_sql(CLAIM_VIEWS_SQL) + f"""
SELECT o_orderkey AS claim_id, o_orderkey % 11 <> 0 AND coalesce(bool_or(prob_damaged >= 0.5) FILTER (WHERE car_prob >= 0.65), false) AS damage_detected,
       CASE WHEN o_orderkey % 11 = 0 THEN 0.0e0 ELSE
         round(coalesce(max(prob_damaged) FILTER (WHERE car_prob >= 0.65 AND prob_damaged >= 0.5), 0.0e0), 4) END AS overall_confidence,
       count(*) FILTER (WHERE car_prob >= 0.65) AS total_views_analyzed,
       o_orderkey % 11 = 0 AND count(*) FILTER (WHERE car_prob >= 0.65) > 0 AS any_view_error,
       CASE WHEN count(*) FILTER (WHERE car_prob >= 0.65) = 0 THEN '{NO_CAR_MESSAGE}' ELSE '-' END AS message,
       count(*) FILTER (WHERE car_prob < 0.65) AS n_skipped,
       coalesce(string_agg(view || ':' || (claim_id % 11 <> 0 AND prob_damaged >= 0.5) || ':' || printf('%.2f', prob_damaged) || ':'
         || CASE WHEN claim_id % 11 = 0 THEN 'INFERENCE' ELSE '-' END, ',' ORDER BY view) FILTER (WHERE car_prob >= 0.65), '') AS views
FROM orders LEFT JOIN (SELECT * REPLACE (CASE WHEN claim_id % 5 = 0 AND view = 'left' THEN CASE WHEN claim_id % 2 = 0 THEN 'top' ELSE 'unknown' END
  ELSE view END AS view) FROM claim_views) AS v ON o_orderkey = claim_id GROUP BY 1""",
    "priority_view": with_sql(CLAIM_VIEWS_SQL) + f"""
SELECT claim_id, arg_min(view, list_position({PRIORITY_SQL}, view)) AS source_view FROM claim_views WHERE car_prob >= 0.65 GROUP BY 1""",
    "readiness": """
SELECT user_id, bool_and((event_type <> 'error' AND event_id % 12 <> 0) OR event_id % 4 <> 0) AS ready, NOT bool_or(value > 480) AS circuits_ready,
       count(*) FILTER (WHERE event_id % 4 = 0 AND (event_type = 'error' OR event_id % 12 = 0)) AS critical_down FROM events GROUP BY 1""",
    "confusion_matrix": with_sql(PREDICTION_TRUTH_SQL) + f"SELECT *, {_RATES} FROM (SELECT {_CONFUSION.format(t=0.65)} FROM truth)",
    "threshold_sweep": with_sql(PREDICTION_TRUTH_SQL) + f"SELECT *, {_RATES} FROM (" + " UNION ALL ".join(
        f"SELECT {t}e0 AS threshold, count(*) FILTER (WHERE score >= {t}) AS detections, {_CONFUSION.format(t=t)} FROM truth" for t in SWEEP) + ")",
    "error_tally": with_sql(REQUESTS_SQL) + f"""
SELECT CASE WHEN ok THEN 'OK' ELSE {STATUS_CASE} END AS error_code, count(*) AS total, count(*) FILTER (WHERE ok) AS success,
       count(*) FILTER (WHERE NOT ok) AS failure FROM requests GROUP BY 1""",
    "image_detections": "WITH RECURSIVE " + DETECTIONS_SQL + ", boxes AS (SELECT * FROM detections WHERE score >= 0.25),\n" + nms_sql(">") + """,
best AS (SELECT image_id, max(score) AS top FROM boxes GROUP BY 1)
SELECT o_orderkey AS image_id, f.image_id IS NOT NULL AS damage_detected, coalesce(round(top, 4), 0.0e0) AS max_confidence,
       coalesce(array_to_string(list_transform(kept[1:20], lambda k: k.det_id), ','), '') AS kept_ids
FROM orders LEFT JOIN final f ON f.image_id = o_orderkey LEFT JOIN best b ON b.image_id = o_orderkey""",
    "plate_text": with_sql(LINES_SQL) + """, f AS (
  SELECT doc_id, line_index, round(confidence * 100) / 128.0e0 AS confidence, regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9]', '', 'g') AS t, (line_index - 1) % 2 + 1 AS zone FROM lines),
z AS (SELECT *, CASE WHEN zone = 1 THEN regexp_replace(t, '[^0-9]', '', 'g') ELSE regexp_replace(t, '[^A-HJ-NP-Z]', '', 'g') END AS zt FROM f)
SELECT doc_id, md5(coalesce(string_agg(t, ' ' ORDER BY line_index) FILTER (WHERE t <> ''), '')) AS plate_md5,
       round(coalesce(avg(confidence) FILTER (WHERE t <> ''), 0), 4) AS confidence,
       md5(coalesce(string_agg(zt, ' ' ORDER BY zone, -line_index) FILTER (WHERE zt <> ''), '')) AS regional_md5,
       round(coalesce(avg(confidence) FILTER (WHERE zt <> ''), 0), 4) AS regional_confidence
FROM z GROUP BY 1""",
}
