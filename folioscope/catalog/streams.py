"""Registered streaming, scoring and fault-tolerance queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.catalog.ordered import pack_sql
from folioscope.catalog.routing import COLLAPSED
from folioscope.catalog.views import CLAIM_VIEWS_SQL, LINES_SQL, REQUESTS_SQL, as_requests, claim_views, requests, table, with_sql
from folioscope.functions.scores import damage_prediction
from folioscope.functions.scoring import batch_score as score_batches
from folioscope.functions.scoring import best_effort_batch
from folioscope.operators.claims import fallback_damage as general_damage
from folioscope.rules import GENERAL_DAMAGE_ACTION, HISTOGRAM_BUCKETS
from folioscope.session import scratch_path, short_batches
from folioscope.streaming import breaker as br
from folioscope.streaming import metrics as mt
from folioscope.streaming.ingest import committed
from folioscope.streaming.ingest import stream_ingest as ingest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream, be it one file or a folder of files: a pattern takes either, a plain path only a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _timed(events: DataFrame) -> DataFrame:
    reqs = as_requests(events)
    return reqs.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("seconds", F.col("elapsed_ms") / 100.0)


def _metric_columns(df: DataFrame) -> DataFrame:
    epoch = [F.unix_seconds(c).alias(c) for c in ("window_start", "window_end")]
    keep = [c for c in df.columns if c not in ("window_start", "window_end", "sum_seconds")]
    return df.select(*epoch, *keep, F.round("sum_seconds", 4).alias("sum_seconds"))


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = scratch_path(spark, "metrics"), scratch_path(spark, "metrics-checkpoint")
    metrics = mt.stream_metrics(_timed(_event_stream(spark, sf_dir)), ["route_id"], "6 hours", "10 minutes")
    mt.start_metrics(metrics, out, checkpoint).awaitTermination()
    return _metric_columns(spark.read.schema(metrics.schema).parquet(out))


def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metric_columns(mt.stream_metrics(_timed(table(spark, sf_dir, "events")), ["route_id"], "6 hours"))


def call_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("circuit"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("call_id"),
        (F.col("event_type") != "error").alias("ok"), ((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)).alias("ignored"),
    )


def breaker_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = br.breaker_states(call_log(table(spark, sf_dir, "events")), failures=2, recovery_seconds=14400.0, block_seconds=7 * 86_400)
    return states.select("circuit", "call_id", "admitted", "state")


def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = scratch_path(spark, "breaker"), scratch_path(spark, "breaker-checkpoint")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        states = br.breaker_stream(call_log(_event_stream(spark, sf_dir)), failures=2, recovery_seconds=14400.0)
        states.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(
            availableNow=True
        ).start(out).awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(br.STATES).parquet(out).select("circuit", "call_id", "admitted", "state")


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, bad, manifest, checkpoint = (scratch_path(spark, n) for n in ("ingest", "quarantine", "ingest-manifest", "ingest-checkpoint"))
    short_batches(spark)
    d = F.col("doc_id")
    raw = F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("page"), F.split("text", "\n").alias("lines"))).alias("pages")))
    uploads = _event_stream(spark, sf_dir, "documents").select(
        F.when(d % 11 != 0, F.concat(F.lit("doc-"), d.cast("string"), F.lit(".json"))).alias("filename"),
        F.when(d % 6 == 5, "video").otherwise("file").alias("process_type"), F.col("n_chars").alias("size_bytes"),
        F.when(d % 7 == 3, "{oops").when(d % 7 == 4, F.concat(F.substring(raw, 1, F.length(raw) - 2), F.lit(', {"lines": 7}]}'))).otherwise(raw).alias("raw"),
    )
    ingest(uploads, out, bad, manifest, checkpoint).awaitTermination()
    good = committed(spark, out, manifest, "source_file string").groupBy("source_file").agg(F.count("*").alias("n"), F.lit("OK").alias("outcome"))
    aside = committed(spark, bad, manifest, "filename string, error_code string").groupBy(F.coalesce("filename", F.lit("-")).alias("source_file")).agg(
        F.count("*").alias("n"), F.max("error_code").alias("outcome"))
    return good.unionByName(aside)


def linear_model():
    """Stands in for a user's model: mean of the first half minus mean of the second."""
    weights = np.concatenate([np.full(32, 1.0), np.full(32, -1.0)]) / 32

    def predict(batch: np.ndarray) -> np.ndarray:
        return batch.astype(np.float64) @ weights

    return predict


def batch_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_batches(table(spark, sf_dir, "embeddings"), linear_model, "embedding", 64)
    return scored.select("vec_id", F.round("score", 5).alias("score"))


def fallback_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("prob_damaged")
    views = claim_views(spark, sf_dir).withColumn("_p", damage_prediction(1.0 - p, p, 0.5)).select("claim_id", "view", "_p.*")
    empty = F.array().cast("array<string>")
    flagged = general_damage(views.withColumn("damages", F.when(F.col("claim_id") % 2 == 0, F.array(F.lit("x"))).otherwise(empty)))
    g = F.col("general_damage")
    return flagged.where(g.isNotNull()).select(
        "claim_id", "view", g["severity"].alias("severity"), g["confidence"].alias("confidence"), g["repair_action"].alias("repair_action"),
        F.array_join(g["parts_at_risk"], ",").alias("parts"),
    )


def whole_numbers(values: pd.Series) -> pd.Series:
    """Stands in for a vectorised model: it fails on a batch with one bad row."""
    return pd.to_numeric(values, errors="raise").astype("int64")


def best_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.col("event_id").cast("string"))
    tried = table(spark, sf_dir, "events").select("event_id", best_effort_batch(whole_numbers, value, -1, "bigint").alias("r"))
    return tried.select("event_id", "r.value", F.col("r.error").isNotNull().alias("failed"))


QUERIES = {
    "stream_metrics": stream_metrics,
    "batch_metrics": batch_metrics,
    "breaker_states": breaker_states,
    "breaker_stream": breaker_stream,
    "stream_ingest": stream_ingest,
    "batch_score": batch_score,
    "fallback_damage": fallback_damage,
    "best_effort": best_effort,
}

_BUCKETS = ", ".join(f"count(*) FILTER (WHERE s <= {le}) AS le_{str(le).replace('.', '_')}" for le in HISTOGRAM_BUCKETS)
_WINDOWS = f"""
SELECT w AS window_start, w + 21600 AS window_end, route_id, (status_code // 100) || 'xx' AS status_class, {_BUCKETS}, count(*) AS le_inf, count(*) AS observations,
       round(sum(s), 4) AS sum_seconds
FROM (SELECT *, elapsed_ms / 100.0e0 AS s, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS w FROM requests) GROUP BY 1, 2, 3, 4"""

# The breaker as a recursion over each circuit's calls.
BREAKER_SQL = """calls AS (
  SELECT CAST(user_id AS VARCHAR) AS circuit, event_id AS call_id, epoch_us(ts) AS us, event_type <> 'error' AS ok,
         event_type = 'error' AND event_id % 7 = 0 AS ignored, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT circuit, 0 AS i, CAST(-1 AS BIGINT) AS call_id, true AS admitted, 'closed' AS state, 0 AS failures, CAST(0 AS BIGINT) AS opened FROM calls GROUP BY circuit
  UNION ALL
  SELECT circuit, i, call_id, before <> 'open', CASE WHEN before = 'open' THEN 'open' WHEN ok THEN 'closed' WHEN ignored THEN before
           WHEN before = 'half_open' OR failures + 1 >= 2 THEN 'open' ELSE 'closed' END,
         CASE WHEN before = 'open' OR ok THEN 0 WHEN ignored THEN failures WHEN before = 'half_open' OR failures + 1 >= 2 THEN 0 ELSE failures + 1 END,
         CASE WHEN before = 'open' OR ok OR ignored THEN opened WHEN before = 'half_open' OR failures + 1 >= 2 THEN us ELSE opened END
  FROM (SELECT c.circuit, c.i, c.call_id, c.ok, c.ignored, c.us, w.failures, w.opened,
               CASE WHEN w.state = 'open' AND c.us - w.opened >= 14400000000 THEN 'half_open' ELSE w.state END AS before
        FROM walk w JOIN calls c ON c.circuit = w.circuit AND c.i = w.i + 1))"""

ORACLES = {
    "batch_metrics": with_sql(REQUESTS_SQL) + _WINDOWS,
    "stream_metrics": with_sql(REQUESTS_SQL) + f"SELECT * FROM ({_WINDOWS}) WHERE window_end <= (SELECT epoch(max(ts)) - 600 FROM events)",
    "breaker_states": "WITH RECURSIVE " + BREAKER_SQL + "SELECT circuit, call_id, admitted, state FROM walk WHERE i > 0",
    "breaker_stream": "WITH RECURSIVE " + BREAKER_SQL + """
SELECT w.circuit, w.call_id, admitted, state FROM walk w JOIN calls c ON c.call_id = w.call_id
WHERE w.i > 0 AND c.us // 1000 + 1 <= (SELECT epoch_ms(max(ts)) - 600000 FROM events)""",
    "stream_ingest": "WITH RECURSIVE " + LINES_SQL + f""", tidy AS (SELECT doc_id, line_index, {COLLAPSED} AS text FROM lines WHERE doc_id % 11 <> 0 AND doc_id % 6 <> 5 AND doc_id % 7 <> 3),
sized AS (SELECT doc_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS i, text FROM tidy WHERE text <> ''),
""" + pack_sql(1200, 3) + """
SELECT 'doc-' || key || '.json' AS source_file, len(chunks) AS n, 'OK' AS outcome FROM packed
UNION ALL SELECT CASE WHEN doc_id % 11 = 0 THEN '-' ELSE 'doc-' || doc_id || '.json' END, count(*), 'VALIDATION_ERROR'
FROM documents WHERE doc_id % 11 = 0 OR doc_id % 6 = 5 OR doc_id % 7 IN (3, 4) GROUP BY 1""",
    "batch_score": "SELECT vec_id, round((list_sum(embedding[1:32]::DOUBLE[]) - list_sum(embedding[33:64]::DOUBLE[])) / 32, 5) AS score FROM embeddings",
    "fallback_damage": with_sql(CLAIM_VIEWS_SQL) + f"""
SELECT claim_id, view, CASE WHEN prob_damaged >= 0.8 THEN 'severe' WHEN prob_damaged >= 0.65 THEN 'moderate' ELSE 'minor' END AS severity,
       round(prob_damaged, 4) AS confidence, '{GENERAL_DAMAGE_ACTION}' AS repair_action, 'undetermined' AS parts
FROM claim_views WHERE claim_id % 2 <> 0 AND prob_damaged >= 0.5""",
    "best_effort": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE event_id END AS value, event_id % 10 = 0 AS failed FROM events",
}
