"""Registered join queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.catalog.routing import COLLAPSED, FRAMED_SQL, REGION_CASE, SEVERITY_CASE
from folioscope.catalog.sources import CLASS_LIST, PARTS_VALUES, REMAP_VALUES, REPAIR_VALUES
from folioscope.catalog.views import (
    CARD_FIELDS_SQL, CARDS_SQL, CLAIM_VIEWS_SQL, DETECTIONS_SQL, cards, claim_views, detections, documents, table, with_sql,
)
from folioscope.functions.text import collapse_ws
from folioscope.operators import claims as ops
from folioscope.operators import detections as det
from folioscope.operators import translate as tr
from folioscope.operators.dimensions import translations
from folioscope.operators.quality import join_truth
from folioscope.operators.records import annotate_lines as annotate
from folioscope.operators.records import extract_record
from folioscope.rules import DIGIT_MATCH_FIELDS, FIELD_LABELS_AR, PLATE_UNAVAILABLE, VIEW_PRIORITY

# A small Latin dictionary for the given documents; sources overlap so that order matters.
WORDS = {"the": "THE", "and the": "AND-THE", "and": "AND", "de la": "DE-LA", "de": "DE", "les": "LES", "ing": "ing", "der": "DER"}
WORDS_VALUES = "(VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in WORDS.items()) + ")"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.boxes_in_frame(detections(spark, sf_dir))


def parts_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.parts_at_risk(_boxes(spark, sf_dir)).select("image_id", "det_id", F.array_join("parts_at_risk", ",").alias("parts"))


def repair_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.repair_action(_boxes(spark, sf_dir)).select("image_id", "det_id", "repair_action", "replace")


def view_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = F.array(*[F.lit(v) for v in ("Front", "back", "LEFT", "right", "top")])
    parts = det.parts_at_risk(_boxes(spark, sf_dir)).withColumn("view", F.get(views, (F.col("image_id") % 5).cast("int")))
    return parts.select("image_id", "det_id", "view", F.array_join(det.remap_parts(F.col("view"), F.col("parts_at_risk")), ",").alias("parts"))


def car_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = claim_views(spark, sf_dir)
    kept, skipped = ops.car_gate(views.select("claim_id", "view"), views.select("claim_id", "view", "car_prob"))
    return kept.select("claim_id", "view", F.lit("kept").alias("reason"), F.lit(-1.0).alias("car_confidence")).unionByName(
        skipped.select("claim_id", "view", "reason", "car_confidence")
    )


def translate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = documents(spark, sf_dir).select("doc_id", F.explode(F.split("text", "[ \n]")).alias("token"))
    hits = tr.translate_exact(tokens, "token", F.broadcast(translations(spark, WORDS)))  # 8 fixed rows
    return hits.groupBy("translation").agg(F.count("*").alias("n")).select(F.coalesce("translation", F.lit("-")).alias("translation"), "n")


def translate_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tr.translate(F.col("text"), WORDS).alias("translation"))


def annotate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate(extract_record(cards(spark, sf_dir)))


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return det.overlap_pairs(detections(spark, sf_dir)).select("image_id", "det_id", "better_id", F.round("iou", 6).alias("iou"))


def prediction_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_truth(predictions(spark, sf_dir), table(spark, sf_dir, "labels")).select(
        "doc_id", "score", (F.col("quality") == 1).alias("truth")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ((F.col("doc_id") * 37 + F.col("n_chars")) % 100 / 100.0).alias("score"))


PREDICTION_TRUTH_SQL = """truth AS (
  SELECT doc_id, (doc_id * 37 + n_chars) % 100 / 100.0e0 AS score, quality = 1 AS truth FROM documents JOIN labels USING (doc_id))"""


def claim_plate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = claim_views(spark, sf_dir)
    source = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id")).join(
        ops.priority_view(views.where(F.col("car_prob") >= 0.65)), "claim_id", "left")
    plates = source.where(F.col("source_view").isNotNull()).where(F.col("claim_id") % 3 != 0).select(
        "claim_id", "source_view", F.lit(True).alias("detected"), F.concat(F.lit("P"), F.col("claim_id").cast("string")).alias("plate_text"),
        ((F.col("claim_id") % 50 + 50) / 100.0).alias("confidence"),
    )
    joined = ops.attach_plate(source.withColumnRenamed("source_view", "chosen"), plates, F.col("chosen").isNotNull())
    return joined.select(
        "claim_id", "plate.detected", "plate.plate_text", "plate.confidence",
        F.coalesce("plate.source_view", F.lit("-")).alias("source_view"), F.coalesce("plate.error", F.lit("-")).alias("error"),
    )


QUERIES = {
    "parts_lookup": parts_lookup,
    "repair_lookup": repair_lookup,
    "view_remap": view_remap,
    "car_gate": car_gate,
    "translate_exact": translate_exact,
    "translate_longest": translate_longest,
    "annotate_lines": annotate_lines,
    "iou_pairs": iou_pairs,
    "prediction_truth": prediction_truth,
    "claim_plate_join": claim_plate_join,
}

TYPED_SQL = f"""typed AS (
  SELECT image_id, det_id, score, {CLASS_LIST}[class_id + 1] AS type, {SEVERITY_CASE} AS severity, {REGION_CASE} AS region FROM framed)"""
PARTS_SQL = f"parts AS (SELECT t.*, p.c AS plist FROM typed t LEFT JOIN {PARTS_VALUES} p(a, b, c) ON t.type = p.a AND t.region = p.b)"
PRIORITY_SQL = "[" + ", ".join(f"'{v}'" for v in VIEW_PRIORITY) + "]"

RANKED_SQL = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, det_id) AS rk FROM {boxes})"""

# Greedy suppression as a recursion over the rank of each image's boxes.
NMS_SQL = RANKED_SQL.format(boxes="boxes") + """,
walk AS (
  SELECT image_id, 1 AS rk, [{{'det_id': det_id, 'cx': cx, 'cy': cy, 'w': w, 'h': h}}] AS kept FROM ranked WHERE rk = 1
  UNION ALL
  SELECT w.image_id, r.rk,
         CASE WHEN len(list_filter(w.kept, lambda k: {iou} {op} {threshold})) = 0
              THEN list_append(w.kept, {{'det_id': r.det_id, 'cx': r.cx, 'cy': r.cy, 'w': r.w, 'h': r.h}}) ELSE w.kept END
  FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.rk = w.rk + 1),
final AS (SELECT image_id, arg_max(kept, rk) AS kept FROM walk GROUP BY image_id)"""


def iou_sql(a: str, b: str) -> str:
    def reach(axis: str, size: str) -> str:
        return (f"greatest(0, least({a}.{axis} + {a}.{size} / 2, {b}.{axis} + {b}.{size} / 2)"
                f" - greatest({a}.{axis} - {a}.{size} / 2, {b}.{axis} - {b}.{size} / 2))")

    shared = f"({reach('cx', 'w')} * {reach('cy', 'h')})"
    return f"({shared} / ({a}.w * {a}.h + {b}.w * {b}.h - {shared}))"


def nms_sql(op: str = ">=", threshold: float = 0.45) -> str:
    return NMS_SQL.format(iou=iou_sql("k", "r"), op=op, threshold=threshold)


_FIELDS = list(FIELD_LABELS_AR)
_KEY = "lower(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}_\\x{{0600}}-\\x{{06FF}}]', '', 'g'))"
FIELD_VALUES_SQL = "field_values AS (\n" + "\nUNION ALL\n".join(
    f"  SELECT doc_id, {n} AS ord, '{f}' AS field, '{FIELD_LABELS_AR[f]}' AS label, {str(f in DIGIT_MATCH_FIELDS).lower()} AS is_num, "
    f"{_KEY.format(f'CAST({f} AS VARCHAR)')} AS vkey FROM card_fields"
    for n, f in enumerate(_FIELDS) if f not in ("owner_name", "country_of_origin")
) + ")"

ORACLES = {
    "parts_lookup": with_sql(DETECTIONS_SQL, FRAMED_SQL, TYPED_SQL, PARTS_SQL) + """
SELECT image_id, det_id, coalesce(array_to_string(plist, ','), '') AS parts FROM parts""",
    "repair_lookup": with_sql(DETECTIONS_SQL, FRAMED_SQL, TYPED_SQL) + f"""
SELECT image_id, det_id, coalesce(r.c, 'Manual inspection required') AS repair_action, coalesce(r.d, false) AS replace
FROM typed t LEFT JOIN {REPAIR_VALUES} r(a, b, c, d) ON t.type = r.a AND t.severity = r.b""",
    "view_remap": with_sql(DETECTIONS_SQL, FRAMED_SQL, TYPED_SQL, PARTS_SQL) + f"""
SELECT p.image_id, p.det_id, p.view, string_agg(coalesce(m.c, p.part), ',' ORDER BY p.i) AS parts
FROM (SELECT image_id, det_id, ['Front', 'back', 'LEFT', 'right', 'top'][image_id % 5 + 1] AS view, unnest(plist) AS part,
             generate_subscripts(plist, 1) AS i FROM parts) p
LEFT JOIN {REMAP_VALUES} m(a, b, c) ON m.a = lower(p.view) AND m.b = p.part GROUP BY 1, 2, 3""",
    "car_gate": with_sql(CLAIM_VIEWS_SQL) + """
SELECT claim_id, view, CASE WHEN car_prob >= 0.65 THEN 'kept' ELSE 'not_a_car' END AS reason,
       CASE WHEN car_prob >= 0.65 THEN -1.0e0 ELSE round(1 - car_prob, 4) END AS car_confidence FROM claim_views""",
    "translate_exact": f"""
SELECT CASE WHEN tok = '' THEN '' ELSE coalesce(t.b, '-') END AS translation, count(*) AS n FROM (
  SELECT {COLLAPSED} AS tok FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS text FROM documents)) d
LEFT JOIN {WORDS_VALUES} t(a, b) ON d.tok = t.a GROUP BY 1""",
    "translate_longest": "SELECT doc_id, " + "".join("replace(" for _ in WORDS) + COLLAPSED
    + "".join(f", '{s}', '{t}')" for s, t in sorted(WORDS.items(), key=lambda kv: -len(kv[0]))) + " AS translation FROM documents",
    "annotate_lines": with_sql(CARDS_SQL, CARD_FIELDS_SQL, FIELD_VALUES_SQL) + f"""
SELECT doc_id, line_index, text, field, label FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_index ORDER BY tier, CASE WHEN tier = 1 THEN -length(vkey) ELSE 0 END, ord) AS rn FROM (
    SELECT l.doc_id, l.line_index, l.text, v.field, v.label, v.ord, v.vkey,
           CASE WHEN v.vkey = l.lkey THEN 0
                WHEN v.is_num AND regexp_replace(l.lkey, '[^0-9]', '', 'g') <> ''
                     AND regexp_replace(l.lkey, '[^0-9]', '', 'g') = regexp_replace(v.vkey, '[^0-9]', '', 'g') THEN 0
                WHEN contains(l.lkey, v.vkey) OR contains(v.vkey, l.lkey) THEN 1 END AS tier
    FROM (SELECT *, translate({_KEY.format('text')}, '٠١٢٣٤٥٦٧٨٩', '٠١٢٣٤٥٦٧٨٩') AS lkey FROM (
            SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) AS line_index FROM cards)) l
    JOIN field_values v USING (doc_id) WHERE l.lkey <> '' AND v.vkey <> '') WHERE tier IS NOT NULL) WHERE rn = 1""",
    "iou_pairs": with_sql(DETECTIONS_SQL, RANKED_SQL.format(boxes="detections WHERE w > 0 AND h > 0")) + f"""
SELECT image_id, det_id, better_id, round(iou, 6) AS iou FROM (
  SELECT b.image_id, b.det_id, a.det_id AS better_id, {iou_sql('a', 'b')} AS iou
  FROM ranked a JOIN ranked b ON a.image_id IS NOT DISTINCT FROM b.image_id AND a.rk < b.rk) WHERE iou >= 0.45""",
    "prediction_truth": with_sql(PREDICTION_TRUTH_SQL) + "SELECT * FROM truth",
    "claim_plate_join": with_sql(CLAIM_VIEWS_SQL) + f"""
SELECT claim_id, read AS detected, CASE WHEN read THEN 'P' || claim_id ELSE '' END AS plate_text,
       CASE WHEN read THEN (claim_id % 50 + 50) / 100.0e0 ELSE 0.0e0 END AS confidence,
       CASE WHEN read THEN chosen ELSE '-' END AS source_view,
       CASE WHEN chosen IS NULL OR read THEN '-' ELSE '{PLATE_UNAVAILABLE}' END AS error
FROM (SELECT o_orderkey AS claim_id, arg_min(view, list_position({PRIORITY_SQL}, view)) AS chosen, o_orderkey % 3 <> 0 AND max(view) IS NOT NULL AS read
      FROM orders LEFT JOIN claim_views ON claim_id = o_orderkey AND car_prob >= 0.65 GROUP BY 1) AS c""",
}
