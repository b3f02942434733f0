"""Domain-shaped views over the given tables, in Spark and in SQL for the oracle.

Views hold whole tables. Boxes get ids from their own values, claims keep one row per view
by aggregation, and documents stay one row each, so no view needs a window over a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import EASTERN_DIGITS
from folioscope.session import dealt, short_batches, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table, shared over all cores when the file has too few splits; its texts reach Python in short batches."""
    short_batches(spark)
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


# Boxes: image = order, one box per line item, in a 640 pixel frame.
DETECTIONS_SQL = """detections AS (
  SELECT l_orderkey AS image_id,
         concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT)) AS det_id,
         64.0e0 * (2 + l_partkey % 7) AS cx, 64.0e0 * (2 + l_suppkey % 7) AS cy,
         96.0e0 + 64 * (l_linenumber % 4) AS w, 96.0e0 + 64 * (CAST(l_quantity AS INT) % 4) AS h,
         CAST((l_linenumber + l_suppkey) % 6 AS INT) AS class_id,
         (1 + (l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 97) / 100.0e0 AS score
  FROM lineitem)"""

CLASS_NAMES = ["car-part-crack", "deformation", "flat-tire", "glass-crack", "lamp-crack", "scratches"]
VIEW_CASE = "CASE l_linenumber % 4 WHEN 0 THEN 'front' WHEN 1 THEN 'back' WHEN 2 THEN 'left' ELSE 'right' END"

# Views of a claim: claim = order, view from the line number, scores from the best line.
CLAIM_VIEWS_SQL = f"""claim_views AS (
  SELECT l_orderkey AS claim_id, {VIEW_CASE} AS view,
         max((1 + (l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 97) / 100.0e0) AS prob_damaged,
         max((l_partkey * 17 + l_linenumber * 29 + l_orderkey) % 100 / 100.0e0) AS car_prob
  FROM lineitem GROUP BY 1, 2)"""

REQUESTS_SQL = """requests AS (
  SELECT event_id, ts, user_id, user_id % 5 AS route_id, event_type AS scenario,
         value AS elapsed_ms, event_type <> 'error' AS ok,
         CASE WHEN event_type <> 'error' THEN 200
              WHEN event_id % 3 = 0 THEN 503 WHEN event_id % 3 = 1 THEN 504 ELSE 415 END AS status_code,
         CAST(json_extract(props, '$.k') AS INT) / 100.0e0 AS confidence
  FROM events)"""

LINES_SQL = """lines AS (
  SELECT doc_id, line_index, text, ((doc_id * 31 + line_index * 17) % 101) / 100.0e0 AS confidence
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) AS line_index FROM documents))"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity").cast("int")
    return li.select(
        F.col("l_orderkey").alias("image_id"),
        F.concat_ws("-", *[c.cast("string") for c in (F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), quantity)]).alias("det_id"),
        (64.0 * (2 + F.col("l_partkey") % 7)).alias("cx"), (64.0 * (2 + F.col("l_suppkey") % 7)).alias("cy"),
        (96.0 + 64 * (F.col("l_linenumber") % 4)).alias("w"), (96.0 + 64 * (quantity % 4)).alias("h"),
        ((F.col("l_linenumber") + F.col("l_suppkey")) % 6).cast("int").alias("class_id"), _score().alias("score"),
    )


def _score() -> Column:
    return (1 + (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber")) % 97) / 100.0


def claim_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    car = (F.col("l_partkey") * 17 + F.col("l_linenumber") * 29 + F.col("l_orderkey")) % 100 / 100.0
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("claim_id"), F.expr(VIEW_CASE).alias("view")
    ).agg(F.max(_score()).alias("prob_damaged"), F.max(car).alias("car_prob"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(table(spark, sf_dir, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    failed = F.col("event_type") == "error"
    code = F.when(~failed, 200).when(F.col("event_id") % 3 == 0, 503).when(F.col("event_id") % 3 == 1, 504).otherwise(415)
    return events.select(
        "event_id", "ts", "user_id", (F.col("user_id") % 5).alias("route_id"), F.col("event_type").alias("scenario"),
        F.col("value").alias("elapsed_ms"), (~failed).alias("ok"), code.alias("status_code"),
        (F.get_json_object("props", "$.k").cast("int") / 100.0).alias("confidence"),
    )


def ocr_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id and its lines with confidence (single-image form)."""
    line = lambda t, i: F.struct(
        t.alias("text"), (((F.col("doc_id") * 31 + (i + 1) * 17) % 101) / 100.0).alias("confidence")
    )
    return documents(spark, sf_dir).select(
        "doc_id", "lang", F.transform(F.split("text", "\n"), line).alias("lines")
    )


def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: conversation = document, turn = page."""
    line = lambda t, i: F.struct(
        t.alias("text"), (((F.col("conv_id") * 31 + F.col("turn") * 7 + (i + 1) * 17) % 101) / 100.0).alias("confidence")
    )
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"),
        F.transform(F.split("text", "\n"), line).alias("lines"),
    )


PAGE_LINES_SQL = """page_lines AS (
  SELECT conv_id AS doc_id, CAST(turn AS INT) AS page, line_index, text,
         ((conv_id * 31 + turn * 7 + line_index * 17) % 101) / 100.0e0 AS confidence
  FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text,
               generate_subscripts(string_split(text, chr(10)), 1) AS line_index FROM conversations))"""

# Registration cards built from the part table: every line is a function of the part key,
# so the expected field values are known without looking at the extractor.
CARDS_SQL = f"""cards AS (
  SELECT k AS doc_id, [
    'شرطة عمان', 'رقم اللوحة',
    CASE k % 4 WHEN 0 THEN plate || ' ب' WHEN 1 THEN translate(plate, '0123456789', '{EASTERN_DIGITS[:10]}') || 'م'
               WHEN 2 THEN plate || ' -' ELSE 'ب' END,
    'نوع المركبة', CASE WHEN k % 3 <> 0 THEN 'خصوصي' ELSE 'تجاري' END,
    'اللون', color, make_model, 'سنة الصنع', CASE WHEN k % 2 = 0 THEN '20' || yy ELSE yy END,
    'سعة المحرك', CASE WHEN k % 7 = 0 THEN '-' ELSE CAST(cc AS VARCHAR) END,
    'الوزن فارغ', CAST(empty_w AS VARCHAR), 'الحمولة القصوى', CAST(max_w AS VARCHAR),
    'عدد الركاب', CASE WHEN k % 6 = 0 THEN '-' ELSE CAST(seat_n AS VARCHAR) END,
    'رقم الشاصي', vin, CASE WHEN k % 5 = 0 THEN 'NIL' ELSE 'سلطنة عمان' END,
    CASE WHEN k % 8 = 0 THEN '-' ELSE issued END, expires] AS lines, *
  FROM (SELECT p_partkey AS k, CAST(10001 + p_partkey % 89999 AS VARCHAR) AS plate,
               CASE p_partkey % 3 WHEN 0 THEN 'ابيض' WHEN 1 THEN 'اسود' ELSE 'فضي' END AS color,
               CASE p_partkey % 3 WHEN 0 THEN 'تويوتا كورولا' WHEN 1 THEN 'نيسان صني' ELSE 'LEXUS' END AS make_model,
               lpad(CAST(5 + p_partkey % 18 AS VARCHAR), 2, '0') AS yy,
               1000 + 100 * (p_partkey % 9) AS cc, 900 + p_partkey % 900 AS empty_w, 300 + p_partkey % 700 AS max_w,
               2 + p_partkey % 7 AS seat_n,
               'J1' || substring(translate(upper(md5(CAST(p_partkey AS VARCHAR))), '0123456789', 'GHJKLMNPRS'), 1, 15) AS vin,
               '20' || CAST(15 + p_partkey % 5 AS VARCHAR) || '/0' || CAST(1 + p_partkey % 9 AS VARCHAR) || '/15' AS issued,
               '20' || CAST(16 + p_partkey % 5 AS VARCHAR) || '/0' || CAST(1 + p_partkey % 9 AS VARCHAR) || '/14' AS expires
        FROM part))"""

# What the card rules must read from each card.
CARD_FIELDS_SQL = """card_fields AS (
  SELECT doc_id, lines,
         CASE k % 4 WHEN 0 THEN plate || 'ب' WHEN 1 THEN plate || 'م' WHEN 2 THEN plate
              ELSE CAST(CASE WHEN k % 7 = 0 THEN empty_w ELSE cc END AS VARCHAR) END AS plate_number,
         CASE WHEN k % 4 = 3 THEN 'ب' END AS plate_text,
         CASE WHEN k % 3 <> 0 THEN 'خصوصي' END AS vehicle_type,
         CASE k % 3 WHEN 0 THEN 'تويوتا' WHEN 1 THEN 'نيسان' ELSE 'LEXUS' END AS make,
         CASE k % 3 WHEN 0 THEN 'كورولا' WHEN 1 THEN 'صني' END AS model,
         color, 2000 + CAST(yy AS INT) AS year, CASE WHEN k % 2 = 0 THEN 2000 + CAST(yy AS INT) END AS model_year,
         vin AS vin_or_chassis, CASE WHEN k % 5 = 0 THEN 'NIL' END AS engine_number,
         CASE WHEN k % 7 <> 0 THEN cc WHEN k % 4 <> 3 THEN empty_w WHEN max_w <> empty_w THEN max_w END AS engine_cc,
         empty_w AS empty_weight_kg, max_w AS max_load_kg,
         CASE WHEN k % 6 <> 0 THEN seat_n WHEN k % 2 = 1 THEN CAST(yy AS INT) ELSE 1 END AS seats,
         CASE WHEN k % 8 <> 0 THEN issued END AS issue_date, expires AS expiry_date
  FROM cards)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")

    def text(c: Column) -> Column:
        return c.cast("string")

    plate = text(10001 + k % 89999)
    yy = F.lpad(text(5 + k % 18), 2, "0")
    day = F.concat(F.lit("/0"), text(1 + k % 9))
    vin = F.concat(F.lit("J1"), F.substring(F.translate(F.upper(F.md5(text(k))), "0123456789", "GHJKLMNPRS"), 1, 15))
    lines = [
        F.lit("شرطة عمان"), F.lit("رقم اللوحة"),
        F.when(k % 4 == 0, F.concat(plate, F.lit(" ب")))
        .when(k % 4 == 1, F.concat(F.translate(plate, "0123456789", EASTERN_DIGITS[:10]), F.lit("م")))
        .when(k % 4 == 2, F.concat(plate, F.lit(" -"))).otherwise("ب"),
        F.lit("نوع المركبة"), F.when(k % 3 != 0, "خصوصي").otherwise("تجاري"),
        F.lit("اللون"), F.when(k % 3 == 0, "ابيض").when(k % 3 == 1, "اسود").otherwise("فضي"),
        F.when(k % 3 == 0, "تويوتا كورولا").when(k % 3 == 1, "نيسان صني").otherwise("LEXUS"),
        F.lit("سنة الصنع"), F.when(k % 2 == 0, F.concat(F.lit("20"), yy)).otherwise(yy),
        F.lit("سعة المحرك"), F.when(k % 7 == 0, "-").otherwise(text(1000 + 100 * (k % 9))),
        F.lit("الوزن فارغ"), text(900 + k % 900), F.lit("الحمولة القصوى"), text(300 + k % 700),
        F.lit("عدد الركاب"), F.when(k % 6 == 0, "-").otherwise(text(2 + k % 7)),
        F.lit("رقم الشاصي"), vin, F.when(k % 5 == 0, "NIL").otherwise("سلطنة عمان"),
        F.when(k % 8 == 0, "-").otherwise(F.concat(F.lit("20"), text(15 + k % 5), day, F.lit("/15"))),
        F.concat(F.lit("20"), text(16 + k % 5), day, F.lit("/14")),
    ]
    return dealt(table(spark, sf_dir, "part").select("p_partkey")).select(k.alias("doc_id"), F.array(*lines).alias("lines"))


def with_sql(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
