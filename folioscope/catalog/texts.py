"""Registered scalar, array and JSON function queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.catalog.routing import COLLAPSED, SPACE_RE
from folioscope.catalog.views import CARDS_SQL, DETECTIONS_SQL, cards, detections, documents, table, with_sql
from folioscope.functions import jsontext as js
from folioscope.functions import scores as sc
from folioscope.functions import text as tx
from folioscope.functions.binding import let
from folioscope.rules import DAMAGE_CLASSES, DIGIT_ALLOWLIST, LETTER_ALLOWLIST


def collapse_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", tx.collapse_ws(F.concat(F.lit("\u00a0\t"), "text", F.lit(" \u2003"))).alias("text"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    dressed = F.concat(F.lit("\u200f\ufb01\uff21 "), "text", F.lit(" \u0640\u202b\u2460"))
    return documents(spark, sf_dir).select("doc_id", tx.normalize_text(dressed).alias("text"))


def ascii_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars").cast("string")
    eastern = F.translate(n, "0123456789", tx.EASTERN_DIGITS[:10])
    persian = F.translate(n, "0123456789", tx.EASTERN_DIGITS[10:])
    return documents(spark, sf_dir).select("doc_id", tx.ascii_digits(F.concat_ws("-", eastern, persian, n)).alias("digits"))


def has_arabic(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\ufe8e"))).otherwise(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", tx.has_arabic(marked).alias("arabic"))


def fix_reversed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cards(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("pos", "text"))
    return lines.select("doc_id", "pos", tx.fix_reversed_runs(F.col("text")).alias("text"))


def field_key_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.md5(tx.field_key_text(F.col("text"))).alias("key_md5"))


def clean_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.explode(F.split("text", "[ \n]")).alias("token")
    words = documents(spark, sf_dir).select("doc_id", "n_chars", token).withColumn("token", F.concat("token", F.col("n_chars").cast("string")))
    # Digits and letters are parts of the plate: they are taken once a plate, not once a word, and are no keys.
    plates = words.groupBy(tx.clean_plate(F.col("token")).alias("plate")).agg(F.count("*").alias("n"))
    return plates.select("plate", *(tx.clean_plate(F.col("plate"), kept).alias(c) for c, kept in (("digits", DIGIT_ALLOWLIST), ("letters", LETTER_ALLOWLIST))), "n")


def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = F.concat("text", F.lit(" 12345678 2019/01/02 00120034 123456789012345678901234567890 000 "), F.col("doc_id").cast("string"))
    return documents(spark, sf_dir).select("doc_id", F.array_join(tx.numeric_tokens(dated), ",").alias("numbers"))


def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy/MM/dd")
    short = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 40), "yy/M/d")
    text = F.concat(
        F.lit("due "), F.when(F.col("o_orderkey") % 3 == 0, F.lit("never")).otherwise(short), F.lit(" since "), day, F.lit(", again "), day
    )
    dates = o.select("o_orderkey", tx.date_strings(text).alias("dates"))
    return dates.select("o_orderkey", tx.issue_expiry(F.col("dates")).alias("r"), F.size("dates").alias("n_dates")).select(
        "o_orderkey", "n_dates", F.coalesce("r.issue_date", F.lit("-")).alias("issue_date"), F.col("r.expiry_date").alias("expiry_date"),
        tx.as_date(F.col("r.expiry_date")).cast("string").alias("expiry_day"),
    )


def coerce_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("n°"), F.col("n_chars").cast("string"), F.lit("x "), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))
    return documents(spark, sf_dir).select(
        "doc_id", tx.coerce_int(text).alias("first"), F.coalesce(tx.coerce_int(text, 100, 500), F.lit(-1)).alias("bounded"),
        F.coalesce(tx.coerce_year(F.concat(F.lit("year "), (F.col("doc_id") + 1700).cast("string"))), F.lit(-1)).alias("year"),
    )


def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    raw = F.to_json(F.struct(
        F.col("c_name").alias("name"), F.struct(F.col("c_custkey").alias("key"), F.array("c_nationkey", F.lit(None).cast("bigint")).alias("zones")).alias("ids"),
        F.array().cast("array<string>").alias("none"), (F.col("c_custkey") % 2 == 0).alias("even"),
    ), {"ignoreNullFields": "false"})
    return c.select("c_custkey", F.array_join(js.flatten_json(raw), "\n").alias("lines"))


def json_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    raw = F.when(n % 4 == 0, F.col("props")).when(n % 4 == 1, F.concat(F.lit("["), "props", F.lit(", 2]"))).when(n % 4 == 2, F.col("value").cast("string")).otherwise(F.concat("props", F.lit("{")))
    return e.select("event_id", js.json_profile(raw).alias("p")).select(
        "event_id", F.coalesce("p.top_level_type", F.lit("-")).alias("type"), F.coalesce(F.array_join("p.top_level_keys", ","), F.lit("-")).alias("keys"),
        F.coalesce("p.item_count", F.lit(-1)).alias("items"), F.col("p.json_error").isNotNull().alias("failed"),
    )


def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 2 == 0, F.col("text").cast("binary")).otherwise(F.concat(F.unhex(F.lit("FF")), F.col("text").cast("binary")))
    return documents(spark, sf_dir).select("doc_id", tx.text_preview(content).alias("p")).select("doc_id", "p.*")


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)))
    first = F.get("v", F.lit(0)) * 100
    return e.select("vec_id", sc.softmax(F.col("v")).alias("s"), sc.as_probability(first).alias("p"),
                    sc.positive_probability(F.slice("v", 1, 2)).alias("pair"), sc.positive_probability(F.array(first), high_is_positive=False).alias("negated")).select(
        "vec_id", F.round(F.get("s", F.lit(0)), 6).alias("first_p"), F.round(F.array_max("s"), 6).alias("top_p"), F.round("p", 6).alias("p"),
        F.round("pair", 6).alias("pair_p"), F.round("negated", 6).alias("negated_p"),
    )


def argmax_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)))
    return e.select("vec_id", sc.argmax_class(F.col("v"), DAMAGE_CLASSES, 0.52).alias("c")).where(F.col("c").isNotNull()).select(
        "vec_id", "c.class_id", "c.label", F.round("c.score", 6).alias("score")
    )


def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detections(spark, sf_dir)
    box = sc.to_xyxy(*[F.col(c) for c in ("cx", "cy", "w", "h")])
    out = let(box, lambda b: F.struct(
        b.alias("b"), sc.unletterbox(b, F.lit(0.5), F.lit(0), F.lit(80), F.lit(1280), F.lit(960)).alias("u"), sc.crop_rect(b, F.lit(640), F.lit(640)).alias("c")))
    return d.select("image_id", "det_id", out.alias("o"), *[sc.to_frame(F.col(c)).alias(f"f{c}") for c in ("cx", "w")]).select(
        "image_id", "det_id", "fcx", "fw", F.col("o.b.x1").alias("x1"), F.col("o.b.y2").alias("y2"),
        *[F.col(f"o.u.{k}").alias(f"u{k}") for k in ("x1", "y1", "x2", "y2")], *[F.col(f"o.c.{k}").alias(f"c{k}") for k in ("x1", "y1", "x2", "y2")],
    )


def safe_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 2 == 0, F.unhex(F.lit("FF41"))).otherwise(F.unhex(F.lit("42"))))
    return documents(spark, sf_dir).select("doc_id", tx.safe_utf8(raw).alias("text"))


def collect_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    line = lambda t: F.struct(F.concat(F.lit(" "), t, F.lit(" ")).alias("text"), F.lit(0.5).alias("confidence"))
    raw = F.to_json(F.struct(
        F.struct(F.array(F.struct(F.lit(1).alias("page"), F.transform(F.split("text", "\n"), line).alias("lines"))).alias("pages")).alias("raw_ocr"),
        F.struct(F.struct(F.col("role").alias("text")).alias("speaker"), F.lit(" ").alias("text")).alias("extracted_data"),
    ))
    texts = c.select("conv_id", "turn", js.collect_texts(raw).alias("t"))
    return texts.select("conv_id", "turn", F.size("t").alias("n"), F.array_join("t", "|").alias("texts"))


QUERIES = {
    "collapse_ws": collapse_ws,
    "normalize_text": normalize_text,
    "ascii_digits": ascii_digits,
    "has_arabic": has_arabic,
    "fix_reversed_runs": fix_reversed_runs,
    "field_key_text": field_key_text,
    "clean_plate": clean_plate,
    "numeric_tokens": numeric_tokens,
    "date_range": date_range,
    "coerce_int": coerce_int,
    "flatten_json": flatten_json,
    "json_profile": json_profile,
    "text_preview": text_preview,
    "probabilities": probabilities,
    "argmax_class": argmax_class,
    "box_geometry": box_geometry,
    "safe_utf8": safe_utf8,
    "collect_texts": collect_texts,
}

_SIG = "(1 / (1 + exp(-({x}))))"
_ROUNDED = "(SELECT vec_id, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 4)) AS v FROM embeddings)"

ORACLES = {
    "collapse_ws": f"SELECT doc_id, {COLLAPSED} AS text FROM documents",
    "normalize_text": f"SELECT doc_id, 'fiA ' || t || CASE WHEN t = '' THEN '' ELSE ' ' END || '1' AS text FROM (SELECT doc_id, {COLLAPSED.replace('text', 'nfc_normalize(text)')} AS t FROM documents)",
    "ascii_digits": "SELECT doc_id, n_chars || '-' || n_chars || '-' || n_chars AS digits FROM documents",
    "has_arabic": "SELECT doc_id, doc_id % 3 = 0 OR regexp_matches(text, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}]') AS arabic FROM documents",
    "fix_reversed_runs": with_sql(CARDS_SQL) + """
SELECT doc_id, CAST(i - 1 AS INT) AS pos, array_to_string(list_transform(string_split(t, ' '),
         lambda w: CASE WHEN regexp_matches(w, '[\\x{0600}-\\x{06FF}]') THEN reverse(w) ELSE w END), ' ') AS text
FROM (SELECT doc_id, unnest(lines) AS t, generate_subscripts(lines, 1) AS i FROM cards)""",
    "field_key_text": "SELECT doc_id, md5(lower(regexp_replace(nfc_normalize(text), '[^\\p{L}\\p{N}_\\x{0600}-\\x{06FF}]', '', 'g'))) AS key_md5 FROM documents",
    "clean_plate": """
SELECT plate, regexp_replace(plate, '[^0-9]', '', 'g') AS digits, regexp_replace(plate, '[^A-HJ-NP-Z]', '', 'g') AS letters, count(*) AS n FROM (
  SELECT regexp_replace(upper(replace(tok, 'ß', 'SS')) || n_chars, '[^A-Z0-9]', '', 'g') AS plate
  FROM (SELECT unnest(regexp_split_to_array(text, '[ \\n]')) AS tok, n_chars FROM documents)) GROUP BY 1, 2, 3""",
    "numeric_tokens": """
SELECT doc_id, array_to_string(list_transform(flatten(list_transform(
    regexp_extract_all(regexp_replace(text || ' 12345678 2019/01/02 00120034 123456789012345678901234567890 000 ' || doc_id, '\\b[0-9]{2,4}/[0-9]{1,2}/[0-9]{1,2}\\b', ' ', 'g'), '[0-9]+'),
    lambda r: CASE WHEN length(r) = 8 AND CAST(r[1:4] AS INT) >= 100 AND CAST(r[5:8] AS INT) >= 100 THEN [r[1:4], r[5:8]] ELSE [r] END)),
  lambda p: regexp_replace(p, '^0+([0-9])', '\\1')), ',') AS numbers FROM documents""",
    "date_range": """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS n_dates, CASE WHEN o_orderkey % 3 = 0 THEN '-' ELSE day END AS issue_date,
       CASE WHEN o_orderkey % 3 = 0 THEN day ELSE short END AS expiry_date,
       CAST(CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) ELSE later + to_years(CASE WHEN year(later) < 2000 THEN 100 ELSE 0 END) END AS DATE)::VARCHAR AS expiry_day
FROM (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y/%m/%d') AS day, CAST(o_orderdate AS DATE) + 40 AS later,
             strftime(CAST(o_orderdate AS DATE) + 40, '%y/%-m/%-d') AS short FROM orders)""",
    "coerce_int": """
SELECT doc_id, CASE WHEN true THEN doc_id END AS first, CASE WHEN doc_id BETWEEN 100 AND 500 THEN doc_id ELSE -1 END AS bounded,
       CASE WHEN doc_id + 1700 BETWEEN 1900 AND 2100 THEN doc_id + 1700 ELSE -1 END AS year FROM documents""",
    "flatten_json": """
SELECT c_custkey, 'name: ' || c_name || chr(10) || 'ids.key: ' || c_custkey || chr(10) || 'ids.zones[1]: ' || c_nationkey || chr(10) || 'ids.zones[2]: ' || chr(10)
       || 'none: []' || chr(10) || 'even: ' || CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'False' END AS lines FROM customer""",
    "json_profile": """
SELECT event_id, ['dict', 'list', 'float', '-'][event_id % 4 + 1] AS type, CASE WHEN event_id % 4 = 0 THEN 'k' ELSE '-' END AS keys,
       CASE WHEN event_id % 4 = 1 THEN 2 ELSE -1 END AS items, event_id % 4 = 3 AS failed FROM events""",
    "text_preview": """
SELECT doc_id, p AS text_preview, CASE WHEN doc_id % 2 = 0 THEN 'utf-8' ELSE 'utf-8-replace' END AS encoding_used,
       len(string_split(p, chr(10))) - CASE WHEN p = '' OR p LIKE '%' || chr(10) THEN 1 ELSE 0 END AS line_count_preview
FROM (SELECT doc_id, substring(CASE WHEN doc_id % 2 = 0 THEN text ELSE chr(65533) || text END, 1, 4000) AS p FROM documents)""",
    "probabilities": f"""
SELECT vec_id, round(exp(v[1]) / z, 6) AS first_p, round(exp(list_max(v)) / z, 6) AS top_p,
       round(CASE WHEN v[1] * 100 BETWEEN 0 AND 1 THEN v[1] * 100 ELSE {_SIG.format(x='v[1] * 100')} END, 6) AS p,
       round(exp(v[2]) / (exp(v[1]) + exp(v[2])), 6) AS pair_p,
       round(1 - CASE WHEN v[1] * 100 BETWEEN 0 AND 1 THEN v[1] * 100 ELSE {_SIG.format(x='v[1] * 100')} END, 6) AS negated_p
FROM (SELECT *, list_sum(list_transform(v, lambda x: exp(x))) AS z FROM {_ROUNDED})""",
    "argmax_class": f"""
SELECT vec_id, CAST(list_position(v, top) - 1 AS INT) AS class_id,
       coalesce(['car-part-crack', 'deformation', 'flat-tire', 'glass-crack', 'lamp-crack', 'scratches'][list_position(v, top)],
                CAST(list_position(v, top) - 1 AS VARCHAR)) AS label, round(s, 6) AS score
FROM (SELECT *, CASE WHEN list_min(v) < 0 OR top > 1 THEN {_SIG.format(x='top')} ELSE top END AS s FROM (
  SELECT *, list_max(v) AS top FROM {_ROUNDED})) WHERE s >= 0.52""",
    "box_geometry": with_sql(DETECTIONS_SQL) + """
SELECT image_id, det_id, round(cx / 640, 4) AS fcx, round(w / 640, 4) AS fw, cx - w / 2 AS x1, cy + h / 2 AS y2,
       greatest(0, least((cx - w / 2) / 0.5, 1280)) AS ux1, greatest(0, least((cy - h / 2 - 80) / 0.5, 960)) AS uy1,
       greatest(0, least((cx + w / 2) / 0.5, 1280)) AS ux2, greatest(0, least((cy + h / 2 - 80) / 0.5, 960)) AS uy2,
       greatest(0, cx - w / 2 - 5) AS cx1, greatest(0, cy - h / 2 - 5) AS cy1, least(640, cx + w / 2 + 5) AS cx2, least(640, cy + h / 2 + 5) AS cy2
FROM detections""",
    "safe_utf8": "SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(65533) || 'A' ELSE 'B' END AS text FROM documents",
    "collect_texts": f"""
SELECT conv_id, turn, len(ts) + 1 AS n, array_to_string(list_prepend(role, ts), '|') AS texts FROM (
  SELECT conv_id, turn, role, list_filter(list_transform(string_split(text, chr(10)), lambda t: regexp_replace(regexp_replace(t, '^{SPACE_RE}', ''), '{SPACE_RE}$', '')), lambda t: t <> '') AS ts FROM conversations)""",
}
