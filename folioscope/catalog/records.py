"""Registered card-record queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.catalog.views import CARD_FIELDS_SQL, CARDS_SQL, cards, documents, ocr_documents, table, with_sql
from folioscope.operators import records as ops
from folioscope.operators.translate import translate, translate_ocr, translate_record as translate_fields
from folioscope.rules import (
    ARABIC_ENGLISH, AUXILIARY_NOTE, EXTRACT_NOTE, FIELD_LABELS_EN, RECORD_FIELDS, SPACE_CLASS, VIN_ARTIFACTS, VIN_COMPOUND_ARTIFACTS,
)

TEXT_FIELDS = ("plate_number", "plate_text", "vehicle_type", "make", "model", "color", "vin_or_chassis", "engine_number", "issue_date", "expiry_date")
NUMBER_FIELDS = ("year", "model_year", "engine_cc", "empty_weight_kg", "max_load_kg", "seats")


def _fields(df: DataFrame, texts=TEXT_FIELDS, numbers=NUMBER_FIELDS) -> DataFrame:
    return df.select(
        "doc_id", *[F.coalesce(f"record.{c}", F.lit("-")).alias(c) for c in texts],
        *[F.coalesce(f"record.{c}", F.lit(-1)).alias(c) for c in numbers],
    )


def _fields_sql(texts=TEXT_FIELDS, numbers=NUMBER_FIELDS) -> str:
    return ", ".join([f"coalesce({c}, '-') AS {c}" for c in texts] + [f"coalesce({c}, -1) AS {c}" for c in numbers])


def extract_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(ops.extract_record(cards(spark, sf_dir)))


def extract_plate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(ops.extract_record(cards(spark, sf_dir)), ("plate_number", "plate_text"), ())


def extract_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(ops.extract_record(cards(spark, sf_dir)), (), ("year", "model_year"))


def extract_vin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", ops.extract_vin(F.col("text")).alias("vin"))


def documents_as_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ocr_documents(spark, sf_dir).select("doc_id", F.col("lines")["text"].alias("lines"))
    return _fields(ops.extract_record(docs))


def validation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, n = F.col("p_partkey"), F.col("p_size")
    record = F.struct(
        F.repeat(F.lit("A"), (p % 25).cast("int")).alias("vin_or_chassis"), (p * 7).cast("string").alias("plate_number"),
        (1890 + n * 5).cast("int").alias("year"), (n * 300).cast("int").alias("engine_cc"), (n * 60).cast("int").alias("empty_weight_kg"),
        (p % 2000).cast("int").alias("max_load_kg"), (n * 2).cast("int").alias("seats"),
        F.when(p % 3 == 0, "2020-01-01").otherwise("2020/1/1").alias("issue_date"), F.lit(None).cast("string").alias("expiry_date"),
    )
    existing = F.when(p % 10 == 0, F.array(F.lit("earlier note")))
    rows = table(spark, sf_dir, "part").select("p_partkey", record.alias("record"), existing.alias("existing"))
    return rows.select("p_partkey", F.coalesce(F.array_join(ops.validation_notes(F.col("record"), F.col("existing")), "; "), F.lit("-")).alias("notes"))


def identity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ocr_documents(spark, sf_dir).select("doc_id", F.col("lines")["text"].alias("lines"))
    return docs.select("doc_id", ops.identity_of_lines(F.col("lines")).alias("s")).select("doc_id", "s.id_found", "s.score")


def auxiliary_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that lose their last five lines on every third document, with auxiliary lines."""
    k = F.col("doc_id")
    short = F.when(k % 3 == 0, F.slice("lines", 1, 18)).otherwise(F.col("lines"))
    aux = F.when(k % 9 != 0, F.array(F.lit("CHASSIS"), F.concat(F.lit("ZZ1AAAAAAAAAAAA"), F.lpad((k % 100).cast("string"), 2, "0")), F.lit("2001/01/02"), F.lit("2003/04/05")))
    return cards(spark, sf_dir).select("doc_id", short.alias("lines"), aux.alias("aux_lines"), F.when(k % 2 == 0, "ar").otherwise("en").alias("lang"))


def auxiliary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.with_fallback(auxiliary_cards(spark, sf_dir))
    return out.select(
        "doc_id", F.coalesce("record.vin_or_chassis", F.lit("-")).alias("vin"), F.coalesce("record.issue_date", F.lit("-")).alias("issue_date"),
        "record.notes", F.coalesce("auxiliary_ocr_lang", F.lit("-")).alias("auxiliary"),
    )


def translate_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation of a card: a row for each field of its record and for each of its OCR lines, which carry the line count."""
    docs = cards(spark, sf_dir)
    entries = ops.extract_record(docs).select("doc_id", F.explode(translate_fields(F.col("record"))).alias("e"))
    line = lambda t, i: F.struct(
        t.alias("text"), (((F.col("doc_id") * 31 + (i + 1) * 17) % 101) / 100.0).alias("confidence"))
    lines = translate_ocr(docs.select("doc_id", F.transform("lines", line).alias("lines")))
    fields = entries.select("doc_id", F.lit("field").alias("part"), "e.field", "e.label", "e.value", "e.translation")
    texts = lines.select(
        "doc_id", F.lit("line").alias("part"), F.col("text").alias("value"), "translation", "page", "line_index", "line_count", "confidence")
    return fields.unionByName(texts, allowMissingColumns=True).fillna("-", ["field", "label", "value", "translation"]).fillna(
        -1, ["page", "line_index", "line_count", "confidence"])


def translate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = cards(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("pos", "text"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_index"), translate(F.col("text")).alias("translation"))


QUERIES = {
    "extract_record": extract_record,
    "extract_plate": extract_plate,
    "extract_years": extract_years,
    "extract_vin": extract_vin,
    "extract_documents": documents_as_cards,
    "validation_notes": validation_notes,
    "identity_score": identity_score,
    "auxiliary_fallback": auxiliary_fallback,
    "translate_record": translate_record,
    "translate_lines": translate_lines,
}

_PAIRS = "(VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in ARABIC_ENGLISH.items()) + ") d(src, dst)"
_REPLACED = "".join("replace(" for _ in ARABIC_ENGLISH) + "{0}" + "".join(
    f", '{s}', '{t}')" for s, t in sorted(ARABIC_ENGLISH.items(), key=lambda kv: -len(kv[0])))
_B, _E = "(?:^|[^\\p{L}\\p{N}_])", "(?:$|[^\\p{L}\\p{N}_])"
_NUMERIC = set(NUMBER_FIELDS)


def _field_rows() -> str:
    parts = []
    for f in RECORD_FIELDS:
        source = {"country_of_origin": "CAST(NULL AS VARCHAR)", "owner_name": "CAST(NULL AS VARCHAR)", "notes": f"'{EXTRACT_NOTE}'"}.get(f, f"CAST({f} AS VARCHAR)")
        label = FIELD_LABELS_EN.get(f, f.replace("_", " ").title())
        parts.append(f"SELECT doc_id, '{f}' AS field, '{label}' AS label, {source} AS value, {str(f in _NUMERIC).lower()} AS num FROM card_fields")
    return " UNION ALL ".join(parts)


# Candidates of a text: word runs without their gaps, then unbroken runs; the least (tier, shortness, place) speaks.
_HEADER = "|".join(VIN_ARTIFACTS)
_VIN_SQL = f"""
SELECT doc_id, list_sort(list_transform(list_filter(candidates, lambda c: length(c) BETWEEN 11 AND 20 AND NOT regexp_matches(c, '\\A(?:{_HEADER})|(?:{_HEADER})\\z')
         AND c NOT IN ({", ".join(f"'{c}'" for c in VIN_COMPOUND_ARTIFACTS)})), lambda c, i: {{
         'tier': CASE WHEN length(c) = 17 AND regexp_matches(c, '[A-Z]') AND regexp_matches(c, '[0-9]') THEN 0 WHEN regexp_matches(c, '^[A-Z]') THEN 1 ELSE 2 END,
         'short': -length(c), 'i': i, 'vin': c}}))[1].vin AS vin
FROM (SELECT doc_id, list_concat(
        list_transform(regexp_extract_all(text, '(?:[A-Za-z0-9]{{2,}}[{SPACE_CLASS}\\-]*)+'), lambda r: upper(regexp_replace(r, '[{SPACE_CLASS}\\-]', '', 'g'))),
        list_transform(regexp_extract_all(text, '[A-Za-z0-9]{{11,20}}'), lambda r: upper(r))) AS candidates FROM documents)"""

ORACLES = {
    "extract_vin": _VIN_SQL,
    "extract_record": with_sql(CARDS_SQL, CARD_FIELDS_SQL) + f"SELECT doc_id, {_fields_sql()} FROM card_fields",
    "extract_plate": with_sql(CARDS_SQL, CARD_FIELDS_SQL) + f"SELECT doc_id, {_fields_sql(('plate_number', 'plate_text'), ())} FROM card_fields",
    "extract_years": with_sql(CARDS_SQL, CARD_FIELDS_SQL) + f"SELECT doc_id, {_fields_sql((), ('year', 'model_year'))} FROM card_fields",
    "validation_notes": """
SELECT p_partkey, CASE WHEN len(n) = 0 THEN '-' ELSE array_to_string(n, '; ') END AS notes FROM (
  SELECT p_partkey, list_filter([
    CASE WHEN p_partkey % 10 = 0 THEN 'earlier note' END,
    CASE WHEN p_partkey % 25 <> 0 AND NOT p_partkey % 25 BETWEEN 11 AND 20 THEN 'vin_or_chassis: length ' || p_partkey % 25 || ' outside typical VIN range 11-20' END,
    CASE WHEN NOT length(CAST(p_partkey * 7 AS VARCHAR)) BETWEEN 3 AND 7 THEN 'plate_number: ' || length(CAST(p_partkey * 7 AS VARCHAR)) || ' digits (expected 3-7)' END,
    CASE WHEN NOT 1890 + p_size * 5 BETWEEN 1900 AND 2100 THEN 'year: ' || (1890 + p_size * 5) || ' outside valid range 1900-2100' END,
    CASE WHEN NOT p_size * 300 BETWEEN 200 AND 10000 THEN 'engine_cc: ' || p_size * 300 || ' outside typical range 200-10000' END,
    CASE WHEN p_partkey % 2000 <> 0 AND p_size <> 0 AND p_size * 60 > p_partkey % 2000 THEN 'weights: empty_weight_kg (' || p_size * 60 || ') > max_load_kg (' || p_partkey % 2000 || ')' END,
    CASE WHEN NOT p_size * 2 BETWEEN 1 AND 80 THEN 'seats: ' || p_size * 2 || ' outside valid range 1-80' END,
    CASE WHEN p_partkey % 3 = 0 THEN 'issue_date: 2020-01-01 does not match date pattern' END], lambda x: x IS NOT NULL) AS n FROM part)""",
    "identity_score": f"""
SELECT doc_id, f AS id_found, CAST(f AS INT) + CAST(b AS INT) + CAST(g AS INT) + CAST(a AS INT) AS score FROM (
  SELECT doc_id, regexp_matches(t, '(?:x{{4}}|X{{4}}|\\*{{4}})\\s*(?:x{{4}}|X{{4}}|\\*{{4}})\\s*[0-9]{{4}}') OR regexp_matches(t, '{_B}[0-9]{{4}}\\s+[0-9]{{4}}\\s+[0-9]{{4}}{_E}')
           OR regexp_matches(regexp_replace(t, '[^0-9]', '', 'g'), '[0-9]{{12}}') AS f,
         regexp_matches(l, '{_B}(?:dob|date of birth|year of birth|yob|birth){_E}') OR regexp_matches(l, '{_B}[0-9]{{2}}[/-][0-9]{{2}}[/-][0-9]{{4}}{_E}') AS b,
         regexp_matches(l, '{_B}(?:male|female|transgender|m|f){_E}') AS g, regexp_matches(l, '{_B}(?:address|s/o|d/o|w/o|c/o|pin|pincode){_E}') AS a
  FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t, lower(replace(text, chr(10), ' ')) AS l FROM documents))""",
    "auxiliary_fallback": with_sql(CARDS_SQL) + f"""
SELECT doc_id, CASE WHEN again AND k % 3 = 0 THEN 'ZZ1AAAAAAAAAAAA' || lpad(CAST(k % 100 AS VARCHAR), 2, '0') WHEN k % 3 = 0 THEN '-' ELSE vin END AS vin,
       CASE WHEN again THEN '2001/01/02' WHEN k % 3 = 0 THEN '-' ELSE issued END AS issue_date,
       CASE WHEN again THEN '{AUXILIARY_NOTE}' ELSE '{EXTRACT_NOTE}' END AS notes, CASE WHEN again THEN 'en' ELSE '-' END AS auxiliary
FROM (SELECT *, (k % 3 = 0 OR k % 8 = 0) AND k % 9 <> 0 AND k % 2 = 0 AS again FROM cards)""",
    "translate_record": with_sql(CARDS_SQL, CARD_FIELDS_SQL) + f"""
SELECT doc_id, 'field' AS part, field, label, coalesce(value, '-') AS value, coalesce(CASE WHEN num THEN value WHEN d.dst IS NOT NULL THEN d.dst ELSE {_REPLACED.format('value')} END, '-') AS translation,
       -1 AS page, -1 AS line_index, -1 AS line_count, -1.0e0 AS confidence
FROM ({_field_rows()}) f LEFT JOIN {_PAIRS} ON f.value = d.src
UNION ALL
SELECT doc_id, 'line', '-', '-', coalesce(text, '-'), coalesce(d.dst, {_REPLACED.format('text')}, '-'),
       1, line_index, line_count, coalesce((doc_id * 31 + line_index * 17) % 101 / 100.0e0, -1)
FROM (SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) AS line_index, len(lines) AS line_count FROM cards) l LEFT JOIN {_PAIRS} ON l.text = d.src""",
    "translate_lines": with_sql(CARDS_SQL) + f"""
SELECT doc_id, line_index, coalesce(d.dst, {_REPLACED.format('text')}) AS translation FROM (
  SELECT doc_id, unnest(lines) AS text, generate_subscripts(lines, 1) AS line_index FROM cards) l LEFT JOIN {_PAIRS} ON l.text = d.src""",
}
