"""Dictionary translation of fields and lines."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.binding import let
from folioscope.functions.text import collapse_ws
from folioscope.operators.lines import all_lines
from folioscope.rules import ARABIC_ENGLISH, FIELD_LABELS_EN, RECORD_FIELDS


def translate_exact(df: DataFrame, text: str, dictionary: DataFrame) -> DataFrame:
    """Whole-text lookup after whitespace collapse: null stays null, blank stays blank.

    ``dictionary`` has source and target; Spark broadcasts it when its size allows.
    """
    return (
        df.withColumn("_key", collapse_ws(F.col(text)))
        .join(dictionary.select(F.col("source").alias("_key"), F.col("target").alias("_target")), "_key", "left")
        .withColumn("translation", F.when(F.col(text).isNotNull(), F.when(F.col("_key") == "", "").otherwise(F.col("_target"))))
        .drop("_key", "_target")
    )


def _longest_first(pairs: dict[str, str]) -> list[tuple[str, str]]:
    return sorted(pairs.items(), key=lambda kv: -len(kv[0]))


def translate(c: Column, pairs: dict[str, str] | None = None) -> Column:
    """Exact hit, else every source replaced in falling length, later rules seeing earlier output.

    Text without the first letter of any source skips the replacement chain.
    """
    pairs = ARABIC_ENGLISH if pairs is None else pairs
    heads = "".join(re.escape(h) for h in sorted({source[0] for source in pairs}))
    whole = F.create_map(*[F.lit(x) for x in chain(*pairs.items())])

    def apply(tidy: Column) -> Column:
        replaced = reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), _longest_first(pairs), tidy)
        return F.when(~tidy.rlike(f"[{heads}]"), tidy).otherwise(F.coalesce(F.element_at(whole, tidy), replaced))

    return F.when(c.isNotNull(), let(collapse_ws(c), apply))


def translate_record(record: Column, pairs: dict[str, str] | None = None) -> Column:
    """Array of (field, label, value, translation) for the fields of a record struct."""
    text_fields = {"year", "model_year", "engine_cc", "empty_weight_kg", "max_load_kg", "seats"}

    def entry(name: str) -> Column:
        value = record[name].cast("string")
        return F.struct(
            F.lit(name).alias("field"),
            F.lit(FIELD_LABELS_EN.get(name, name.replace("_", " ").title())).alias("label"),
            value.alias("value"),
            (value if name in text_fields else translate(record[name], pairs)).alias("translation"),
        )

    return F.array(*[entry(name) for name in RECORD_FIELDS])


def translate_lines(lines: DataFrame, pairs: dict[str, str] | None = None) -> DataFrame:
    """Line rows with their translation."""
    return lines.withColumn("translation", translate(F.col("text"), pairs))


def translate_ocr(docs: DataFrame, key: str = "doc_id", pairs: dict[str, str] | None = None) -> DataFrame:
    """The translated line list of OCR documents: (key, line_count, page, line_index, text, translation, confidence).

    Each line carries the number of lines of its document, counted in the row; a document without lines has one row with 0 and nulls.
    """
    listed = docs.select(key, all_lines(docs).alias("_lines"))
    rows = listed.select(key, F.size("_lines").alias("line_count"), F.explode_outer("_lines").alias("_line")).select(key, "line_count", "_line.*")
    return translate_lines(rows, pairs).select(key, "line_count", "page", "line_index", "text", "translation", "confidence")
