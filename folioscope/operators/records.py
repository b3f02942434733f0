"""Typed fields of vehicle registration cards, read from one row's array of line texts.

Every rule is an array or regular-expression column over the row, so a corpus is one
narrow projection: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import rules
from folioscope.functions.binding import let
from folioscope.functions.text import (
    EASTERN_DIGITS, ascii_digits, coerce_int, date_strings, issue_expiry, numeric_tokens, squeeze_key,
)
from folioscope.operators.lines import (
    any_label, first_index, normalized_lines, number_below, value_after, window_around,
)

_ARTIFACT = "|".join(rules.VIN_ARTIFACTS)
# Plain letters and digits are one look at a table; a class of ranges is asked range by range.
_GAP = rf"[\t-\x2d\x{{85}}-\x{{3000}}&&[\x20\-{rules.SPACE_CLASS}]]"
_CHUNKED_RUNS = rf"(?:\p{{Alnum}}{{2,}}+{_GAP}*+)++"
# Those runs, where group 1 is empty for any with more than 20 letters and digits, as most of prose are.
_OF_A_WORD = r"(?>\p{Alnum}(?=\p{Alnum})|(?<=\p{Alnum})\p{Alnum})"
_SHORT_RUNS = rf"(?=\p{{Alnum}}{{2}})(?:(?!(?:{_OF_A_WORD}{_GAP}*+){{21}}+)({_CHUNKED_RUNS})|{_CHUNKED_RUNS})"
# A candidate begins with its word, or where the one before ended in a longer word.
_UNBROKEN = r"(?:(?<!\p{Alnum})|\G)\p{Alnum}{11,20}+"

# What text without Arabic letters and digits of any script, as most prose is, has none of; then those letters and digits.
_WIDE = r"[0-9\x{600}-\x{ffff}]"
_NATIVE = rf"[\x{{600}}-\x{{feff}}&&[{rules.ARABIC_CLASS}]]"
_DIGIT = r"(?U)\d"
# The word NIL in either case, as (?iU) has it.
_NIL = r"(?U)[Nn](?<=\b[Nn])[Ii\x{130}\x{131}][Ll]\b"

_RUN_GAPS = "-" + "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def extract_vin(text: Column) -> Column:
    """Best chassis-number candidate of a text, null without one.

    Candidates are runs of words joined by spaces or dashes, then unbroken runs, 11 to 20
    letters and digits long and not made of header words. A 17-character run with letters
    and digits wins; then runs starting with a letter, the longest first.
    """
    # Lengths are checked before any rewriting: most runs of prose are far too long or short.
    runs = F.filter(F.regexp_extract_all(text, F.lit(_SHORT_RUNS), F.lit(1)), lambda r: F.length(r) >= 11)
    squeezed = F.transform(runs, lambda r: F.translate(r, _RUN_GAPS, ""))
    joined = F.transform(F.filter(squeezed, lambda c: F.length(c) <= 20), lambda c: F.upper(c))
    unbroken = F.transform(F.regexp_extract_all(text, F.lit(_UNBROKEN), F.lit(0)), lambda r: F.upper(r))

    def usable(c: Column) -> Column:
        header = c.rlike(rf"\A(?:{_ARTIFACT})|(?:{_ARTIFACT})\z") | c.isin(*rules.VIN_COMPOUND_ARTIFACTS)
        return F.length(c).between(11, 20) & ~header

    best = F.array_min(F.transform(
        F.array_distinct(F.filter(F.concat(joined, unbroken), usable)),
        lambda c, i: F.struct(
            F.when((F.length(c) == 17) & c.rlike("[A-Z]") & c.rlike("[0-9]"), 0).when(c.rlike("^[A-Z]"), 1).otherwise(2).alias("tier"),
            (-F.length(c)).alias("shortness"), i.alias("i"), c.alias("text"),
        ),
    ))
    return best["text"]


def _led(labels: tuple[str, ...]) -> str:
    """Pattern of any of the labels that asks for their first letters before it compares them."""
    heads = "".join(sorted({label[0] for label in labels}))
    return f"(?=[{heads}])(?:{'|'.join(re.escape(label) for label in labels)})"


# Latin labels are found in either case, as (?i) has it; the others have none.
_VIN_LABEL = "(?i)" + "|".join(
    [f"[{c.lower()}{c.upper()}]{label[1:]}" for label in rules.VIN_LABELS if (c := label[0]).isascii()]
    + [_led(tuple(label for label in rules.VIN_LABELS if not label.isascii()))]
)


def vin_of_lines(lines: Column, joined: Column) -> Column:
    """Label windows first, up to the first with a candidate; the whole text second."""
    at = F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda i: F.coalesce(F.get(lines, i).rlike(_VIN_LABEL), F.lit(False)),
    )
    near = F.aggregate(
        at, F.lit(None).cast("string"),
        lambda found, i: F.coalesce(found, extract_vin(F.array_join(window_around(lines, i, 2, 7), "\n"))),
    )
    return F.coalesce(F.when((F.size(lines) > 0) & joined.rlike(_VIN_LABEL), near), extract_vin(joined))


def plate_of_lines(lines: Column, joined_ascii: Column, numbers: Column) -> Column:
    """struct(plate_number, plate_text).

    Five digits and an Arabic letter anywhere override the label window; without either, the
    first plain number of plate size that is no year.
    """
    at = first_index(lines, lambda x, i: any_label(x, rules.PLATE_LABELS, rules.PLATE_LABEL_EXCLUDE))

    def from_window(window: Column) -> Column:
        digits = F.when(
            ~window.rlike(rules.LOOSE_DATE_PATTERN),
            _first(F.regexp_extract_all(window, F.lit(r"(?U)\b\d{3,7}\b"), F.lit(0))),
        )
        letters = F.filter(
            F.regexp_extract_all(
                window, F.lit(r"(?<![\x{0600}-\x{06FF}])[\x{0621}-\x{064A}]{1,3}(?![\x{0600}-\x{06FF}])"), F.lit(0)
            ),
            lambda t: ~t.isin(*rules.PLATE_TOKEN_SKIP),
        )
        return let(digits, lambda d: F.struct(d.alias("digits"), F.when(d.isNull(), _first(letters)).alias("letters")))

    labelled = let(at, lambda i: let(
        F.when(i >= 0, F.array_join(window_around(lines, i, 2, 3), " ")), from_window
    ))
    pattern = rf"([0-9]{{5}})[{rules.SPACE_CLASS}]*([\x{{0600}}-\x{{06FF}}])"
    paired = F.nullif(F.concat(F.regexp_extract(joined_ascii, pattern, 1), F.regexp_extract(joined_ascii, pattern, 2)), F.lit(""))
    large = F.filter(numbers, lambda v: v.between(10000, 9999999))
    small = F.filter(numbers, lambda v: v.between(100, 9999) & ~v.between(1900, 2100))
    plain = F.coalesce(_first(large), _first(small)).cast("string")
    return let(labelled, lambda w: F.struct(
        F.coalesce(paired, w["digits"], plain).alias("plate_number"), w["letters"].alias("plate_text"),
    ))


def manufacture_year(lines: Column, lines_ascii: Column) -> Column:
    """Year from the lines around a manufacture label; two digits are expanded at 30/31."""
    at = F.filter(
        F.sequence(F.lit(0), F.size(lines) - 1),
        lambda i: F.coalesce(any_label(F.get(lines, i), rules.YEAR_LABELS), F.lit(False)),
    )
    near = F.flatten(F.transform(at, lambda i: window_around(lines_ascii, i, 1, 4)))
    # An empty text is no number: its cast would raise and catch an error for every line.
    values = F.transform(near, lambda x: F.nullif(F.regexp_extract(x, r"(?U)\b\d{4}\b|\b0?\d{2,3}\b", 0), F.lit("")).try_cast("int"))
    years = F.transform(
        values, lambda v: F.when(v >= 1000, v).when(v <= 30, 2000 + v).when(v.between(31, 99), 1900 + v)
    )
    return F.when(F.size(lines) > 0, _first(F.filter(years, lambda y: y.isNotNull())))


def _first_contained(text: Column, words: tuple[str, ...], native: Column) -> Column:
    """First of the words in a text; those of other scripts are only looked for in ``native`` text."""
    return F.coalesce(*[F.when(text.contains(w) if w.isascii() else native & text.contains(w), w) for w in words])


def extract_record(df: DataFrame, lines: str = "lines", out: str = "record") -> DataFrame:
    """Add a struct with the 19 card fields. ``lines`` is an array of normalised texts, each without line breaks.

    Intermediate columns are staged so that no shared expression is evaluated twice; those compared with every
    element of an array are named first, as Spark writes a column used once into the place of its use. A text
    says once whether it has Arabic letters or digits at all: rules that need them leave other texts alone.
    """
    ln, asc, joined, nums, native, digits = (F.col(c) for c in (lines, "_asc", "_joined", "_nums", "_native", "_digits"))
    numbered = native & digits

    def near(label: str, reach: int, low: int, high: int) -> Column:
        return F.when(numbered, number_below(joined, label, reach, low, high))

    staged = (
        df.withColumn("_whole", F.array_join(ln, "\n", ""))
        .withColumn("_wide", F.col("_whole").rlike(_WIDE))
        .withColumn("_native", F.col("_wide") & F.col("_whole").rlike(_NATIVE)).withColumn("_digits", F.col("_wide") & F.col("_whole").rlike(_DIGIT))
        .withColumn("_eastern", native & digits & F.col("_whole").rlike(f"[{EASTERN_DIGITS}]"))
        .withColumn("_asc", F.when(F.col("_eastern"), F.transform(ln, ascii_digits)).otherwise(ln))
        .withColumn("_joined", F.when(F.col("_eastern"), ascii_digits(F.col("_whole"))).otherwise(F.col("_whole")))
        .withColumn("_nums", F.when(digits, F.filter(F.transform(numeric_tokens(joined, True), lambda n: n.try_cast("bigint")), lambda n: n.isNotNull())).otherwise(F.array().cast("array<bigint>")))
        .withColumn("_plate", F.when(native | digits, plate_of_lines(ln, joined, nums)))
        .withColumn("_dates", F.when(digits, issue_expiry(date_strings(joined, True))))
        .withColumn("_label_year", F.when(numbered & any_label(joined, rules.YEAR_LABELS), manufacture_year(ln, asc)))
        .withColumn("_own_number", coerce_int(F.col("_plate.plate_number")))
        .withColumn("_spec", let(F.col("_own_number"), lambda own: F.filter("_nums", lambda v: ~v.eqNullSafe(own))))
        .withColumn("_years", F.filter("_spec", lambda v: v.between(1900, 2100)))
        .withColumn("_model_year", _first(F.col("_years")).cast("int"))
        .withColumn("_year", F.coalesce("_label_year", F.try_element_at("_years", F.lit(-1)).cast("int")))
        .withColumn("_cc", F.coalesce(
            near(rules.ENGINE_LABEL, 4, 200, 10000),
            _first(F.filter("_spec", lambda v: v.between(200, 10000) & ~v.between(1900, 2100))).cast("int"),
        ))
        .withColumn("_loads", let(F.struct("_cc", "_model_year", "_year"), lambda own: F.filter("_spec", lambda v: (
            v.between(100, 100000) & ~v.eqNullSafe(own["_cc"]) & ~v.eqNullSafe(own["_model_year"]) & ~v.eqNullSafe(own["_year"])
        ))))
        .withColumn("_empty", F.coalesce(
            *[near(label, 4, 100, 10000) for label in rules.EMPTY_WEIGHT_LABELS],
            _first(F.col("_loads")).cast("int"),
        ))
    )
    loads = F.col("_loads")
    only_load = F.when((F.size(loads) == 1) & (F.col("_empty") == _first(loads)), _first(loads))
    max_load = F.coalesce(
        near(rules.MAX_LOAD_LABEL, 4, 100, 100000),
        F.when(F.size(loads) >= 2, F.get(loads, F.lit(1))).otherwise(only_load).cast("int"),
    )
    seats = F.coalesce(
        near(rules.SEATS_LABEL, 3, 1, 80),
        _first(F.filter("_spec", lambda v: v.between(1, 80) & (v != 2))).cast("int"),
    )
    origin = native & joined.contains(rules.ORIGIN_HEAD) & any_label(joined, rules.ORIGIN_TAILS)
    record = F.struct(
        F.col("_plate.plate_number").alias("plate_number"),
        F.col("_plate.plate_text").alias("plate_text"),
        F.when(native & joined.contains(rules.PRIVATE_TYPE), rules.PRIVATE_TYPE).alias("vehicle_type"),
        _first_contained(joined, rules.MAKES, native).alias("make"),
        _first_contained(joined, rules.MODELS, native).alias("model"),
        F.when(native & joined.contains(rules.COLOR_LABEL), value_after(ln, rules.COLOR_LABEL)).alias("color"),
        F.col("_year").alias("year"),
        F.col("_model_year").alias("model_year"),
        F.when(origin, rules.ORIGIN_VALUE).alias("country_of_origin"),
        vin_of_lines(ln, joined).alias("vin_or_chassis"),
        F.when(joined.rlike(_NIL), "NIL").alias("engine_number"),
        F.col("_cc").alias("engine_cc"),
        F.col("_empty").alias("empty_weight_kg"),
        max_load.alias("max_load_kg"),
        seats.alias("seats"),
        F.col("_dates.issue_date").alias("issue_date"),
        F.col("_dates.expiry_date").alias("expiry_date"),
        F.lit(None).cast("string").alias("owner_name"),
        F.lit(rules.EXTRACT_NOTE).alias("notes"),
    )
    return staged.withColumn(out, record).select(*df.columns, out)


def is_incomplete(record: Column) -> Column:
    """Any critical field null or empty."""
    missing = F.lit(False)
    for name in rules.CRITICAL_FIELDS:
        missing = missing | record[name].isNull() | (record[name].cast("string") == "")
    return missing


def with_fallback(docs: DataFrame, primary: str = "lines", auxiliary: str = "aux_lines", lang: str = "lang",
                  out: str = "record") -> DataFrame:
    """Extract; where a critical field is missing on an Arabic page, append the auxiliary
    lines and extract again. Complete rows pass an empty array, so the second pass costs
    only the rows that need it, and the input is read once.
    """
    arabic = F.lower(F.coalesce(F.col(lang), F.lit(""))).isin("ar", "arabic")
    once = extract_record(docs, primary, "_first_record")
    again = once.withColumn(
        "_more",
        arabic & is_incomplete(F.col("_first_record")) & (F.coalesce(F.size(auxiliary), F.lit(0)) > 0),
    ).withColumn("_all_lines", F.when(F.col("_more"), F.concat(primary, auxiliary)).otherwise(F.array().cast("array<string>")))
    twice = extract_record(again, "_all_lines", "_second_record")
    second = F.col("_second_record").withField("notes", F.lit(rules.AUXILIARY_NOTE))
    return (
        twice.withColumn(out, F.when(F.col("_more"), second).otherwise(F.col("_first_record")))
        .withColumn("auxiliary_ocr_lang", F.when(F.col("_more"), F.lit("en")))
        .select(*docs.columns, out, "auxiliary_ocr_lang")
    )


def validation_notes(record: Column, existing: Column | None = None) -> Column:
    """Notes on implausible fields after any existing ones; null when there is none."""
    vin, plate = record["vin_or_chassis"], record["plate_number"]
    plate_digits = F.length(F.regexp_replace(plate, r"(?U)\D", ""))
    empty, load = record["empty_weight_kg"], record["max_load_kg"]

    def outside(name: str, low: int, high: int, what: str) -> Column:
        v = record[name]
        return F.when(~v.between(low, high), F.concat(F.lit(f"{name}: "), v.cast("string"), F.lit(f" outside {what} range {low}-{high}")))

    def bad_date(name: str) -> Column:
        v = record[name]
        return F.when((v != "") & ~v.rlike(rules.LOOSE_DATE_PATTERN), F.concat(F.lit(f"{name}: "), v, F.lit(" does not match date pattern")))

    notes = F.filter(
        F.array(
            F.when((vin != "") & ~F.length(vin).between(11, 20),
                   F.concat(F.lit("vin_or_chassis: length "), F.length(vin).cast("string"), F.lit(" outside typical VIN range 11-20"))),
            F.when((plate != "") & ~plate_digits.between(3, 7),
                   F.concat(F.lit("plate_number: "), plate_digits.cast("string"), F.lit(" digits (expected 3-7)"))),
            outside("year", 1900, 2100, "valid"),
            outside("engine_cc", 200, 10000, "typical"),
            F.when((empty != 0) & (load != 0) & (empty > load), F.concat(
                F.lit("weights: empty_weight_kg ("), empty.cast("string"), F.lit(") > max_load_kg ("), load.cast("string"), F.lit(")"))),
            outside("seats", 1, 80, "valid"),
            bad_date("issue_date"),
            bad_date("expiry_date"),
        ),
        lambda n: n.isNotNull(),
    )
    if existing is not None:
        notes = F.concat(F.coalesce(existing, F.array().cast("array<string>")), notes)
    return F.when(F.size(notes) > 0, notes)


def annotate_lines(docs: DataFrame, lines: str = "lines", record: str = "record", key: str = "doc_id") -> DataFrame:
    """Which card field does each line show? One row per matching line.

    An exact match, or equal digits for numeric fields, decides at once in field order;
    otherwise the longest value that contains the line or lies in it. Lines and fields meet
    inside the document row, so there is no join.
    """
    def known(n: int, name: str) -> Column:
        return let(squeeze_key(F.col(record)[name].cast("string")), lambda k: F.struct(
            F.lit(n).alias("order"), F.lit(name).alias("field"), F.lit(rules.FIELD_LABELS_AR[name]).alias("label"),
            F.when(F.lit(name in rules.DIGIT_MATCH_FIELDS), _digits(k)).alias("digits"), k.alias("key"),
        ))

    values = F.array(*[known(n, name) for n, name in enumerate(rules.FIELD_LABELS_AR)])
    longest = F.array_sort(F.transform("_values", lambda v: F.struct((-F.length(v["key"])).alias("shortness"), v["order"].alias("order"), v["key"].alias("key"))))
    staged = (
        normalized_lines(docs.select(key, lines, record), F.col(lines), "_norm_lines")
        .withColumn("_values", F.filter(values, lambda v: v["key"] != ""))
        .withColumn("_known", F.struct(F.col("_values")["key"].alias("keys"), F.col("_values")["digits"].alias("digits"), longest["key"].alias("longest")))
        .withColumn("_keys", F.transform("_norm_lines", squeeze_key))
    )
    shown = staged.select(key, "_values", "_known.*", F.posexplode_outer(F.arrays_zip(F.col(lines).alias("text"), F.col("_keys").alias("key"))).alias("_i", "_line"))
    line = F.col("_line.key")

    def place(values: str, wanted: Column) -> Column:
        return F.nullif(F.array_position(values, wanted), F.lit(0))

    # A line that decides at once is looked up; only the others are compared with every value, the longest first.
    decisive = F.least(place("keys", line), place("digits", F.nullif(_digits(line), F.lit(""))))
    within = place("keys", _first(F.filter("longest", lambda v: line.contains(v) | v.contains(line))))
    best = F.get("_values", F.coalesce(decisive, within).cast("int") - 1)
    return (
        shown.where(line != "").select(key, (F.col("_i") + 1).alias("line_index"), F.col("_line.text").alias("text"), best.alias("_best"))
        .where(F.col("_best").isNotNull()).select(key, "line_index", "text", "_best.field", "_best.label")
    )


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\D", "")


def identity_score(text: Column, lowered: Column) -> Column:
    """struct(id_found, score) of the joined lines of one document.

    ``lowered`` is the lower-case text; one point each for a national id number, a birth
    date, a gender and an address term.
    """
    found = (
        text.rlike(rules.MASKED_ID_PATTERN) | text.rlike(rules.SPACED_ID_PATTERN)
        | F.regexp_replace(text, r"(?U)\D", "").rlike(r"\d{12}")
    )
    birth = lowered.rlike(rules.BIRTH_PATTERN) | lowered.rlike(rules.BIRTH_DATE_PATTERN)
    points = [found, birth, lowered.rlike(rules.GENDER_PATTERN), lowered.rlike(rules.ADDRESS_PATTERN)]
    score = sum((p.cast("int") for p in points[1:]), points[0].cast("int"))
    return F.struct(found.alias("id_found"), score.alias("score"))


def identity_of_lines(lines: Column) -> Column:
    """Null for a document without lines."""
    text = F.array_join(lines, " ")
    return F.when(F.size(lines) > 0, identity_score(text, F.lower(text)))
