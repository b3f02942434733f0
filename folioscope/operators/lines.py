"""OCR lines. A document (or page) stays one row; its lines are an array in that row.

Nothing here regroups exploded lines, so one very long document never turns into a
shuffle key: row-local array expressions do the work, and the explode is narrow.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.binding import let
from folioscope.functions.text import ascii_digits, clean_plate, normalize_text, strip
from folioscope.rules import DIGIT_ALLOWLIST, FIELD_LABEL_TERMS, LETTER_ALLOWLIST

LINE = "struct<text:string,confidence:double>"
OCR_DOCUMENT = f"struct<pages:array<struct<page:int,lines:array<{LINE}>>>,page:int,lines:array<{LINE}>>"


def parse_ocr(df: DataFrame, raw: str = "raw") -> DataFrame:
    """OCR JSON text to typed ``pages`` / ``page`` / ``lines`` columns."""
    doc = F.from_json(F.col(raw), OCR_DOCUMENT)
    return df.withColumn("_doc", doc).select("*", "_doc.pages", "_doc.page", "_doc.lines").drop("_doc")


def _all_pages(docs: DataFrame) -> Column:
    have = set(docs.columns)
    pages = F.col("pages") if "pages" in have else F.lit(None).cast(f"array<struct<page:int,lines:array<{LINE}>>>")
    page = F.col("page") if "page" in have else F.lit(None).cast("int")
    lines = F.col("lines") if "lines" in have else F.lit(None).cast(f"array<{LINE}>")
    single = F.array(F.struct(F.coalesce(page, F.lit(1)).alias("page"), lines.alias("lines")))
    return F.when(pages.isNotNull(), pages).otherwise(single)


def all_lines(docs: DataFrame) -> Column:
    """Array form of ``flatten_lines``: (page, line_index, text, confidence) of every line of a document."""
    def numbered(p: Column) -> Column:
        return F.filter(F.transform(p["lines"], lambda x, i: F.when(x.isNotNull(), F.struct(
            p["page"].alias("page"), (i + 1).alias("line_index"), x["text"].alias("text"), x["confidence"].alias("confidence")))), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.filter(_all_pages(docs), lambda p: p["lines"].isNotNull()), numbered))


def flatten_lines(docs: DataFrame, key: str | Sequence[str] = "doc_id") -> DataFrame:
    """One row per line: (key, page, line_index, text, confidence).

    Page form wins over top-level lines; the index counts entries that are no objects.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return (
        docs.select(*keys, F.explode_outer(_all_pages(docs)).alias("_page"))
        .select(*keys, F.col("_page.page").alias("page"), F.posexplode_outer("_page.lines").alias("_pos", "_line"))
        .where(F.col("_line").isNotNull())
        .select(
            *keys, "page", (F.col("_pos") + 1).alias("line_index"),
            F.col("_line.text").alias("text"), F.col("_line.confidence").alias("confidence"),
        )
    )


def confident_lines(lines: DataFrame, min_conf: float = 0.5) -> DataFrame:
    """Lines at or above the confidence, normalised, blanks dropped (filter before Python)."""
    return (
        lines.where(F.col("confidence") >= min_conf)
        .withColumn("text", normalize_text(F.col("text")))
        .where(F.col("text") != "")
    )


# Fixed value: a private-use character that separates lines inside one joined text.
LINE_MARK = "\ue000"


def normalized_lines(df: DataFrame, texts: Column, out: str) -> DataFrame:
    """Add an array with the normalised form of every text, positions kept.

    A row's lines cross to Python joined as one text, so nothing is exploded and regrouped.
    """
    marked = F.transform(texts, lambda t: F.replace(F.coalesce(t, F.lit("")), F.lit(LINE_MARK), F.lit("")))
    parts = F.transform(F.split("_norm", LINE_MARK), lambda t: F.trim(t))
    empty = F.array().cast("array<string>")
    return (
        df.withColumn("_raw", F.array_join(marked, LINE_MARK)).withColumn("_norm", normalize_text(F.col("_raw")))
        .withColumn("_n", F.size(texts)).withColumn(out, F.when(F.col("_n") > 0, parts).otherwise(empty))
        .drop("_raw", "_norm", "_n")
    )


def confident_texts(lines: Column, min_conf: float = 0.5) -> Column:
    """Array form of the confidence filter: texts of the kept line structs, in order."""
    kept = F.filter(lines, lambda x: x["confidence"] >= min_conf)
    return F.transform(kept, lambda x: x["text"])


def mean_confidence(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean over page lines and top-level lines; 0.0 when there is none.

    Each row first folds to (sum, count), so only two numbers per row are shuffled.
    """
    have = set(docs.columns)
    parts = []
    if "pages" in have:
        parts.append(F.coalesce(F.flatten(F.transform("pages", lambda p: F.coalesce(p["lines"]["confidence"], F.array().cast("array<double>")))), F.array().cast("array<double>")))
    if "lines" in have:
        parts.append(F.coalesce(F.col("lines")["confidence"], F.array().cast("array<double>")))
    values = F.filter(F.concat(*parts), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return (
        docs.select(key, total.alias("_sum"), F.size(values).alias("_n"))
        .groupBy(key)
        .agg(F.sum("_sum").alias("_sum"), F.sum("_n").alias("_n"))
        .select(
            key, F.coalesce(F.try_divide("_sum", "_n"), F.lit(0.0)).alias("mean_confidence"),
            F.col("_n").alias("line_count"),
        )
    )


def page_stats(pages: DataFrame, keys: Sequence[str] = ("doc_id", "page"), text_layer: str | None = None,
               count_text_layer: bool = True) -> DataFrame:
    """Per page row: line count and mean / min / max confidence (0.0 for an empty page).

    ``text_layer`` names a boolean column for pages read from an embedded text layer: their
    confidences are 1.0; with ``count_text_layer=False`` they report 0 lines.
    """
    conf = F.filter(F.col("lines")["confidence"], lambda v: v.isNotNull())
    n = F.size(conf)
    mean = F.try_divide(F.aggregate(conf, F.lit(0.0), lambda acc, v: acc + v), n)

    layer = F.coalesce(F.col(text_layer), F.lit(False)) if text_layer else F.lit(False)
    lines = F.greatest(n, F.lit(0)) if count_text_layer else F.when(layer, 0).otherwise(F.greatest(n, F.lit(0)))

    def stat(v: Column) -> Column:
        return F.when(layer, 1.0).otherwise(F.coalesce(v, F.lit(0.0)))

    return pages.select(
        *keys, lines.alias("lines"), stat(mean).alias("conf_mean"),
        stat(F.array_min(conf)).alias("conf_min"), stat(F.array_max(conf)).alias("conf_max"),
        F.when(layer, F.lit("pdf_text_layer")).alias("error"),
    )


def reading_order(boxes: Column, rtl: bool = False) -> Column:
    """Order the line boxes of one page: rows top-down, then along the row.

    ``boxes`` is an array of structs with x0, y0, x1, y1. Boxes enter by falling centre and join
    the row whose running mean centre is within the tolerance. A row that one box lies too far
    below is out of reach of all that follow, so the fold carries a single open row and the
    positions where rows begin; each row is then sorted by itself. Boxes without a centre come
    first, each a row of its own.
    """
    heights = F.sort_array(F.transform(boxes, lambda b: F.greatest(F.lit(1.0), b["y1"] - b["y0"])))
    median = let(heights, lambda h: F.get(h, F.floor(F.size(h) / 2).cast("int")))
    tolerance = F.greatest(F.lit(8.0), 0.6 * median)
    by_centre = F.sort_array(
        F.transform(boxes, lambda b, i: F.struct(((b["y0"] + b["y1"]) / 2.0).alias("yc"), i.alias("i")))
    )
    start = F.struct(
        F.lit(None).cast("double").alias("yc"), F.lit(0.0).alias("n"), F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts"),
    )

    def placer(tol: Column):
        def place(acc: Column, b: Column) -> Column:
            return let(F.coalesce(F.abs(b["yc"] - acc["yc"]) <= tol, F.lit(False)), lambda near: F.struct(
                F.when(near, (acc["yc"] * acc["n"] + b["yc"]) / (acc["n"] + 1.0)).otherwise(b["yc"]).alias("yc"),
                F.when(near, acc["n"] + 1.0).otherwise(1.0).alias("n"), (acc["at"] + 1).alias("at"),
                F.when(near, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["at"]))).alias("starts"),
            ))

        return place

    def along(p: Column, at: Column) -> Column:
        box = F.get(boxes, p["i"])
        return F.struct((-box["x1"] if rtl else box["x0"]).alias("x"), at.alias("at"), box.alias("box"))

    def rows(sorted_boxes: Column, starts: Column) -> Column:
        def row(s: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(sorted_boxes) + 1)
            return F.sort_array(F.transform(F.slice(sorted_boxes, s, end - s), along))["box"]

        return F.flatten(F.transform(starts, row))

    def crowded(c: Column, tol: Column) -> Column:
        """Is any box as near to the one before it as boxes of one row are?"""
        return F.exists(F.zip_with(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), c, lambda b, a: F.coalesce(F.abs(b["yc"] - a["yc"]) <= tol, F.lit(False))), lambda near: near)

    def ordered(c: Column, tol: Column) -> Column:
        # Where every box is a row of its own, as on cards and single columns, the centres alone give the order.
        folded = let(F.aggregate(c, start, placer(tol), lambda acc: acc["starts"]), lambda starts: rows(c, starts))
        return F.when(crowded(c, tol), folded).otherwise(F.transform(c, lambda p: F.get(boxes, p["i"])))

    return let(by_centre, lambda c: let(tolerance, lambda tol: ordered(c, tol)))


def first_index(lines: Column, test) -> Column:
    """Zero-based position of the first line that passes, -1 if none does."""
    return F.array_position(F.transform(lines, lambda x, i: F.coalesce(test(x, i), F.lit(False))), True).cast("int") - 1


def value_after(lines: Column, keyword: str) -> Column:
    """The line after the first keyword line that has one, stripped; empty gives null."""
    at = first_index(lines, lambda x, i: x.contains(keyword) & (i < F.size(lines) - 1))
    return let(at, lambda i: F.when(i >= 0, F.nullif(strip(F.get(lines, i + 1)), F.lit(""))))


def window_around(lines: Column, at: Column, before: int, after: int) -> Column:
    """Lines ``at - before`` to ``at + after``, cut at the ends of the document."""
    start = F.greatest(at - before, F.lit(0))
    return F.slice(lines, start + 1, at + after + 1 - start)


def label_context(lines: Column, labels: Sequence[str], before: int, after: int, sep: str = "\n",
                  exclude: str | None = None) -> Column:
    """Text around the first usable label line; null when there is none."""
    at = first_index(lines, lambda x, i: any_label(x, labels, exclude))
    return let(at, lambda i: F.when(i >= 0, F.array_join(window_around(lines, i, before, after), sep)))


def any_label(line: Column, labels: Sequence[str], exclude: str | None = None) -> Column:
    hit = line.rlike("|".join(re.escape(label) for label in labels))
    return hit & ~line.contains(exclude) if exclude else hit


def number_near(lines: Column, keyword: str, reach: int = 4, low: int | None = None, high: int | None = None,
                stop_terms: Sequence[str] = FIELD_LABEL_TERMS) -> Column:
    """First 1-5 digit number in bounds at or below a keyword line.

    A later line that is itself a field label ends the search for that keyword line.
    """
    one = F.transform(lines, lambda x: F.translate(F.coalesce(x, F.lit("")), "\n", "\r"))
    text = ascii_digits(F.array_join(one, "\n"))
    return F.when(F.size(lines) > 0, let(text, lambda t: number_below(t, keyword, reach, low, high, stop_terms)))


def number_below(text: Column, keyword: str, reach: int = 4, low: int | None = None, high: int | None = None,
                 stop_terms: Sequence[str] = FIELD_LABEL_TERMS) -> Column:
    """``number_near`` of lines joined by line feeds, with plain digits."""
    def in_bounds(v: Column) -> Column:
        ok = v.isNotNull()
        if low is not None:
            ok = ok & (v >= low)
        if high is not None:
            ok = ok & (v <= high)
        return ok

    def numbers(window: Column) -> Column:
        runs = F.regexp_extract_all(window, F.lit(r"(?U)\b\d{1,5}\b"), F.lit(0))
        return F.filter(F.transform(runs, lambda r: r.try_cast("int")), in_bounds)

    # A window is only looked at, so those of neighbouring keyword lines may overlap.
    stops = "|".join(re.escape(term) for term in stop_terms)
    window = rf"(?md)^(?=[^\n]*?{re.escape(keyword)})(?=([^\n]*+(?:\n(?![^\n]*?(?:{stops}))[^\n]*+){{0,{reach - 1}}}+))"
    windows = F.regexp_extract_all(text, F.lit(window), F.lit(1))
    return F.when(text.contains(keyword), F.get(F.flatten(F.transform(windows, numbers)), F.lit(0)))


def plate_text(fragments: Column, regional: bool = False) -> Column:
    """Plate string and mean confidence from one plate's fragments.

    Fragments are structs with text, confidence and, for regional plates, zone and x.
    Regional plates read zone 1 as digits, then zone 2 as letters, left to right;
    standard plates keep the detector order.
    """
    if regional:
        ordered = F.array_sort(
            F.transform(
                fragments,
                lambda f, i: F.struct(
                    f["zone"].alias("zone"), f["x"].alias("x"), i.alias("i"), f["text"].alias("text"),
                    f["confidence"].alias("confidence"),
                ),
            )
        )

        def cleaned(f: Column) -> Column:
            return F.when(f["zone"] == 1, clean_plate(f["text"], DIGIT_ALLOWLIST)).otherwise(
                clean_plate(f["text"], LETTER_ALLOWLIST)
            )
    else:
        ordered = fragments

        def cleaned(f: Column) -> Column:
            return clean_plate(f["text"])

    parts = F.filter(
        F.transform(ordered, lambda f: F.struct(cleaned(f).alias("text"), f["confidence"].alias("confidence"))),
        lambda f: f["text"] != "",
    )

    def summary(kept: Column) -> Column:
        mean = F.try_divide(F.aggregate(kept["confidence"], F.lit(0.0), lambda acc, v: acc + v), F.size(kept))
        return F.struct(
            F.array_join(kept["text"], " ").alias("plate_text"),
            F.round(F.coalesce(mean, F.lit(0.0)), 4).alias("confidence"),
        )

    return let(parts, summary)
