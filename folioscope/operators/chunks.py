"""Retrieval chunks: pack the lines of a page or document into bounded texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.binding import let
from folioscope.functions.jsontext import json_sections
from folioscope.functions.text import collapse_ws, strip
from folioscope.rules import CHUNK_CHARS, CHUNK_OVERLAP

CHUNK_COLUMNS = ("source_file", "document_type", "chunk_id", "text", "metadata")


def chunk_lines(lines: Column, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Greedy packing of one row's line array into chunk texts.

    A chunk closes when the next line would pass ``max_chars``; the next chunk starts with
    the last ``overlap`` lines before the cut. The fold tracks only lengths and cut
    positions, and texts are sliced out afterwards, so no line is copied while folding.
    """
    used = F.filter(lines, lambda x: x.isNotNull() & (x != ""))
    empty = F.array().cast("array<int>")
    start = F.struct(
        F.lit(1).alias("begin"), F.lit(1).alias("next"), F.lit(0).alias("size"),
        empty.alias("recent"),
        F.array().cast("array<struct<lo:int,hi:int>>").alias("cuts"),
    )

    def step(acc: Column, line: Column) -> Column:
        length = F.length(line) + 1
        full = (acc["next"] > acc["begin"]) & (acc["size"] + length > max_chars)
        carried = F.aggregate(acc["recent"], F.lit(0), lambda s, n: s + n)
        cut = F.array(F.struct(acc["begin"].alias("lo"), (acc["next"] - 1).alias("hi")))
        grown = F.concat(acc["recent"], F.array(length))
        recent = F.when(F.size(grown) > overlap, F.slice(grown, 2, max(overlap, 1))).otherwise(grown)
        return F.struct(
            F.when(full, F.greatest(F.lit(1), acc["next"] - overlap)).otherwise(acc["begin"]).alias("begin"),
            (acc["next"] + 1).alias("next"),
            (F.when(full, carried).otherwise(acc["size"]) + length).alias("size"),
            (recent if overlap > 0 else empty).alias("recent"),
            F.when(full, F.concat(acc["cuts"], cut)).otherwise(acc["cuts"]).alias("cuts"),
        )

    def close(acc: Column) -> Column:
        last = F.array(F.struct(acc["begin"].alias("lo"), (acc["next"] - 1).alias("hi")))
        return F.when(acc["next"] > acc["begin"], F.concat(acc["cuts"], last)).otherwise(acc["cuts"])

    def slices(kept: Column) -> Column:
        folded = F.transform(
            F.aggregate(kept, start, step, close),
            lambda c: strip(F.array_join(F.slice(kept, c["lo"], c["hi"] - c["lo"] + 1), "\n")),
        )
        # Lines that fit together are one chunk without a fold.
        return let(F.array_join(kept, "\n"), lambda whole: F.when(F.length(whole) < max_chars, F.array(strip(whole))).otherwise(folded))

    return F.filter(let(used, slices), lambda t: t != "")


def _metadata(page: Column, index: Column, kind: Column) -> Column:
    return F.struct(page.cast("int").alias("page"), index.alias("chunk_index"), kind.alias("source_type"))


def chunk_pages(pages: DataFrame, source: Column, page: Column, texts: Column,
                max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of typed page rows; JVM only, no shuffle.

    The outer explode with a check afterwards keeps Spark from packing twice, once more for
    an inferred filter on empty arrays.
    """
    tidy = F.filter(F.transform(texts, collapse_ws), lambda t: t != "")
    kind = F.lit("ocr_pages")
    return (
        pages.select(source.alias("source_file"), page.alias("_page"), tidy.alias("_lines"))
        .select("source_file", "_page", F.posexplode_outer(chunk_lines(F.col("_lines"), max_chars, overlap)).alias("_i", "text"))
        .where(F.col("text").isNotNull())
        .withColumn("_i", F.col("_i") + 1)
        .select(
            "source_file", kind.alias("document_type"),
            F.format_string("page-%s-chunk-%d", F.col("_page").cast("string"), "_i").alias("chunk_id"),
            "text", _metadata(F.col("_page"), F.col("_i"), kind).alias("metadata"),
        )
    )


def parsed_documents(docs: DataFrame, source: str = "source_file", raw: str = "raw") -> DataFrame:
    """(source_file, parsed): JSON documents as sections of lines, parsed once for chunks and errors."""
    return docs.select(F.col(source).alias("source_file"), json_sections(F.col(raw)).alias("parsed"))


def chunks_of(parsed: DataFrame, max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, carried: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of parsed documents; bad pages leave the good pages of their document alone.

    ``carried`` names columns of the documents that every chunk keeps.
    """
    sections = parsed.select("source_file", *carried, F.col("parsed.document_type").alias("document_type"), F.explode_outer("parsed.sections").alias("_p"))
    paged = F.col("document_type") == "ocr_pages"
    packed = F.when(paged, chunk_lines(F.col("_p.lines"), max_chars, overlap)).otherwise(
        chunk_lines(F.col("_p.lines"), max_chars, 0)
    )
    page = F.coalesce(F.col("_p.page"), F.lit("None"))
    return (
        sections.select("source_file", *carried, "document_type", "_p", F.posexplode_outer(packed).alias("_i", "text"))
        .where(F.col("text").isNotNull())
        .withColumn("_i", F.col("_i") + 1)
        .select(
            "source_file", "document_type",
            F.when(paged, F.format_string("page-%s-chunk-%d", page, "_i"))
            .otherwise(F.format_string("chunk-%d", "_i")).alias("chunk_id"),
            "text",
            _metadata(F.col("_p.page").try_cast("int"), F.col("_i"), F.col("document_type")).alias("metadata"), *carried,
        )
    )


def path_lines(value: Column, kind: T.DataType, path: str | Column = "") -> Column:
    """The ``path: value`` lines of a value of known type: those of its JSON text with nulls, without writing and parsing it.

    Takes texts, whole numbers, and structs and arrays of them.
    """
    at = path if isinstance(path, Column) else F.lit(path)
    empty = F.array(F.concat(at, F.lit(": ")))
    if isinstance(kind, T.StructType):
        inner = [F.concat(at, F.lit(f".{f.name}")) if isinstance(path, Column) else f"{path}.{f.name}" if path else f.name for f in kind.fields]
        return F.when(value.isNull(), empty).otherwise(F.concat(*[path_lines(value[f.name], f.dataType, p) for f, p in zip(kind.fields, inner)]))
    if isinstance(kind, T.ArrayType):
        listed = F.flatten(F.transform(value, lambda v, i: path_lines(v, kind.elementType, F.concat(at, F.lit("["), (i + 1).cast("string"), F.lit("]")))))
        return F.when(value.isNull(), empty).when(F.size(value) == 0, F.array(F.concat(at, F.lit(": []")))).otherwise(listed)
    if not isinstance(kind, (T.StringType, T.IntegralType)):
        raise TypeError(f"no path lines of {kind.simpleString()}")
    return F.array(F.concat(at, F.lit(": "), collapse_ws(value) if isinstance(kind, T.StringType) else F.coalesce(value.cast("string"), F.lit(""))))


def struct_chunks(docs: DataFrame, source: Column, value: str, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of a struct column: those ``rag_chunks`` gives for its JSON text with nulls. JVM only."""
    kind = F.lit("structured_json")
    lines = path_lines(F.col(value), docs.schema[value].dataType)
    return (
        docs.select(source.alias("source_file"), lines.alias("_lines"))
        .select("source_file", F.posexplode_outer(chunk_lines(F.col("_lines"), max_chars, 0)).alias("_i", "text"))
        .where(F.col("text").isNotNull())
        .withColumn("_i", F.col("_i") + 1)
        .select("source_file", kind.alias("document_type"), F.format_string("chunk-%d", "_i").alias("chunk_id"), "text",
                _metadata(F.lit(None), F.col("_i"), kind).alias("metadata"))
    )


def found_errors(parsed: Column) -> Column:
    """Array of struct(position, error) of one parsed document; the document's own error has no position."""
    whole = F.array(F.struct(F.lit(None).cast("int").alias("position"), parsed["error"].alias("error")))
    pages = F.transform(parsed["sections"], lambda s, i: F.struct((i + 1).alias("position"), s["error"].alias("error")))
    return F.filter(F.concat(whole, F.coalesce(pages, F.slice(whole, 1, 0))), lambda e: e["error"].isNotNull())


def errors_of(parsed: DataFrame) -> DataFrame:
    """(source_file, position, error): documents that are no JSON, and pages without usable lines."""
    found = F.explode_outer(found_errors(F.col("parsed"))).alias("e")
    return parsed.select("source_file", found).where(F.col("e").isNotNull()).select("source_file", "e.*")


def rag_chunks(docs: DataFrame, source: str = "source_file", raw: str = "raw",
               max_chars: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks of JSON documents. Page documents chunk page by page with overlap; any other
    JSON becomes path lines without overlap. Python only parses; packing stays in the JVM.
    What cannot be chunked is in ``chunk_errors``."""
    return chunks_of(parsed_documents(docs, source, raw), max_chars, overlap)


def chunk_errors(docs: DataFrame, source: str = "source_file", raw: str = "raw") -> DataFrame:
    """Documents and pages that could not be chunked, with the reason."""
    return errors_of(parsed_documents(docs, source, raw))
