"""File sources: inventory, JSON corpora, images, tabular previews, archive listings."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.imageheader import UNKNOWN, TooShort, image_header
from folioscope.operators.routing import base_name, media_type, suffix_of
from folioscope.sources.ranges import FileView, open_file

HEAD_BYTES = 256 * 1024
TAIL_BYTES = 1024 * 1024
HEADER = "width int, height int, mode string, error string"
PREVIEW = "rows array<array<string>>, error string, complete boolean"
LISTING = "entries array<string>, error string, complete boolean"


def read_files(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Every file below the paths; ``content`` is only read when a later step asks for it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load([paths] if isinstance(paths, str) else list(paths))


def file_inventory(files: DataFrame, declared: Column | None = None) -> DataFrame:
    """filename, extension, size and media type of binary-file rows."""
    name = base_name(F.col("path"))
    return files.select(
        "path", name.alias("filename"), suffix_of(name).alias("extension"),
        F.col("length").alias("size_bytes"), media_type(name, declared).alias("mime_type"),
    )


def read_json_corpus(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, raw) of every JSON document in directories and single files, each once.

    Overlapping inputs are settled on the path list, so no content is shuffled to drop
    duplicates. Inputs ending in .json (any case) are files, all others directories.
    """
    given = list(dict.fromkeys(p.rstrip("/") for p in paths))
    folders = [p for p in given if not p.lower().endswith(".json")]
    folders = [p for p in folders if not any(p != q and p.startswith(q + "/") for q in folders)]
    inside = tuple(f"{d}/" for d in folders)
    files = [p for p in given if p.lower().endswith(".json") and not (p.startswith(inside) and p.endswith(".json"))]

    def load(names: list[str], pattern: str | None) -> DataFrame:
        reader = spark.read.option("wholetext", True)
        if pattern:
            reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
        return reader.text(names).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))

    parts = ([load(folders, "*.json")] if folders else []) + ([load(files, None)] if files else [])
    if not parts:
        raise ValueError("no JSON files or directories given")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def distinct_inputs(*frames: DataFrame, key: str = "path") -> DataFrame:
    """Union of inputs, each key once; the earliest input that has it wins."""
    tagged = [f.withColumn("_input", F.lit(n)) for n, f in enumerate(frames)]
    union = tagged[0]
    for frame in tagged[1:]:
        union = union.unionByName(frame)
    columns = [c for c in frames[0].columns if c != key]
    first = F.min_by(F.struct(*columns), "_input") if columns else F.min("_input")
    rows = union.groupBy(key).agg(first.alias("_row"))
    return rows.select(key, "_row.*") if columns else rows.select(key)


def list_files(spark: SparkSession, paths: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """(path, length) of every file below the paths; Spark lists them and opens none."""
    return read_files(spark, paths, pattern).select("path", "length")


def _header(path: str) -> dict:
    try:
        with open_file(path) as file:
            width, height, mode = image_header(FileView(file))
    except TooShort:
        return {"width": None, "height": None, "mode": None, "error": UNKNOWN}
    except ValueError as exc:
        return {"width": None, "height": None, "mode": None, "error": str(exc)}
    return {"width": width, "height": height, "mode": mode, "error": None}


def image_metadata(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Width, height and channel mode of images from their headers; unreadable files keep a row with an error.

    A task opens a file and reads the blocks its header is in, wherever in the file they are; no content is scanned and
    no pixel decoded. As in every file source of Spark, a file without bytes gives no row.
    """

    @F.pandas_udf(HEADER)
    def read(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_header(p) for p in names], columns=["width", "height", "mode", "error"], dtype=object)

    found = list_files(spark, paths).withColumn("_h", read.asNondeterministic()("path"))
    return found.select("path", "_h.width", "_h.height", "_h.mode", F.col("_h.error").alias("image_error"))


def _preview(data: bytes | None, whole: bool, delimiter: str, n: int) -> dict:
    if data is None:
        return {"rows": None, "error": None, "complete": None}
    try:
        text = io.StringIO(data.decode("utf-8", errors="replace"), newline="")
        rows = [r for r, _ in zip(csv.reader(text, delimiter=delimiter), range(n + 1))]
        # Row n + 1 shows that row n did not end at the cut of the head.
        return {"rows": rows[:n], "error": None, "complete": whole or len(rows) > n}
    except csv.Error as exc:
        return {"rows": None, "error": str(exc), "complete": whole}


def _first_rows(path: str, delimiter: str, n: int) -> dict:
    with open_file(path) as file, io.TextIOWrapper(io.BufferedReader(file), encoding="utf-8", errors="replace", newline="") as text:
        try:
            rows = [r for _, r in zip(range(n), csv.reader(text, delimiter=delimiter))]
        except csv.Error as exc:
            return {"rows": None, "error": str(exc), "complete": True}
    return {"rows": rows, "error": None, "complete": True}


def tabular_preview(files: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows of each CSV / TSV file, quoted line breaks intact.

    Listed files are read up to the end of the last wanted row. Of rows that carry ``content`` Python sees only the
    head; the few whose first rows are longer than that are parsed again from their whole content.
    """
    suffix = suffix_of(base_name(F.col("path")))
    tables = files.withColumn("_suffix", suffix).where(F.col("_suffix").isin(".csv", ".tsv"))
    if "content" not in files.columns:
        @F.pandas_udf(PREVIEW)
        def beginning(paths: pd.Series, suffixes: pd.Series) -> pd.DataFrame:
            out = [_first_rows(p, "\t" if s == ".tsv" else ",", n) for p, s in zip(paths, suffixes)]
            return pd.DataFrame(out, columns=["rows", "error", "complete"])

        read = tables.withColumn("_best", beginning.asNondeterministic()("path", "_suffix"))
        return read.select("path", F.col("_best.rows").alias("preview_rows"), F.col("_best.error").alias("tabular_error"))

    @F.pandas_udf(PREVIEW)
    def parse(data: pd.Series, whole: pd.Series, suffix: pd.Series) -> pd.DataFrame:
        out = [_preview(d, bool(w), "\t" if s == ".tsv" else ",", n) for d, w, s in zip(data, whole, suffix)]
        return pd.DataFrame(out, columns=["rows", "error", "complete"])

    head = parse(F.substring("content", 1, HEAD_BYTES), F.col("length") <= HEAD_BYTES, F.col("_suffix"))
    first = tables.withColumn("_head", head)
    again = parse(F.when(~F.col("_head.complete"), F.col("content")), F.lit(True), F.col("_suffix"))
    best = F.when(F.col("_head.complete"), F.col("_head")).otherwise(F.col("_again"))
    return first.withColumn("_again", again).withColumn("_best", best).select(
        "path", F.col("_best.rows").alias("preview_rows"), F.col("_best.error").alias("tabular_error")
    )


def _listing(data: bytes | None, whole: bool, n: int) -> dict:
    if data is None:
        return {"entries": None, "error": None, "complete": None}
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            return {"entries": archive.namelist()[:n], "error": None, "complete": True}
    except (zipfile.BadZipFile, OSError, ValueError) as exc:
        return {"entries": None, "error": str(exc), "complete": whole}


def _members(path: str, n: int) -> dict:
    with open_file(path) as file:
        try:
            with zipfile.ZipFile(file) as archive:
                return {"entries": archive.namelist()[:n], "error": None, "complete": True}
        except (zipfile.BadZipFile, ValueError) as exc:
            return {"entries": None, "error": str(exc), "complete": True}


def archive_listing(files: DataFrame, n: int = 30) -> DataFrame:
    """First ``n`` member names of zip-based files.

    The member table sits at the end of the file, and of listed files only that is read. Of rows that carry
    ``content`` Python sees the tail; archives with a longer table are read again in full.
    """
    if "content" not in files.columns:
        @F.pandas_udf(LISTING)
        def table(paths: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([_members(p, n) for p in paths], columns=["entries", "error", "complete"])

        read = files.withColumn("_best", table.asNondeterministic()("path"))
        return read.select("path", F.col("_best.entries").alias("archive_entries"), F.col("_best.error").alias("archive_error"))

    @F.pandas_udf(LISTING)
    def members(data: pd.Series, whole: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_listing(d, bool(w), n) for d, w in zip(data, whole)], columns=["entries", "error", "complete"])

    size = F.col("length")
    tail = F.when(size <= TAIL_BYTES, F.col("content")).otherwise(F.substring(F.col("content"), -TAIL_BYTES, TAIL_BYTES))
    first = files.withColumn("_tail", members(tail, size <= TAIL_BYTES))
    again = members(F.when(~F.col("_tail.complete"), F.col("content")), F.lit(True))
    best = F.when(F.col("_tail.complete"), F.col("_tail")).otherwise(F.col("_again"))
    return first.withColumn("_again", again).withColumn("_best", best).select(
        "path", F.col("_best.entries").alias("archive_entries"), F.col("_best.error").alias("archive_error")
    )


def is_zip(content: Column) -> Column:
    """An end-of-archive record within the last 64 KiB and its own length."""
    return F.contains(F.substring(content, -65557, 65557), F.unhex(F.lit("504B0506")))
