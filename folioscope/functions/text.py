"""Text columns: whitespace, digits, Arabic runs, numbers, dates."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.binding import let
from folioscope.rules import ARABIC_CLASS, DATE_PATTERN, SPACE_CLASS

# Classes are written as an intersection that begins with the common characters: the regular-expression engine asks the
# parts of a class one after the other, and leaves an intersection at the first part that says no.
# A whitespace run that is not already one plain space.
SPACES = rf"[[^!-~\x{{a1}}-\x{{167f}}]&&[{SPACE_CLASS}]](?:(?<!\x20)|(?=[{SPACE_CLASS}]))[{SPACE_CLASS}]*+"
EDGE_SPACES = rf"\A[{SPACE_CLASS}]+|[{SPACE_CLASS}]+\z"
EASTERN_DIGITS = "".join(chr(c) for c in [*range(0x0660, 0x066A), *range(0x06F0, 0x06FA)])
LINE_BREAKS = r"[\n\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGE_SPACES, "")


def collapse_ws(c: Column) -> Column:
    """Whitespace runs become one space, ends trimmed; null gives an empty string."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), SPACES, " "))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


# Keeps filters on normalised text above the call, so it is evaluated once per row.
_nfkc = _nfkc.asNondeterministic()


#: Runs of settled characters that the class names: shorter ones below this code point, long ones beyond.
SETTLED_BELOW, SHORT_RUN, LONG_RUN = 0x800, 10, 256
#: One letter of each script whose run is asked first.
COMMON_LETTERS = "a\u00e9\u0627\u0434\u03b1\u4e2d\uac00"


@cache
def settled_runs() -> list[tuple[int, int]]:
    """Runs of code points that NFKC leaves alone in any text made of them alone: each is its own NFKC form, is no
    combining mark, and is never the later part of a composition."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    later = {int(p[1], 16) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    later |= {*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)}  # vowels and finals of Hangul compose by rule
    runs: list[tuple[int, int]] = []
    for c in range(0x10000):
        char = chr(c)
        if unicodedata.category(char) in ("Cn", "Cs") or unicodedata.combining(char) or c in later or unicodedata.normalize("NFKC", char) != char:
            continue
        if runs and runs[-1][1] == c - 1:
            runs[-1] = (runs[-1][0], c)
        else:
            runs.append((c, c))
    return [(a, b) for a, b in runs if b - a + 1 >= (SHORT_RUN if a < SETTLED_BELOW else LONG_RUN)]


@cache
def unsettled() -> str:
    """Class of the characters outside the settled runs, nested so that the runs of common letters are asked first."""
    def common(run: tuple[int, int]) -> int:
        return next((n for n, c in enumerate(COMMON_LETTERS) if run[0] <= ord(c) <= run[1]), len(COMMON_LETTERS))

    runs = [rf"[^\x{{{a:x}}}-\x{{{b:x}}}]" for a, b in sorted(settled_runs(), key=common)]
    return reduce(lambda later, run: f"[{run}&&{later}]", reversed(runs))


def normalize_text(c: Column) -> Column:
    """NFKC, no tatweel, no bidi marks, collapsed whitespace.

    Only text with a character that NFKC may change crosses to Python: plain Latin, Greek, Cyrillic, Hebrew, Arabic
    and East Asian text stays in the JVM; combining marks, ligatures and width forms cross.
    """
    foreign = c.rlike(unsettled())
    composed = F.when(foreign, _nfkc(F.when(foreign, c))).otherwise(c)
    return collapse_ws(F.regexp_replace(composed, r"[[^\x{0}-\x{63f}]&&[\x{0640}\x{200e}\x{200f}\x{202a}-\x{202e}]]+", ""))


def ascii_digits(c: Column) -> Column:
    return F.translate(c, EASTERN_DIGITS, "0123456789" * 2)


def has_arabic(c: Column) -> Column:
    return c.rlike(f"[{ARABIC_CLASS}]")


def fix_reversed_runs(c: Column) -> Column:
    """Reverse every maximal Arabic run and leave everything else in place."""
    runs = F.regexp_extract_all(c, F.lit(f"(?s)([{ARABIC_CLASS}]+|[^{ARABIC_CLASS}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(has_arabic(r), F.reverse(r)).otherwise(r)), "")


def squeeze_key(c: Column) -> Column:
    """Comparison form of already normalised text: letters, digits and underscores, lower case."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[[^a-z]&&[[^A-Z0-9]&&[^\p{L}\p{N}_\x{0600}-\x{06FF}]]]+", ""))


def field_key_text(c: Column) -> Column:
    return squeeze_key(normalize_text(c))


def clean_plate(c: Column, allow: str | None = None) -> Column:
    kept = F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "")
    return F.regexp_replace(kept, f"[^{allow}]+", "") if allow else kept


def numeric_tokens(c: Column, plain: bool = False) -> Column:
    """Every digit run outside dates as text without leading zeros, whatever its length; an
    8-digit run of two numbers is split. ``plain`` text went through ``ascii_digits`` before."""
    runs = F.regexp_extract_all(
        F.regexp_replace(c if plain else ascii_digits(c), DATE_PATTERN, " "), F.lit(r"(?U)\d+"), F.lit(0)
    )

    def pieces(run: Column) -> Column:
        halves = [F.substring(run, 1, 4), F.substring(run, 5, 4)]
        both_large = (F.length(run) == 8) & ~halves[0].startswith("00") & ~halves[1].startswith("00")
        return F.when(both_large, F.array(*halves)).otherwise(F.array(run))

    return F.transform(F.flatten(F.transform(runs, pieces)), lambda r: F.regexp_replace(r, r"^(?U)0+(?=\d)", ""))


def ordered_distinct(c: Column) -> Column:
    return F.array_distinct(c)


def date_strings(c: Column, plain: bool = False) -> Column:
    """Distinct slashed dates in first-seen order. ``plain`` text went through ``ascii_digits`` before."""
    return ordered_distinct(F.regexp_extract_all(c if plain else ascii_digits(c), F.lit(DATE_PATTERN), F.lit(0)))


def date_key(d: Column) -> Column:
    def key(parts: Column) -> Column:
        year = F.get(parts, F.lit(0)).try_cast("int")
        return F.struct(
            F.when(year < 100, year + 2000).otherwise(year).alias("y"),
            F.get(parts, F.lit(1)).try_cast("int").alias("m"),
            F.get(parts, F.lit(2)).try_cast("int").alias("d"),
        )

    return let(F.split(d, "/"), key)


def issue_expiry(dates: Column) -> Column:
    """Earliest date is the issue, latest the expiry; a single date is an expiry."""
    ranked = F.array_sort(
        F.transform(dates, lambda d, i: F.struct(date_key(d).alias("key"), i.alias("i"), d.alias("text")))
    )
    return let(ranked, lambda r: F.struct(
        F.when(F.size(r) > 1, F.get(r, F.lit(0))["text"]).alias("issue_date"),
        F.get(r, F.size(r) - 1)["text"].alias("expiry_date"),
    ))


def as_date(d: Column) -> Column:
    """Calendar form of a slashed date; null when no such day exists."""
    k = date_key(d)
    return F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", k["y"], k["m"], k["d"]), F.lit("yyyy-MM-dd")))


def _bounded(v: Column, low: int | None, high: int | None) -> Column:
    if low is not None:
        v = F.when(v >= low, v)
    if high is not None:
        v = F.when(v <= high, v)
    return v


def coerce_int(c: Column, low: int | None = None, high: int | None = None, kind: str = "string") -> Column:
    """First whole-word digit run of a string; doubles truncate; booleans give null."""
    if kind == "boolean":
        return F.lit(None).cast("bigint")
    if kind in ("int", "bigint", "double", "float"):
        return _bounded(c.try_cast("bigint"), low, high)
    run = F.regexp_extract(ascii_digits(c), r"(?U)\b\d+\b", 0)
    return _bounded(run.try_cast("bigint"), low, high)


def coerce_year(c: Column) -> Column:
    run = F.regexp_extract(ascii_digits(c), r"(?U)\b\d{2,4}\b", 0).try_cast("int")
    return let(run, lambda y: F.when(y < 100, y + 2000).when(y.between(1900, 2100), y))


def safe_utf8(c: Column) -> Column:
    return F.make_valid_utf8(c.cast("string"))


def line_count(c: Column) -> Column:
    breaks = F.regexp_count(c, F.lit(LINE_BREAKS))
    open_end = (F.length(c) > 0) & ~c.rlike(LINE_BREAKS + r"\z")
    return breaks + open_end.cast("int")


def text_preview(content: Column, max_chars: int = 4000, valid: Column | None = None) -> Column:
    """First characters of a file, the decoding used, and the number of lines shown.

    With ``valid`` given, ``content`` is the head of a file, 8 bytes for each character wanted and 8 more, so that
    the last character shown never ends at the cut.
    """
    raw = content.cast("string")
    if valid is None:
        valid = F.is_valid_utf8(raw)
    else:
        raw = F.make_valid_utf8(raw)
    text = F.regexp_replace(F.when(valid, raw).otherwise(F.make_valid_utf8(raw)), r"\r\n?", "\n")
    preview = F.substring(text, 1, max_chars)
    return F.struct(
        preview.alias("text_preview"),
        F.when(valid, "utf-8").otherwise("utf-8-replace").alias("encoding_used"),
        line_count(preview).alias("line_count_preview"),
    )


def sanitize(c: Column, home: str | None, cwd: str | None) -> Column:
    """Hide the home directory and the working directory in messages."""
    if home and home != "~":
        c = F.replace(c, F.lit(home), F.lit("~"))
    if cwd:
        c = F.replace(c, F.lit(cwd), F.lit("."))
    return c


def normalize_base_url(c: Column) -> Column:
    """``localhost`` becomes 127.0.0.1 (port and user kept); trailing slashes go."""
    local = F.regexp_replace(
        c, r"(?i)\A([a-z][a-z0-9+.\-]*://(?:[^/?#@]+@)?)@?localhost(:\d+)?(?=[/?#]|\z)", "$1127.0.0.1$2"
    )
    return F.regexp_replace(local, r"/+\z", "")
