"""Line-first cleaning: lines that fail a rule go, then documents that lost too much text.

Every line with a word is judged by three rules:
punctuation - four or more words of which punctuation makes over a third of the characters, or one or two words without
a closing mark; navigation - three or more separators that stand alone, or a whole line of menu phrases; boilerplate - a
stock phrase of web pages. A document is kept when its base figures pass and the lines left hold at least half its words.

A null or empty text has no words, fails the base test and is not kept; its cleaned text is empty. Repeated rows each get
a row. Texts of any length are read whole; no shuffle is needed, so no group can be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.words import Block, blocks, packed_words, spans_union

MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

WORD = "[^\x20\x09-\x0d]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
CLOSED = r"[.!?:;,)\]\x22'…”»]$"
SEPARATOR = r"(?:^|[ \t])(?:[|>»•·/]|::)(?:[ \t]|$)"
MENU = (
    "home|menu|next|previous|log ?in|log ?out|sign ?in|sign ?up|register|search|contact(?: us)?|about(?: us)?|help|faq|sitemap|"
    "read more|click here|skip to (?:main )?content|back to top|share(?: this)?|print|tweet|comments?"
)
NAVIGATION = rf"^[ \t]*(?:(?:{MENU})[ \t|>»•·/:,.!-]*)+$"
BOILERPLATE = (
    "all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|(?:accept|use) cookies|enable javascript|"
    "javascript is (?:disabled|required)|subscribe to our newsletter|powered by wordpress|lorem ipsum|page not found"
)

_word, _punctuation, _closed = re.compile(WORD), re.compile(PUNCTUATION), re.compile(CLOSED)
_separator, _navigation, _boilerplate = re.compile(SEPARATOR), re.compile(NAVIGATION), re.compile(BOILERPLATE)
_upper = {c: c + 32 for c in range(65, 91)}
_spaces = {c: None for c in (0x20, *range(0x09, 0x0E))}


def failed_rule(line: str, n_words: int) -> str | None:
    """Name of the first rule that a line with words fails."""
    if n_words > 3:
        if 3 * len(_punctuation.findall(line)) > len(line.translate(_spaces)):
            return "punctuation"
    elif n_words < 3 and not _closed.search(line.rstrip(" \t\x0b\x0c\r")):
        return "punctuation"
    lower = line.translate(_upper)
    if len(_separator.findall(line)) >= 3 or _navigation.search(lower.rstrip(" \t\x0b\x0c\r")):
        return "navigation"
    return "boilerplate" if _boilerplate.search(lower) else None


def _clean(text: str) -> tuple[str, int, int, int]:
    """Text left, words left, repeated lines, lines removed."""
    seen: set[str] = set()
    left, words, repeated, removed = [], 0, 0, 0
    for line in text.split("\n"):
        n = len(_word.findall(line))
        if n:
            repeated += line in seen
            seen.add(line)
            if failed_rule(line, n):
                removed += 1
                continue
            words += n
        left.append(line)
    return "\n".join(left), words, repeated, removed


def _repeated_windows(b: Block) -> np.ndarray:
    """First words of the 3-word windows that a row holds twice or more; words are compared, by their numbers in the block."""
    encoded = packed_words(b).dictionary_encode()
    word, size = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
    row = b.row_of_word()
    if len(word) < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(row[:-2] == row[2:])
    pairs, pair = np.unique(word[at] * size + word[at + 1], return_inverse=True)
    _, window, times = np.unique((row[at] * len(pairs) + pair) * size + word[at + 2], return_inverse=True, return_counts=True)
    return at[times[window] > 1]


def _base(b: Block) -> dict[str, np.ndarray]:
    points = b.code_points_before()
    letters = np.concatenate([[0], np.cumsum(points[b.ends] - points[b.starts])])
    symbols = np.concatenate([[0], np.cumsum(np.isin(b.data, list(SYMBOLS)))])
    again = _repeated_windows(b)
    repeated = np.concatenate([[0], np.cumsum(spans_union(again, np.full(len(again), 3), len(b.starts)))])
    return {
        "n_words": b.counts, "word_chars": np.diff(letters[b.first]), "n_symbols": np.diff(symbols[b.offsets]),
        "n_repeat_words": np.diff(repeated[b.first]),
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "n_removed_lines")


def clean_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, cleaned (text of the lines left)."""
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                part = batch.slice(b.row, b.rows)
                cleaned, kept, repeated, removed = zip(*(_clean(t or "") for t in part.column("text").to_pylist()))
                counts = _base(b) | {"n_dup_lines": repeated, "n_kept_words": kept, "n_removed_lines": removed}
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(np.asarray(counts[c], dtype=np.int64)) for c in COUNTS), pa.array(cleaned, pa.string())],
                    ["doc_id", *COUNTS, "cleaned"])

    kind = own.schema["doc_id"].dataType.simpleString()
    judged = own.mapInArrow(judge, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, cleaned string")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (2 * F.col("n_kept_words") >= F.col("n_words")))
