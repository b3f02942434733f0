"""Benchmark decontamination: prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item (a shorter item is one window). As a set of
shingles it must lie in a document whole, so the join needs one shingle of it: its prefix, the
rarest by document frequency. Document positions that hold a prefix shingle join on it; length
and positional bounds drop windows that would not fit at that place; what is left is verified
word by word.

Benchmarks of any size work: the filter applied to documents before the shuffle is a bitmap of
fixed size, which only gets less selective as a benchmark grows.

Null or empty texts have no words: never hit, never contaminated; such items have no window.
Repeated rows each get a row. Items with equal text each count. Texts of any length are read
whole, in blocks of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.frames import bitmap, keyed_texts, marked, written
from folioscope.llm.words import ALPHANUMERIC, Block, blocks, grams

WINDOW = 13
SHINGLE = 3


def _shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, at = grams(block.word_hashes(), block.first, n)
    return hashes.view(np.int64), at


def item_windows(items: DataFrame, id_column: str = "item_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """(item_id, words, length, shingles): each window as its words joined by a space, with shingle hashes in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text"), ALPHANUMERIC, lower=True):
                out: list = [[], [], [], []]
                tables = {n: dict(zip(*(x.tolist() for x in _shingles(b, n)[::-1]))) for n in range(1, SHINGLE + 1)}
                for r, count in enumerate(b.counts.tolist()):
                    size = min(window, count)
                    n = min(SHINGLE, size)
                    for s in range(int(b.first[r]), int(b.first[r + 1]) - size + 1) if size else ():
                        out[0].append(batch.column("item_id")[b.row + r].as_py())
                        out[1].append(b" ".join(b.words(s, s + size)).decode())
                        out[2].append(size)
                        out[3].append([tables[n][i] for i in range(s, s + size - n + 1)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int32()),
                     pa.array(out[3], pa.list_(pa.int64()))], ["item_id", "words", "length", "shingles"])

    own = items.select(F.col(id_column).cast("string").alias("item_id"), F.col(text_column).alias("text"))
    return own.mapInArrow(cut, "item_id string, words string, length int, shingles array<bigint>")


def shingle_frequencies(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, df): documents that hold each of the given shingle hashes, counted over all documents."""
    wanted = bitmap(tokens, "token")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, dtype=np.uint8)
        for batch in batches:
            for b in blocks(batch.column("text"), ALPHANUMERIC, lower=True):
                rows = b.row_of_word()
                for n in range(1, SHINGLE + 1):
                    hashes, at = _shingles(b, n)
                    hit = marked(bits, hashes)
                    pairs = np.unique(np.stack([hashes[hit], rows[at[hit]]]), axis=1) if len(hit) else np.zeros((2, 0), np.int64)
                    token, df = np.unique(pairs[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(df.astype(np.int64))], ["token", "df"])

    counted = docs.select("text").mapInArrow(count, "token bigint, df bigint")
    return counted.groupBy("token").agg(F.sum("df").alias("df")).join(tokens.distinct(), "token", "left_semi")


def _candidates(docs: DataFrame, prefixes: DataFrame, window: int) -> DataFrame:
    """Per document its number of words, and each place that may hold a prefix shingle with the words around it."""
    wanted, reach = bitmap(prefixes, "token"), window - 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, dtype=np.uint8)
        for batch in batches:
            for b in blocks(batch.column("text"), ALPHANUMERIC, lower=True):
                rows, words = b.row_of_word(), b.counts
                places: list[list[dict]] = [[] for _ in range(b.rows)]
                for n in range(1, SHINGLE + 1):
                    hashes, at = _shingles(b, n)
                    for k in marked(bits, hashes).tolist():
                        i = int(at[k])
                        r = int(rows[i])
                        low, high = max(int(b.first[r]), i - reach), min(int(b.first[r + 1]), i + window)
                        places[r].append({"token": int(hashes[k]), "at": i - int(b.first[r]), "back": i - low,
                                          "around": b" ".join(b.words(low, high)).decode()})
                part = batch.slice(b.row, b.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), part.column("doc_id"), pa.array(words.astype(np.int64)), pa.array(places, place)],
                    ["k1", "k2", "doc_id", "n_words", "places"])

    place = pa.list_(pa.struct([("token", pa.int64()), ("at", pa.int32()), ("back", pa.int32()), ("around", pa.string())]))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(
        find, f"k1 bigint, k2 bigint, doc_id {kind}, n_words bigint, places array<struct<token bigint, at int, back int, around string>>"
    )


def _covered(hits: DataFrame) -> DataFrame:
    """Words inside any occurrence: spans by start, each adding what lies beyond the furthest end so far."""
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    return hits.groupBy("k1", "k2").agg(spans.alias("spans")).select(
        "k1", "k2",
        F.aggregate(
            "spans", F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n")),
            lambda a, s: F.struct(
                F.greatest(a["to"], s["end"]).alias("to"),
                (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["to"], s["start"]))).alias("n")),
            lambda a: a["n"]).alias("n_hit"),
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", window: int = WINDOW, share: int = 20,
) -> DataFrame:
    """One row per document: k1, k2 (row key), doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A document is contaminated when a word is hit and ``share`` times the hit words reach its
    words. ``items`` lists the item ids found, as strings in order.
    """
    keyed = keyed_texts(docs, id_column, text_column)
    windows = written(item_windows(items, item_column, item_text, window), "windows")
    distinct = windows.select("words", "length", "shingles").dropDuplicates(["words"])
    shingles = distinct.select("words", "length", F.posexplode("shingles").alias("offset", "token"))
    frequencies = shingle_frequencies(keyed, shingles.select("token"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset")).alias("p")
    prefixes = written(
        shingles.join(frequencies, "token", "left").groupBy("words", "length").agg(rarest)
        .select("words", "length", F.col("p.token").alias("token"), F.col("p.offset").alias("offset")), "prefixes")
    found = written(_candidates(keyed, prefixes.select("token"), window), "candidates")
    places = found.select("k1", "k2", "n_words", F.explode("places").alias("p")).select("k1", "k2", "n_words", "p.*")
    start, skip = F.col("at") - F.col("offset"), F.col("back") - F.col("offset")
    fits = (F.col("at") >= F.col("offset")) & (start + F.col("length") <= F.col("n_words"))
    same = F.array_join(F.slice(F.split("around", " "), skip + 1, F.col("length")), " ") == F.col("words")
    hits = (
        places.join(prefixes, "token").where(fits).where(same)
        .select("k1", "k2", "words", start.alias("start"), (start + F.col("length")).alias("end")))
    named = (
        hits.select("k1", "k2", "words").distinct().join(windows.select("words", "item_id").distinct(), "words")
        .groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")).alias("items")))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    return (
        found.drop("places").join(_covered(hits).join(named, ["k1", "k2"]), ["k1", "k2"], "left")
        .select(
            "k1", "k2", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"),
            ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), items_found.alias("items"))
    )
