"""Main text of web pages: the article's blocks, without what the pages of a host repeat.

Host suffix array. The token streams of a host's pages, taken together, are searched for long substrings that stand on
distinct pages. The array is sparse: of every ``SPAN`` consecutive suffixes of a block the one whose first ``PREFIX`` words
have the least hash is entered, so every common substring of PREFIX + SPAN - 1 words has an entry on each page, and a
block's whole text is one more entry. Entries are ordered by host and a 64-bit hash of their prefix, in Spark's shuffle;
neighbours with equal prefixes from pages of different text are the repeated substrings. Blocks outside article elements that
hold one are then entered again with every suffix, which gives the repeated runs their full length. A full array from the
start would move every word's suffix, several times the input.

A page's blocks come with their place (``page_blocks``); the blocks of the surest place that has text are candidates. Outside
an article element, a block goes when repeated substrings cover half its words or when it is mostly links. Inside one,
repetition alone proves nothing, as articles quote and copy each other: a block goes when it stands whole on half of the host's
pages, five different ones at least. Where this would leave less than a fifth (inside an article: four fifths) of the words, the
pages are copies of each other and the page keeps its blocks. Unique runs always stay.

A null or empty page gives an empty text; pages without a host are not compared. Equal rows share one result and each get a
row; columns other than the three named are not read. No pages give no rows. A host with a third of all pages is no group
anywhere: entries are dealt by prefix and merged before the shuffle, and a page's spans are bounded by its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.frames import bitmap, marked, written
from folioscope.llm.page_blocks import ARTICLE, NAMED, Block, page_blocks
from folioscope.llm.words import U64, blocks, grams, mix, spans_union

PREFIX, SPAN = 16, 16
LEAST_PAGES = 5
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def _host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def candidates(found: list[Block]) -> list[Block]:
    """The blocks of the surest place."""
    least = min((b.tier for b in found), default=ARTICLE)
    return [b for b in found if b.tier == least]


def keyed_pages(pages: DataFrame, id_column: str, url_column: str, html_column: str) -> DataFrame:
    """(k1, k2, page_id, url, html, host): a 128-bit key per row content, and a hash of the host (null without one)."""
    base = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    host = _host(F.col("url"))
    return base.select(
        F.xxhash64("page_id", "url", "html").alias("k1"), F.xxhash64(F.lit(1), "html", "url", "page_id").alias("k2"), "page_id", "url", "html",
        F.when(host != "", F.xxhash64(host)).alias("host"))


def _sparse(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Positions of the least key of every SPAN consecutive windows of a row, and of rows with fewer windows."""
    if not len(keys):
        return np.zeros(0, np.int64)
    bounds = np.flatnonzero(np.diff(row, prepend=-1))
    picked = []
    if len(keys) >= SPAN:
        best = np.lib.stride_tricks.sliding_window_view(keys, SPAN).argmin(axis=1) + np.arange(len(keys) - SPAN + 1)
        picked.append(best[row[: len(keys) - SPAN + 1] == row[SPAN - 1 :]])
    short = np.flatnonzero(np.diff(bounds, append=len(keys)) < SPAN)
    picked.append(np.array([bounds[i] + keys[bounds[i] : (bounds[i + 1] if i + 1 < len(bounds) else len(keys))].argmin() for i in short], dtype=np.int64))
    return np.unique(np.concatenate(picked))


def _entries(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """Suffixes of the batch's pages: key, page (position in the batch), stream, block, start, length, tier, and whether
    the suffix is entered in the sparse array."""
    hosts = batch.column("host").to_pylist()
    texts, page, number, tier, digest, streams = [], [], [], [], [], np.zeros(len(hosts), np.int64)
    for i, (host, source) in enumerate(zip(hosts, batch.column("html").to_pylist())):
        if host is None:
            continue
        own = candidates(page_blocks(source))
        streams[i] = xxhash.xxh64_intdigest("\n".join(b.text for b in own)) >> 1
        for k, b in enumerate(own):
            texts.append(b.text)
            page.append(i)
            number.append(k)
            tier.append(b.tier)
            digest.append(xxhash.xxh64_intdigest(b.text))
    if not texts:
        return
    of_block = np.array(page)
    salts = mix(np.array([h or 0 for h in hosts], dtype=np.int64).view(U64))
    whole = mix(np.array(digest, dtype=U64) ^ mix(salts[of_block] + U64(1)))
    sizes = np.zeros(len(texts), np.int64)

    numbers, tiers = np.array(number), np.array(tier)

    def rows(block: np.ndarray, key: np.ndarray, start: np.ndarray, length: np.ndarray, entered: np.ndarray) -> dict[str, np.ndarray]:
        return {"key": key.view(np.int64), "page": of_block[block], "stream": streams[of_block[block]], "block": numbers[block],
                "start": start, "length": length, "tier": tiers[block], "entered": entered}

    for b in blocks(pa.array(texts, pa.large_string())):
        sizes[b.row : b.row + b.rows] = b.counts
        keys, at = grams(b.word_hashes(), b.first, PREFIX)
        row = b.row_of_word()[at]
        entered = np.zeros(len(keys), dtype=bool)
        entered[_sparse(keys, row)] = True
        block = row + b.row
        yield rows(block, mix(keys ^ mix(salts[of_block[block]] + U64(2))), at - b.first[row], np.full(len(keys), PREFIX), entered)
    every = np.arange(len(texts))
    yield rows(every, whole, np.zeros(len(texts), np.int64), sizes, np.ones(len(texts), dtype=bool))


def repeated_prefixes(pages: DataFrame) -> DataFrame:
    """(key): prefixes that stand on pages of different text."""

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for e in _entries(batch):
                yield pa.RecordBatch.from_arrays([pa.array(e["key"][e["entered"]]), pa.array(e["stream"][e["entered"]])], ["key", "stream"])

    entries = pages.select("host", "html").mapInArrow(enter, "key bigint, stream bigint")
    return _on_different_pages(entries)


def _on_different_pages(entries: DataFrame) -> DataFrame:
    return entries.groupBy("key").agg(F.min("stream").alias("a"), F.max("stream").alias("b")).where("a <> b").select("key")


def covered_spans(pages: DataFrame, repeated: DataFrame) -> DataFrame:
    """(k1, k2, spans): words of each page's blocks that repeated substrings cover and that may therefore go."""
    bits = bitmap(repeated, "key")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(bits, dtype=np.uint8)
        for batch in batches:
            for e in _entries(batch):
                at = marked(held, e["key"])
                at = at[e["entered"][at]]
                again = np.zeros(int(e["page"].max(initial=0)) + 1, dtype=bool)
                again[e["page"][at]] = True
                near = again[e["page"]] & (e["tier"] > ARTICLE)
                whole = (e["start"] == 0) & e["entered"]
                near[at] |= whole[at]
                at = np.flatnonzero(near)
                page = pa.array(e["page"][at])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(page) for c in ("k1", "k2", "host")), *(pa.array(e[c][at]) for c in ("key", "stream", "block", "start", "length", "tier"))],
                    ["k1", "k2", "host", "key", "stream", "block", "start", "length", "tier"])

    columns = "k1 bigint, k2 bigint, host bigint, key bigint, stream bigint, block bigint, start bigint, length bigint, tier bigint"
    near = written(pages.select("k1", "k2", "host", "html").mapInArrow(find, columns), "near-entries")
    full = near.where(F.col("tier") > ARTICLE).select("key", "stream")
    every = repeated.unionByName(_on_different_pages(full)).distinct()
    hits = written(near.join(every, "key", "left_semi"), "repeated-entries")
    on_host = pages.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n_pages"))
    streams = hits.select("host", "key", "stream").distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    common = written(streams.where(F.col("n") >= LEAST_PAGES).join(on_host, "host").where("2 * n >= n_pages").select("key"), "common-entries")
    free = hits.where(F.col("tier") > ARTICLE).unionByName(hits.where(F.col("tier") == ARTICLE).join(common, "key", "left_semi").select(hits.columns))
    return free.groupBy("k1", "k2").agg(F.collect_set(F.struct("block", "start", "length")).alias("spans"))


def _kept(own: list[Block], spans: list[dict] | None) -> list[Block]:
    """Candidate blocks without repeated ones and lists of links."""
    if not own:
        return own
    sizes = [b.text.count(" ") + 1 for b in own]
    left = [True] * len(own)
    if spans:
        for i, size in enumerate(sizes):
            mine = [s for s in spans if s["block"] == i]
            if mine:
                starts = np.array([s["start"] for s in mine])
                lengths = np.minimum(np.array([s["length"] for s in mine]), size - starts)
                need = 1 if own[i].tier > ARTICLE else 2
                left[i] = 2 * int(spans_union(starts, lengths, size).sum()) < size * need
        rest = sum(size for size, stays in zip(sizes, left) if stays)
        if 5 * rest < sum(sizes) * (1 if own[0].tier > ARTICLE else 4):
            left = [True] * len(own)
    if own[0].tier >= NAMED:
        text = [i for i, b in enumerate(own) if 10 * b.linked < 7 * len(b.text)]
        if text:
            left = [stays and i in set(text) for i, stays in enumerate(left)]
    return [b for b, stays in zip(own, left) if stays]


def extract_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    keyed = keyed_pages(pages, id_column, url_column, html_column)
    repeated = written(repeated_prefixes(keyed), "repeated-prefixes")
    spans = written(covered_spans(keyed, repeated), "page-spans")
    joined = keyed.join(spans, ["k1", "k2"], "left").select("page_id", "url", "html", "spans")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(b.text for b in _kept(candidates(page_blocks(h)), s))
                     for h, s in zip(batch.column("html").to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kinds = {c: joined.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return joined.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
