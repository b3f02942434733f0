"""Substring dedup: repeated 35-word windows, counted exactly in super-k-mer partitions.

The minimiser of a window is its least m-gram by hash (leftmost on ties); consecutive windows with
the same minimiser form a super-k-mer. Equal windows have equal minimisers and never share a
super-k-mer, so a window can only repeat where its minimiser starts two super-k-mers or more.
Those travel as one packed string of words each to the minimiser's bucket, and sorting there
counts their windows exactly: words get ids, and ids of neighbouring spans are sorted into ids of
spans twice as long until a window is one id.

Buckets are bounded. A minimiser with many super-k-mers is dealt over several buckets by document;
windows found twice in one bucket are settled there, the others of such a minimiser meet by a
128-bit digest of their words. No window is dropped or sampled.

Null and empty texts have no words. Repeated rows count as further documents, so their windows
repeat. Other columns are not carried. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.frames import keyed_texts, written
from folioscope.llm.words import U64, Block, blocks, mix, single_spaced, spans_union

WINDOW = 35
GRAM = 6
BUCKET_ROWS = 4096
CHUNK_BYTES = 1 << 22


def super_kmers(b: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (in the block), number of windows and minimiser of each super-k-mer of a block."""
    none = np.zeros(0, np.int64)
    m = min(GRAM, window)
    n = len(b.starts)
    if n < window:
        return none, none, none
    hashes = b.word_hashes()
    grams = np.zeros(n - m + 1, dtype=U64)
    for i in range(m):
        grams = mix(grams * U64(0xD6E8FEB86659FD93) + hashes[i : n - m + 1 + i])
    least = ((grams >> U64(32)) << U64(32)) | np.arange(len(grams), dtype=U64)
    span, size = window - m + 1, 1
    while 2 * size <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: size - span], least[span - size :])
    left = np.repeat(b.first[1:], b.counts) - np.arange(n)
    at = np.flatnonzero(left >= window)
    if not len(at):
        return none, none, none
    place = (least[at] & U64(0xFFFFFFFF)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return at[heads], np.diff(np.append(heads, len(at))), grams[place[heads]].view(np.int64)


def _spectrum(docs: DataFrame, window: int) -> DataFrame:
    """(k1, start, minimiser) of every super-k-mer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("k1").to_numpy()
            for b in blocks(batch.column("text")):
                first, _, minimiser = super_kmers(b, window)
                row = np.searchsorted(b.first, first, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[b.row + row]), pa.array((first - b.first[row]).astype(np.int32)), pa.array(minimiser)],
                    ["k1", "start", "minimiser"])

    return docs.select("k1", "text").mapInArrow(scan, "k1 bigint, start int, minimiser bigint")


PACKED = "bucket bigint, shared boolean, packed binary, places array<struct<k1 bigint, k2 bigint, start int>>"
PLACES = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32())]))


def _packed(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """Wanted super-k-mers as packed strings with the places they stand at."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for b in blocks(batch.column("text")):
                asked = batch.column("wanted").slice(b.row, b.rows)
                if asked.null_count == b.rows:
                    continue
                flat = asked.flatten()
                rows = np.repeat(np.arange(b.rows), asked.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                order = b.first[rows] + flat.field("start").to_numpy()
                buckets = dict(zip(order.tolist(), flat.field("buckets").to_numpy().tolist()))
                first, windows, minimiser = super_kmers(b, window)
                text, starts, ends = single_spaced(b)
                row = np.searchsorted(b.first, first, side="right") - 1
                found: dict[tuple[int, bool, bytes], list] = {}
                pick = np.flatnonzero(np.isin(first, order))
                tails = ends[first[pick] + windows[pick] + window - 2]
                for k, s, e in zip(pick.tolist(), starts[first[pick]].tolist(), tails.tolist()):
                    n, r = buckets[int(first[k])], int(row[k])
                    key1 = int(k1[b.row + r])
                    bucket = int(minimiser[k]) ^ (key1 % n)
                    place = (key1, int(k2[b.row + r]), int(first[k] - b.first[r]))
                    found.setdefault((bucket, n > 1, text[s:e]), []).append(place)
                if found:
                    names = [[k[i] for k in found] for i in range(3)]
                    sizes = [len(p) for p in found.values()]
                    flat_places = list(zip(*(p for ps in found.values() for p in ps)))
                    places = pa.ListArray.from_arrays(
                        pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                        pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(flat_places, PLACES.value_type)], ["k1", "k2", "start"]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[0], pa.int64()), pa.array(names[1], pa.bool_()), pa.array(names[2], pa.binary()), places],
                        ["bucket", "shared", "packed", "places"])

    return docs.join(wanted, "k1", "left").select("k1", "k2", "text", "wanted").mapInArrow(pack, PACKED)


def _window_ids(data: bytes, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and id of each whole window; equal ids mean equal words.

    ``data`` holds words with one space after each, ``left`` the words from each one to its row's end.
    """
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20) + 1
    offsets = pa.array(np.concatenate([[0], ends]), pa.int64())
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, offsets.buffers()[1], pa.py_buffer(data)])
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    size = 1
    while size < window:
        step = min(size, window - size)
        at = np.flatnonzero(left >= size + step)
        _, joint = np.unique(ids[at] * (int(ids.max()) + 1) + ids[at + step], return_inverse=True)
        ids = np.zeros_like(ids)
        ids[at] = joint
        size += step
    at = np.flatnonzero(left >= window)
    return at, ids[at]


FOUND = "k1 bigint, k2 bigint, start int, end int, digest binary, n int"
_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary()), ("n", pa.int32())])


def _count(rows: pa.Table, window: int) -> Iterator[pa.RecordBatch]:
    """Repeated spans of whole buckets, and the windows that other buckets must help to settle."""
    packed, places = rows.column("packed").to_pylist(), rows.column("places").combine_chunks()
    data = b" ".join(packed) + b" "
    counts = np.array([p.count(b" ") + 1 for p in packed])
    heads = np.concatenate([[0], np.cumsum(counts)])
    left = np.repeat(heads[1:], counts) - np.arange(heads[-1])
    at, ids = _window_ids(data, left, window)
    row = np.repeat(np.arange(len(packed)), counts)[at]
    sizes = places.value_lengths().to_numpy()
    total = np.bincount(ids, weights=sizes[row])[ids]
    flat, first = places.flatten(), np.concatenate([[0], np.cumsum(sizes)])
    k1, k2, start = (flat.field(c).to_numpy() for c in ("k1", "k2", "start"))
    # spans of neighbouring repeated windows, once for every place of their string
    twice = total > 1
    here, its = at[twice], row[twice]
    if len(here):
        new = np.concatenate([[True], (here[1:] != here[:-1] + 1) | (its[1:] != its[:-1])])
        span_row, low = its[new], here[new] - heads[its[new]]
        high = here[np.append(np.flatnonzero(new)[1:] - 1, len(here) - 1)] - heads[span_row] + window
        n = sizes[span_row]
        place = np.repeat(first[span_row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(k1[place]), pa.array(k2[place]), pa.array((start[place] + np.repeat(low, n)).astype(np.int32)),
             pa.array((start[place] + np.repeat(high, n)).astype(np.int32)), pa.nulls(len(place), pa.binary()),
             pa.nulls(len(place), pa.int32())], schema=_FOUND)
    # windows of minimisers dealt over several buckets: single ones by place, repeated ones once
    shared = np.flatnonzero(rows.column("shared").to_numpy()[row])
    if len(shared):
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20)
        begins = np.concatenate([[0], ends[:-1] + 1])
        out, told = [], set()
        for i in shared.tolist():
            known = total[i] > 1
            if known and int(ids[i]) in told:
                continue
            told.add(int(ids[i]))
            digest = hashlib.blake2b(data[begins[at[i]] : ends[at[i] + window - 1]], digest_size=16).digest()
            p = first[row[i]]
            low = int(start[p] + at[i] - heads[row[i]])
            out.append((None, None, None, None, digest, 2) if known else (int(k1[p]), int(k2[p]), low, low + window, digest, 1))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _FOUND)], schema=_FOUND)


def _settled(packed: DataFrame, window: int) -> DataFrame:
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = np.flatnonzero(buckets[1:] != buckets[:-1]) + 1
            if held and buckets[0] != held[-1].column("bucket")[-1].as_py() and size >= CHUNK_BYTES:
                yield from _count(pa.Table.from_batches(held), window)
                held, size = [], 0
            begin = 0
            for cut in cuts[np.searchsorted(cuts, 1) :].tolist():
                part = batch.slice(begin, cut - begin)
                if size + part.nbytes >= CHUNK_BYTES:
                    yield from _count(pa.Table.from_batches([*held, part]), window)
                    held, size, begin = [], 0, cut
            rest = batch.slice(begin)
            held.append(rest)
            size += rest.nbytes
        if held:
            yield from _count(pa.Table.from_batches(held), window)

    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(settle, FOUND)


def _without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts without the words of their spans."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text")):
                part = batch.slice(b.row, b.rows)
                lists = part.column("spans")
                text, starts, ends = single_spaced(b)
                flat = lists.flatten()
                base = np.repeat(b.first[:-1], lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                low, high = (flat.field(c).to_numpy() for c in ("start", "end"))
                gone = spans_union(base + low, (high - low).astype(np.int64), len(starts))
                lost = np.concatenate([[0], np.cumsum(gone)])
                removed, kept = np.diff(lost[b.first]), []
                for r, n in enumerate(removed.tolist()):
                    i, j = int(b.first[r]), int(b.first[r + 1])
                    if n == j - i:
                        kept.append("")
                    elif n:
                        stay = i + np.flatnonzero(~gone[i:j])
                        kept.append(b" ".join(text[s:e] for s, e in zip(starts[stay].tolist(), ends[stay].tolist())).decode())
                    else:
                        kept.append(text[starts[i] : ends[j - 1]].decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(b.counts.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = docs.join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words left, joined by a space).

    A word goes when it lies in a window of ``window`` words whose sequence starts anywhere else too.
    """
    keyed = keyed_texts(docs, id_column, text_column)
    spectrum = _spectrum(keyed, window)
    repeated = spectrum.groupBy("minimiser").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = F.ceil(F.col("n") / BUCKET_ROWS).cast("int").alias("buckets")
    wanted = (
        spectrum.join(repeated, "minimiser").groupBy("k1")
        .agg(F.collect_set(F.struct("start", buckets)).alias("wanted")))
    found = written(_settled(_packed(keyed, wanted, window), window), "windows")
    open_windows = found.where("digest IS NOT NULL")
    met = open_windows.groupBy("digest").agg(F.sum("n").alias("total")).where("total > 1").select("digest")
    spans = (
        found.where("digest IS NULL").select("k1", "k2", "start", "end")
        .unionByName(open_windows.where("k1 IS NOT NULL").join(met, "digest", "left_semi").select("k1", "k2", "start", "end"))
        .groupBy("k1", "k2").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    return _without(keyed, spans)
