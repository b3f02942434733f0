"""Vector code compression: integer product codes, with distances read from per-dimension value dictionaries.

A component x counts as the integer floor(scale * x). Vectors are cut into equal parts; every part position has a codebook
of at most ``entries`` entries. The rows are packed once into a table of blocks: per dimension a sorted dictionary of the
block's distinct integers, and for each vector its position in that dictionary. A block's distances to all entries of a part
come from tables of squared differences, one row a dictionary value, that are gathered by code and added; no component is
subtracted twice. Sums are exact: 32 or 64 bits where the largest possible distance fits, Python integers elsewhere.

The codebook starts as the parts of the first ``entries`` rows by id (nulls last, then by components, so repeated rows count
each). A round assigns every part to its nearest entry (ties to the lower index) and replaces entries by the floor of their
parts' mean; unused entries stay. Tasks add up their own rows before the shuffle; per round the driver gets at most
parts * entries sums, whatever the number of rows, and holds the codebooks alone.

Rows whose vector is null or holds null or non-finite components are dropped. The usual length is the most frequent one that
can be cut into parts (ties: the shorter). Rows of another length, and rows with a component beyond 2^30 either way, get a
null code and error. An error beyond 64 bits is null. Null ids and labels are ordinary values. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.frames import written

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
BLOCK_ROWS, CHUNK_ROWS = 4096, 512
LARGEST = float(1 << 30)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def kept_vectors(vectors: DataFrame, id_column: str, vector_column: str, label_column: str) -> DataFrame:
    """(vec_id, label, v) of the rows whose components are all finite numbers."""
    own = vectors.select(
        F.col(id_column).alias("vec_id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    return own.where(_usable(F.col("v")))


def _codable(v: Column, length: int) -> Column:
    return (F.size(v) == length) & F.forall(v, lambda x: F.abs(x) <= LARGEST)


def _integers(v: Column) -> Column:
    return F.transform(v, lambda x: F.floor(x * SCALE).cast("bigint"))


def usual_length(kept: DataFrame, parts: int) -> int | None:
    """The most frequent length that can be cut into parts."""
    lengths = kept.groupBy(F.size("v").alias("size")).count().where((F.col("size") > 0) & (F.col("size") % parts == 0))
    first = lengths.orderBy(F.desc("count"), "size").first()
    return first and first["size"]


def value_blocks(kept: DataFrame, length: int) -> DataFrame:
    """(ids, labels, dictionary, starts, codes): blocks of vectors as positions in sorted dictionaries of distinct integers.

    ``starts`` says where each dimension's values begin in ``dictionary``; ``codes`` holds 16 bits a component, dimension by
    dimension.
    """
    own = kept.where(_codable(F.col("v"), length)).select("vec_id", "label", _integers(F.col("v")).alias("v"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                n = batch.num_rows
                values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, length)
                found = [np.unique(values[:, d], return_inverse=True) for d in range(length)]
                starts = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])])
                codes = np.concatenate([f[1].astype(np.uint16) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("vec_id")),
                     pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column("label")),
                     pa.array([np.concatenate([f[0] for f in found])], pa.list_(pa.int64())),
                     pa.array([starts.tolist()], pa.list_(pa.int32())), pa.array([codes.tobytes()], pa.binary())],
                    ["ids", "labels", "dictionary", "starts", "codes"])

    id_type, label_type = (own.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return own.mapInArrow(
        pack, f"ids array<{id_type}>, labels array<{label_type}>, dictionary array<bigint>, starts array<int>, codes binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, list[np.ndarray], np.ndarray]]:
    """Ids, labels, the values of every dimension, and codes as (dimension, vector) of each block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels, dictionary, starts, codes = (batch.column(c)[i] for c in ("ids", "labels", "dictionary", "starts", "codes"))
            values, at = dictionary.values.to_numpy(zero_copy_only=False), starts.values.to_numpy(zero_copy_only=False)
            own = np.frombuffer(codes.as_py(), dtype=np.uint16).reshape(len(at) - 1, -1)
            yield ids.values, labels.values, [values[a:b] for a, b in zip(at[:-1], at[1:])], own


def nearest(values: list[np.ndarray], codes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each vector's part, and its squared distance.

    values: of each dimension of the part; codes: (dimension, vector); book: (entry, dimension).
    """
    span = max(int(abs(v).max()) for v in values) + int(abs(book).max())
    bound = span * span * len(values)
    kind: Any = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 63 else object
    tables = []
    for d, own in enumerate(values):
        difference = own.astype(kind)[:, None] - book[:, d].astype(kind)[None, :]
        tables.append(difference * difference)
    n = codes.shape[1]
    index, distance = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=object if kind is object else np.int64)
    for a in range(0, n, CHUNK_ROWS):
        part = codes[:, a : a + CHUNK_ROWS]
        total = tables[0][part[0]]
        for table, own in zip(tables[1:], part[1:]):
            total += table[own]
        index[a : a + CHUNK_ROWS] = best = total.argmin(axis=1)
        distance[a : a + CHUNK_ROWS] = total[np.arange(len(best)), best]
    return index, distance


def _next_books(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: entries replaced by the floor of their parts' mean."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)

        def flush() -> pa.RecordBatch:
            part, entry = np.nonzero(count)
            out = pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]),
                 pa.FixedSizeListArray.from_arrays(pa.array(total[part, entry].ravel()), width).cast(pa.list_(pa.int64()))],
                ["part", "entry", "n", "sums"])
            total[:], count[:] = 0, 0
            return out

        rows = 0
        for ids, _, values, codes in _blocks(batches):
            if rows + len(ids) > 1 << 22:  # 2^22 components of 2^40 at most: the sums stay inside 64 bits
                yield flush()
                rows = 0
            rows += len(ids)
            for p in range(parts):
                own = slice(p * width, (p + 1) * width)
                index, _ = nearest(values[own], codes[own], books[p])
                order = np.argsort(index, kind="stable")
                entry, at = np.unique(index[order], return_index=True)
                for d in range(p * width, (p + 1) * width):
                    total[p, entry, d - p * width] += np.add.reduceat(values[d][codes[d][order]], at)
                count[p] += np.bincount(index, minlength=entries)
        if rows:
            yield flush()

    found = blocks.mapInArrow(sums, "part int, entry int, n bigint, sums array<bigint>").groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(d)).cast("decimal(38,0)")) for d in range(width))).alias("sums"))
    after = books.copy()
    for row in found.toLocalIterator():
        after[row["part"], row["entry"]] = [int(s) // row["n"] for s in row["sums"]]
    return after


def first_books(kept: DataFrame, length: int, parts: int, entries: int) -> np.ndarray:
    """(part, entry, position): the parts of the first rows by id."""
    first = kept.where(_codable(F.col("v"), length)).select("vec_id", _integers(F.col("v")).alias("v"))
    rows = [r["v"] for r in first.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    return np.array(rows, dtype=np.int64).reshape(len(rows), parts, length // parts).transpose(1, 0, 2)


def trained_books(blocks: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    for _ in range(rounds):
        books = _next_books(blocks, books)
    return books


def books_sha256(books: np.ndarray) -> str:
    """Digest of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector in the blocks."""
    parts, _, width = books.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, values, codes in _blocks(batches):
            index, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), object)
            for p in range(parts):
                own = slice(p * width, (p + 1) * width)
                index[:, p], distance = nearest(values[own], codes[own], books[p])
                error = error + distance
            digits = index.tobytes().hex()
            step = 2 * parts
            yield pa.RecordBatch.from_arrays(
                [ids, labels, pa.array([digits[i : i + step] for i in range(0, len(digits), step)], pa.string()),
                 pa.array([int(e) if e < 1 << 63 else None for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    schema = blocks.schema
    id_type, label_type = (schema[c].dataType.elementType.simpleString() for c in ("ids", "labels"))
    return blocks.mapInArrow(assign, f"vec_id {id_type}, label {label_type}, code string, error bigint")


def compress(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error, label_error) of every usable row, and the codebooks as (part, entry, position).

    A code has two hexadecimal digits a part; ``label_error`` adds the errors of all rows of a label. Errors are summed
    per task before the shuffle, and the totals are a table that Spark joins by its size.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index has two hexadecimal digits: 1 to 256 entries")
    kept = kept_vectors(vectors, id_column, vector_column, label_column)
    length = usual_length(kept, parts)
    if length is None:
        books = np.zeros((parts, 0, 0), np.int64)
        coded = kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
    else:
        books = first_books(kept, length, parts, entries)
        blocks = written(value_blocks(kept, length), "vector-blocks")
        if books.size:
            books = trained_books(blocks, books, rounds)
        others = kept.where(~_codable(F.col("v"), length)).select(
            "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("bigint").alias("error"))
        coded = written(encoded(blocks, books).unionByName(others), "vector-codes")
    total = F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)")
    totals = written(coded.groupBy(F.struct("label").alias("group")).agg(total.alias("label_error")), "label-errors")
    return coded.withColumn("group", F.struct("label")).join(totals, "group", "left").drop("group"), books
