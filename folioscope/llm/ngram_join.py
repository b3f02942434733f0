"""N-gram Jaccard join: a size-aware heavy-light self-join of shingle sets, down to linked groups.

Documents with equal sets form one class and are joined as one. Light classes (small sets) enumerate
the fixed-size subsets that a partner must share: two sets of n and m shingles link exactly if they
share a subset of ceil(90 (n + m) / 190) shingles. Heavy classes go to inverted lists of their prefix,
the rarest shingles of which any partner must hold one; lists are scanned under length and positional
bounds. The size where subsets become dearer than lists is worked out from their costs.

Rarity comes from a table of a fixed number of counters over the shingles of all documents. It only
orders the shingles; any order gives the same result.

A list is first scanned against one leader (the member with the fewest rarer shingles), so a group of
copies costs one comparison a member and list, not one a pair. Members already linked to each other
need no further comparison; what is left, members of a list in different components, is compared in
full. So every link between components is found, and no pairs inside a component are enumerated.

Before any set moves, pairs are compared by signatures of about a bit a shingle: the parity of the number of shingles in each of
2^k classes. Two signatures differ in no more bits than the sets differ in shingles, so a pair whose signatures differ in
more than a link allows is no link. Sets are then read for the pairs left.

Null, empty and blank texts have no shingles and link with nothing. Repeated rows have equal sets and
share a component. A null id never names a component unless the whole component has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.components import connected_components
from folioscope.llm.frames import bitmap, discard, keyed_texts, marked, written
from folioscope.llm.words import U64, Block, blocks, grams, mix

SHINGLE = 3
PERCENT = 90
SKETCH_BITS = 20
SKETCH_SLICES = 64
#: Cost of a posting (shuffle, scan, comparison of whole sets) against that of a subset row.
SCAN_COST = 12


def need(n: int, m: int, percent: int) -> int:
    """Least overlap at which sets of n and m shingles link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def subset_sizes(n: int, percent: int, light: int | None = None) -> list[int]:
    """Sizes of the subsets that a set of n shingles shares with its possible partners other than its equals."""
    partners = range(-(-percent * n // 100), 100 * n // percent + 1)
    if light is not None and n > light:
        partners = range(partners.start, light + 1)
    return sorted({c for m in partners if (c := need(n, m, percent)) <= min(n, m) and (m != n or c < n)})


def light_limit(percent: int, scan_cost: int = SCAN_COST) -> int:
    """Largest size up to which enumerating subsets is no dearer than scanning lists."""
    n = 1
    while True:
        rows = sum(_choose(n, n - c) for c in subset_sizes(n, percent))
        if rows > scan_cost * prefix_length(n, percent):
            return n - 1
        n += 1


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def shingle_sets(b: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle of a block, sorted; shorter texts have one, their whole sequence."""
    words = b.word_keys()
    hashes, at = grams(words, b.first, size)
    row_of = b.row_of_word()
    found, rows = [hashes], [row_of[at]]
    for n in range(1, size):
        short, start = grams(words, b.first, n)
        whole = b.counts[row_of[start]] == n
        found.append(mix(short[whole] + U64(n)))
        rows.append(row_of[start[whole]])
    token, row = np.concatenate(found), np.concatenate(rows)
    order = np.lexsort((token, row))
    token, row = token[order], row[order]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return row[new], token[new]


def rarity(docs: DataFrame, size: int) -> np.ndarray:
    """Counters of the shingles' document frequency, 2**SKETCH_BITS of them whatever the input."""
    each = (1 << SKETCH_BITS) // SKETCH_SLICES

    def slices(counts: np.ndarray, of: list[int]) -> pa.RecordBatch:
        parts = [counts[i * each : (i + 1) * each].tobytes() for i in of]
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for b in blocks(batch.column("text"), lower=True):
                _, token = shingle_sets(b, size)
                counts += np.bincount((token & U64(len(counts) - 1)).astype(np.int64), minlength=len(counts))
        yield slices(counts.astype(np.uint32) if counts.max(initial=0) < 1 << 32 else counts, list(range(SKETCH_SLICES)))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column("slice").to_pylist(), batch.column("counts")):
                raw = part.as_py()
                own = np.frombuffer(raw, np.uint32 if len(raw) == 4 * each else np.int64)
                total[i] = total.get(i, 0) + own.astype(np.int64)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["slice", "counts"])

    kind = "slice int, counts binary"
    summed = docs.select("text").mapInArrow(count, kind).repartition("slice").mapInArrow(add, kind).toArrow()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    for i, raw in zip(summed.column("slice").to_pylist(), summed.column("counts").to_pylist()):
        out[i * each : (i + 1) * each] = np.frombuffer(raw, np.int64)
    return np.minimum(out, (1 << 32) - 1).astype(np.uint32)


#: Words of a signature, by the size of the set: one bit a shingle, between the bounds.
LEAST_WORDS, MOST_WORDS = 1, 128


def signatures(row: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signature words of every set, and the number of words of each; a power of two that grows with the set."""
    words = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1) / 64)).clip(0).astype(np.int64), LEAST_WORDS, MOST_WORDS)
    start = np.concatenate([[0], np.cumsum(words)])
    bit = (mix(token + U64(0x2545F4914F6CDD1D)) & (words[row] * 64 - 1).astype(U64)).astype(np.int64)
    odd = (np.bincount(start[row] * 64 + bit, minlength=int(start[-1]) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), words


def _bits_apart(a: str, b: str) -> Column:
    """Bits in which two signatures differ; the longer is folded to the other's length."""

    def folded(s: Column, other: Column) -> Column:
        half = (F.size(s) / 2).cast("int")
        return F.when(F.size(s) > F.size(other), F.zip_with(F.slice(s, 1, half), F.slice(s, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(s)

    both = F.zip_with(folded(F.col(a), F.col(b)), folded(F.col(b), F.col(a)), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(both, F.lit(0), lambda s, x: s + x)


SETS = "k1 bigint, k2 bigint, doc_id {}, n int, d1 bigint, d2 bigint, heavy array<bigint>, light array<bigint>, signature array<bigint>"


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document the size and digest of its set, and the keys under which partners meet."""
    order, light = docs.sparkSession.sparkContext.broadcast(rarity(docs, size)), light_limit(percent)

    def subsets(tokens: np.ndarray) -> list[int]:
        parts = mix(tokens).tolist()
        whole, out = sum(parts), []
        for c in subset_sizes(len(parts), percent, light):
            seed = c * 0x9E3779B97F4A7C15
            out += [((whole - sum(left) + seed) & 0xFFFFFFFFFFFFFFFF) - (1 << 63) for left in combinations(parts, len(parts) - c)]
        return out

    def lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, pa.int64()))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text"), lower=True):
                part = batch.slice(b.row, b.rows)
                row, token = shingle_sets(b, size)
                n = np.bincount(row, minlength=b.rows)
                head = np.concatenate([[0], np.cumsum(n)])
                digests = [np.zeros(b.rows, dtype=U64) for _ in range(2)]
                for d, seed in zip(digests, (0x1B873593, 0xCC9E2D51)):
                    np.add.at(d, row, mix(token + U64(seed)))
                frequency = order.value[(token & U64((1 << SKETCH_BITS) - 1)).astype(np.int64)].astype(np.int64)
                by_rarity = np.argsort((row << 32) | frequency, kind="stable")
                place = np.arange(len(row)) - head[row]
                length = np.where(n > light, n - -(-percent * n // 100) + 1, 0)
                prefix = token[by_rarity][place < length[row]]
                signature, n_words = signatures(row, token, n)
                small = [subsets(token[head[r] : head[r + 1]]) if 0 < n[r] and percent * n[r] <= 100 * light else [] for r in range(b.rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), part.column("doc_id"), pa.array(n.astype(np.int32)),
                     *(pa.array(d.view(np.int64)) for d in digests), lists(prefix.view(np.int64), length),
                     pa.array(small, pa.list_(pa.int64())), lists(signature, n_words)],
                    ["k1", "k2", "doc_id", "n", "d1", "d2", "heavy", "light", "signature"])

    return docs.mapInArrow(describe, SETS.format(docs.schema["doc_id"].dataType.simpleString()))


def _needed(n: Column, m: Column, percent: int) -> Column:
    return F.ceil((percent * (n + m)) / F.lit(100 + percent))


def _postings(classes: DataFrame, column: str, kind: int) -> DataFrame:
    """Postings of keys that two classes or more hold: (kind, token, c, n, at)."""
    rows = classes.select("c", "n", F.posexplode(column).alias("at", "token"))
    held = rows.groupBy("token").agg(F.count(F.lit(1)).alias("length")).where("length > 1")
    return rows.join(held, "token").select(F.lit(kind).alias("kind"), "token", "c", "n", "at")


def _close(percent: int) -> Column:
    """Length and positional bound of two postings of one list; of subset keys the length bound alone."""
    n, m = F.col("n"), F.col("m")
    length = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    rest = F.least(n - F.col("at"), m - F.col("m_at"))
    return length & ((F.col("kind") == 1) | (rest >= _needed(n, m, percent)))


def _pairs(left: DataFrame, right: DataFrame, percent: int, *more: Column) -> DataFrame:
    """Distinct (a, b) of different classes that meet under a key and may link."""
    found = left.join(right, ["kind", "token"]).where(F.col("c") != F.col("d"))
    for condition in (_close(percent), *more):
        found = found.where(condition)
    return found.select(F.least("c", "d").alias("b"), F.greatest("c", "d").alias("a")).distinct()


def _as_partner(postings: DataFrame, *more: str) -> DataFrame:
    return postings.select("kind", "token", F.col("c").alias("d"), F.col("n").alias("m"), F.col("at").alias("m_at"), *more)


def _named(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Classes that pairs may name, by a filter of fixed size before the shuffle; a few others may pass."""
    ids = pairs.select(F.xxhash64("a").alias("h")).union(pairs.select(F.xxhash64("b").alias("h")))
    wanted = bitmap(ids, "h")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, dtype=np.uint8)
        for batch in batches:
            yield batch.take(pa.array(marked(bits, batch.column("h").to_numpy())))

    return classes.mapInArrow(take, classes.schema)


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity. Only sets of pairs whose signatures agree leave their task."""
    met = written(pairs, "met")
    slim = _named(classes.select(F.xxhash64("c").alias("h"), "c", "n", "signature"), met)
    sides = met.join(slim.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), "a").join(
        slim.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb")), "b")
    n, m = F.col("na"), F.col("nb")
    pairs = written(sides.where(_bits_apart("sa", "sb") <= n + m - 2 * _needed(n, m, percent)).select("a", "b"), "pairs")
    discard(met)
    ids = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    asked = written(classes.select("c", "k1", "k2").join(ids, "c"), "asked")
    wanted = bitmap(asked, "k1")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted, dtype=np.uint8)
        for batch in batches:
            batch = batch.take(pa.array(marked(bits, batch.column("k1").to_numpy())))
            for b in blocks(batch.column("text"), lower=True):
                row, token = shingle_sets(b, size)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.rows))])
                part = batch.slice(b.row, b.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k1"), part.column("k2"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(token.view(np.int64)))],
                    ["k1", "k2", "tokens"])

    found = docs.select("k1", "k2", "text").mapInArrow(sets, "k1 bigint, k2 bigint, tokens array<bigint>")
    whole = written(found.join(asked, ["k1", "k2"]).dropDuplicates(["c"]).select("c", "tokens"), "sets")
    both = pairs.join(whole.select(F.col("c").alias("b"), F.col("tokens").alias("tb")), "b").join(
        whole.select(F.col("c").alias("a"), F.col("tokens").alias("ta")), "a")
    shared = F.size(F.array_intersect("ta", "tb"))
    counted = both.select("a", "b", shared.alias("o"), (F.size("ta") + F.size("tb")).alias("s"))
    links = written(counted.where(100 * F.col("o") >= percent * (F.col("s") - F.col("o"))).select("a", "b"), "links")
    discard(pairs, asked, whole)
    return links


def linked_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """One row per document: k1, k2 (row key), doc_id, n_shingles, component_id (least id reachable by links), group.

    ``group`` numbers the components, also those without an id; it is null without shingles.
    """
    keyed = keyed_texts(docs, id_column, text_column)
    sets = written(_sets(keyed, size, percent), "sets")
    members = sets.where("n > 0").groupBy("d1", "d2").agg(
        F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("k1", "k2", "n", "heavy", "light", "signature")))
    classes = written(members.withColumn("c", F.monotonically_increasing_id()), "classes")
    # keys stand in the postings and the classes from here on: the wide tables go
    documents = written(sets.select("k1", "k2", "doc_id", "n", "d1", "d2"), "documents")
    discard(sets)
    postings = written(_postings(classes, "heavy", 0).unionByName(_postings(classes, "light", 1)), "postings")
    wide, classes = classes, written(classes.drop("heavy", "light"), "slim-classes")
    discard(wide)
    # subset keys are led by the smallest set, lists by the member with the fewest rarer shingles
    first = F.struct(F.when(F.col("kind") == 1, F.col("n")).otherwise(F.col("at")).alias("o"), "c", "n", "at")
    leaders = postings.groupBy("kind", "token").agg(F.min(first).alias("l")).select("kind", "token", "l.c", "l.n", "l.at")
    links = _links(_pairs(postings, _as_partner(leaders), percent), classes, keyed, size, percent)
    groups = connected_components(links)

    heavy = postings.where("kind = 0").select("token", "c", "n", "at")
    labelled = written(heavy.join(groups.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c")), "labelled")
    discard(postings)
    lead = F.min(F.struct("at", "c", "component")).alias("l")
    split = labelled.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), lead).where("x != y").select(
        "token", F.col("l.c").alias("leader"), F.col("l.component").alias("leading"))
    members = written(labelled.join(split, "token").withColumn("kind", F.lit(0)), "members")
    discard(labelled)
    outside = _as_partner(members.where("component != leading"), F.col("component").alias("other"))
    rest = _pairs(members.where("c != leader"), outside, percent, F.col("component") != F.col("other"))
    groups = connected_components(links.unionByName(_links(rest, classes, keyed, size, percent)))

    placed = classes.select("d1", "d2", "c", "rep").join(groups.withColumnRenamed("node", "c"), "c", "left").withColumn(
        "component", F.coalesce("component", "c"))
    least = placed.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = placed.join(least, "component").select("d1", "d2", "component", "component_id")
    return (
        documents.select("k1", "k2", "doc_id", "n", F.when(F.col("n") > 0, F.col("d1")).alias("d1"), "d2").join(named, ["d1", "d2"], "left")
        .select("k1", "k2", "doc_id", F.col("n").cast("bigint").alias("n_shingles"),
                F.when(F.col("component").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                F.col("component").alias("group")))
