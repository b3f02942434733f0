"""Quality classifier: ordinal cumulative-link regression over hashed text.

Labels grade a document 0 (toxic), 1 (low quality) or 2 (good). One weight vector over hashed words,
word beginnings, word shapes and immediate repetitions is shared by all grades; ordered thresholds cut its score:
P(grade <= k) = sigmoid(threshold_k - score). The fit gives an expected grade and the tail probability
of the selected grade, by which documents are kept.

The fit uses at most ``rows`` labelled documents (of those that are there, the ones whose ids hash lowest) and stops before
the document with which their distinct features would pass ``most_features``; everything is scored. The bounded sample goes to
one task, which fits and returns the weights; the driver never holds a document or its features.

Null and empty texts have no features and get the score 0. Unlabelled documents are scored like all
others. Of several labels of a document the lowest grade counts; labels without quality are left out.
Without any label all documents are kept. Repeated rows each get a row; the fit takes the least text of an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.words import ALPHANUMERIC, SPACED, U64, Block, blocks, mix

BITS = 18
GRADES = 3
TRAIN_ROWS = 4_000
TRAIN_FEATURES = 4_000_000
#: Features in fewer sampled documents than this get no weight.
MIN_DOCS = 3
STEPS, RATE, PENALTY, SCALE = 150, 0.1, 3e-4, 4.0
CHUNK = 1 << 19

#: Bytes of the word beginnings that count as features beside whole words.
STEMS = (4, 5, 6)
_WORD, _SHAPE, _REPEAT = (U64(x) for x in (0x51, 0x52, 0x53))
_classes = np.arange(256, dtype=np.uint8)
_classes[ord("A") : ord("Z") + 1] = ord("A")
_classes[ord("a") : ord("z") + 1] = ord("a")
_classes[0x80:] = ord("a")
_classes[ord("0") : ord("9") + 1] = ord("0")


class Fit(NamedTuple):
    weights: np.ndarray
    thresholds: np.ndarray  # of grades 0 .. GRADES - 2, rising


def _slot(hashes: np.ndarray, kind: np.uint64) -> np.ndarray:
    return (mix(hashes ^ mix(np.full(1, kind))) & U64((1 << BITS) - 1)).astype(np.int64)


def _shapes(b: Block) -> np.ndarray:
    """Hashes of words with every run of capitals, small letters or digits as one character."""
    kinds = _classes[b.data]
    keep = np.ones(len(kinds), dtype=bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | ~np.isin(kinds[1:], (65, 97, 48))
    keep[b.starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return b._replace(data=kinds[keep], starts=before[b.starts], ends=before[b.ends]).word_hashes()


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By block: first row, rows, then row, slot and value of each distinct feature of a row.

    The value is the square root of the feature's count per word.
    """
    for b, low in zip(blocks(column), blocks(column, ALPHANUMERIC, lower=True)):
        words, rows = b.word_hashes(), b.row_of_word()
        again = np.flatnonzero((words[1:] == words[:-1]) & (rows[1:] == rows[:-1])) + 1
        low_rows, size = low.row_of_word(), low.ends - low.starts
        slots = [_slot(low.word_hashes(), _WORD), _slot(_shapes(b), _SHAPE), _slot(np.zeros(len(again), U64), _REPEAT)]
        where = [low_rows, rows, rows[again]]
        for n in STEMS:
            longer = size > n
            stems = low._replace(starts=low.starts[longer], ends=low.starts[longer] + n)
            slots.append(_slot(stems.word_hashes(), U64(n)))
            where.append(low_rows[longer])
        pairs, count = np.unique((np.concatenate(where) << BITS) | np.concatenate(slots), return_counts=True)
        row = pairs >> BITS
        yield b.row, b.rows, row, pairs & ((1 << BITS) - 1), SCALE * np.sqrt(count / np.maximum(b.counts, 1)[row])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def fit(rows: np.ndarray, slots: np.ndarray, values: np.ndarray, grades: np.ndarray) -> Fit:
    """Weights and thresholds by full-batch Adam on the likelihood of the cumulative links."""
    n = len(grades)
    if not n:
        return Fit(np.zeros(1 << BITS), np.full(GRADES - 1, -60.0))
    wide = np.bincount(slots, minlength=1 << BITS) >= MIN_DOCS
    held = wide[slots]
    used = np.flatnonzero(wide)
    at, rows, values = (np.cumsum(wide, dtype=np.int32) - 1)[slots[held]], rows[held], values[held]
    share = np.bincount(grades, minlength=GRADES) + 1.0
    log_odds = np.log(np.cumsum(share)[:-1] / (share.sum() - np.cumsum(share)[:-1]))
    state = np.concatenate([np.zeros(len(used)), log_odds[:1], np.log(np.maximum(np.diff(log_odds), 1e-3))])
    mean, square = np.zeros_like(state), np.zeros_like(state)
    k = len(used)
    del held, wide
    parts = [slice(a, a + CHUNK) for a in range(0, len(at), CHUNK)]  # so that no step makes an array of all features
    for step in range(1, STEPS + 1):
        score = np.zeros(n)
        for c in parts:
            score += np.bincount(rows[c], weights=state[at[c]] * values[c], minlength=n)
        cuts = np.cumsum(np.concatenate([state[k : k + 1], np.exp(state[k + 1 :])]))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper, lower = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        slope = np.zeros_like(state)
        pull = (du - dl) / n
        for c in parts:
            slope[:k] += np.bincount(at[c], weights=pull[rows[c]] * values[c], minlength=k)
        slope[:k] += PENALTY * state[:k]
        by_cut = (np.bincount(grades, weights=-du, minlength=GRADES)[: GRADES - 1] + np.bincount(grades, weights=dl, minlength=GRADES)[1:]) / n
        slope[k:] = np.cumsum(by_cut[::-1])[::-1]
        slope[k + 1 :] *= np.exp(state[k + 1 :])
        mean += 0.1 * (slope - mean)
        square += 0.001 * (slope**2 - square)
        state -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = state[:k]
    return Fit(weights, np.cumsum(np.concatenate([state[k : k + 1], np.exp(state[k + 1 :])])))


def graded(labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, grade) of labelled documents."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return (
        labels.select(F.col(id_column).alias("doc_id"), grade.alias("grade")).dropna()
        .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", rows: int = TRAIN_ROWS,
    most_features: int = TRAIN_FEATURES,
) -> Fit:
    """Fit on the labelled documents whose ids hash lowest, ``rows`` and ``most_features`` of their features at most."""
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    # labels of documents that are not there must not use up the sample
    present = graded(labels).join(own.select("doc_id"), "doc_id", "left_semi")
    sample = present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, row, slot, value in features(batch.column("text")):
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), batch.column("grade").slice(first, n),
                     pa.ListArray.from_arrays(ends, pa.array(slot.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(value.astype(np.float32)))],
                    ["doc_id", "grade", "slots", "shares"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, slot, value, grades, total = [], [], [], [], 0
        for batch in batches:
            sizes = batch.column("slots").value_lengths().to_numpy()
            within = int(np.searchsorted(total + np.cumsum(sizes), most_features, side="right"))
            n = int(sizes[:within].sum())
            row.append(np.repeat(np.arange(within, dtype=np.int32) + np.int32(sum(map(len, grades))), sizes[:within]))
            slot.append(batch.column("slots").flatten().to_numpy()[:n])
            value.append(batch.column("shares").flatten().to_numpy()[:n])
            grades.append(batch.column("grade").to_numpy()[:within].astype(np.int64))
            total += n
            if within < batch.num_rows:
                break
        if row:
            joined = []
            for held in (row, slot, value, grades):
                joined.append(np.concatenate(held))
                held.clear()
            model = fit(*joined)
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float64).tobytes()]) for x in model], ["weights", "thresholds"])

    kind = own.schema["doc_id"].dataType.simpleString()
    # one row an id, however often the document table repeats it: the least text, found before texts are described
    once = own.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    chosen = once.select("doc_id", "text", "grade").mapInArrow(describe, f"doc_id {kind}, grade int, slots array<int>, shares array<float>")
    ordered = chosen.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id", "grade", F.hash("slots")).limit(rows)
    got = ordered.select("grade", "slots", "shares").mapInArrow(fitted, "weights binary, thresholds binary").first()
    if got is None:
        return fit(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.int64))
    return Fit(*(np.frombuffer(x, dtype=np.float64) for x in got))


def score(
    docs: DataFrame, model: Fit, id_column: str = "doc_id", text_column: str = "text", least_grade: int = 2, least: float = 0.65,
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc_id, score, expected_grade, tail (P(grade >= least_grade)), kept (tail >= least).

    With ``carry``, the whole row stands in a struct column ``row`` in place of doc_id.
    """
    key = F.struct("*") if carry else F.col(id_column)
    own = docs.select(key.alias("row" if carry else "doc_id"), *([] if carry else [F.col(text_column).alias("text")]))
    shared = own.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, cuts = shared.value
        for batch in batches:
            texts = batch.column("row").field(text_column) if carry else batch.column("text")
            for first, n, row, slot, value in features(texts):
                total = np.bincount(row, weights=weights[slot] * value, minlength=n)
                above = 1 - _sigmoid(cuts[None, :] - total[:, None])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(total), pa.array(above.sum(axis=1)), pa.array(above[:, least_grade - 1])],
                    [batch.schema.names[0], "score", "expected_grade", "tail"])

    kind = T.StructType([own.schema[0], *(T.StructField(c, T.DoubleType()) for c in ("score", "expected_grade", "tail"))])
    return own.mapInArrow(run, kind).withColumn("kept", F.col("tail") >= least)
