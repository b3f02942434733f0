"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The lattice is walked once from left to right. Each boundary keeps one backpointer, to the start of
the last piece of the best segmentation that ends there; as no piece is longer than the longest of
the vocabulary, only that many boundaries stay alive. Whenever the paths of all living boundaries
run through one earlier boundary, the ids up to it are final and leave the window. Results do not
depend on where ids are committed.

Unigram models keep the segmentation with the highest total score (on ties the longer last piece).
BPE models keep the one that merging by rank gives: a segmentation is that of merging exactly when
each two neighbouring pieces stay apart if merged on their own, so a step is allowed between such
pieces only, and one backpointer per boundary is left. Characters outside the vocabulary become
their UTF-8 byte pieces.

Decoding joins pieces, turns the space mark back into a space and drops the leading mark; it gives
the text back unless that holds U+2581 itself, which the model cannot tell from a space (``exact``
is false then). Null and empty texts have no ids and decode to an empty text. Repeated rows each
get a row; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.words import BLOCK_BYTES, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Bounds of the per-worker memories of words and of piece pairs; a full one starts anew.
WORDS, PAIRS, LONGEST_WORD = 600_000, 500_000, 64

_NONE: dict[str, bool] = {}
_words = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Model:
    """Vocabulary of a model file with identity normalisation."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(serialized)
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or not proto.trainer_spec.byte_fallback:
            raise ValueError("only unigram and BPE models with byte fallback are supported")
        self.kind = proto.trainer_spec.model_type
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes = [0] * 256
        self.texts: list[str] = []
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                self.ids[p.piece], self.scores[p.piece] = i, p.score
                self.texts.append(p.piece.replace(MARK, " "))
            elif p.type == BYTE:
                value = int(p.piece[3:5], 16)
                self.bytes[value] = i
                self.texts.append(chr(value) if value < 0x80 else chr(0xDC00 + value))
            elif p.type in (UNKNOWN, CONTROL):
                self.texts.append("")
            else:
                raise ValueError(f"piece type {p.type} is not supported")
        self.longest = max(map(len, self.ids))
        self.unknown = min(self.scores.values()) - 10
        #: Pieces by their characters: each character leads to the piece that ends with it, if any, and on.
        self.tree: dict[str, list] = {}
        for p in self.ids:
            node = [None, self.tree]
            for c in p:
                node = node[1].setdefault(c, [None, {}])
            node[0] = p
        #: Text may be cut before a mark that follows another character if no piece spans that place.
        self.words = not any(MARK in p.lstrip(MARK) for p in self.ids)
        self._apart: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._known: dict[str, tuple[int, ...]] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best-ranked neighbours, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def apart(self, left: str, right: str) -> bool:
        """Whether merging leaves two neighbouring pieces as they are."""
        if left not in self.ids:
            return True
        if self._pairs >= PAIRS:
            self._apart.clear()
            self._pairs = 0
        self._pairs += 1
        # pieces that may merge into one do not stay apart; others must come out of merging as they are
        whole = left + right
        known = whole not in self.ids and self.merged(whole) == [left, right]
        self._apart.setdefault(left, {})[right] = known
        return known

    def piece_ids(self, piece: str) -> tuple[int, ...]:
        known = self.ids.get(piece)
        return (known,) if known is not None else tuple(self.bytes[b] for b in piece.encode())

    def viterbi(self, text: str) -> Iterator[tuple[int, ...]]:
        """Ids of a marked text, piece by piece, as soon as they are final.

        ``last`` holds the piece that ends at each living boundary, which is its backpointer too.
        """
        settled, total, window, bpe = 0, len(text), self.longest, self.kind == BPE
        tree, known, scores, unknown = self.tree, self._apart, self.scores, self.unknown
        last, score = {0: ""}, {0: 0.0}
        for start in range(total):
            before, branch, end = last[start], tree, start
            apart = known.get(before, _NONE)
            for character in text[start : start + window]:
                node = branch.get(character)
                if node is None:
                    break
                piece, branch = node
                end += 1
                if piece is None:
                    continue
                if not bpe:
                    sum_ = score[start] + scores[piece]
                    if end not in score or sum_ > score[end]:
                        last[end], score[end] = piece, sum_
                elif end not in last:
                    free = apart.get(piece)
                    if free or (free is None and self.apart(before, piece)):
                        last[end] = piece
            if start + 1 not in last:
                last[start + 1] = text[start]
                if not bpe:
                    score[start + 1] = score[start] + unknown
            elif not bpe and text[start] not in scores and score[start] + unknown > score[start + 1]:
                last[start + 1], score[start + 1] = text[start], score[start] + unknown
            if start - settled < 3 * window and start + 1 < total:
                continue
            # everything up to here is explored: later pieces start at boundaries behind it
            alive = {b for b in last if b > start}
            while len(alive) > 1:
                latest = max(alive)
                alive.remove(latest)
                alive.add(latest - len(last[latest]))
            common = alive.pop()
            if common > settled:
                pieces, at = [], common
                while at > settled:
                    pieces.append(last[at])
                    at -= len(last[at])
                for piece in reversed(pieces):
                    yield self.piece_ids(piece)
                settled = common
                last = {b: p for b, p in last.items() if b >= common}
                score = {b: v for b, v in score.items() if b >= common}

    def encode(self, text: str) -> Iterator[tuple[int, ...]]:
        if not text:
            return iter(())
        marked = self.prefix + text.replace(" ", MARK)
        if not self.words:
            return self.viterbi(marked)
        parts = _words.findall(marked)
        for part in set(parts).difference(self._known):
            if len(part) <= LONGEST_WORD:
                self._known[part] = tuple(chain.from_iterable(self.viterbi(part)))
        return (self._known[p] if p in self._known else tuple(chain.from_iterable(self.viterbi(p))) for p in parts)

    def forget(self) -> None:
        if len(self._known) >= WORDS:
            self._known.clear()

    def decode(self, ids: Iterator[int]) -> str:
        text = "".join(map(self.texts.__getitem__, ids))
        if text and not text.isascii():
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


_loaded: dict[bytes, Model] = {}


def _model(shared: Broadcast) -> Model:
    """The broadcast model with its memories, kept by content for all tasks of a Python worker."""
    key = hashlib.sha256(shared.value).digest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(shared.value)
    return _loaded[key]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of a bounded number of text bytes, one row at least."""
    _, offsets = text_bytes(column)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, side="right")) - 1)
        yield row, last
        row = last


def _ranks(values: array, sizes: list[int]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(values, np.int32)))


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: doc_id, n_ids, ids, exact, decoded_sha256 (digest of the decoded ids)."""
    own = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    with open(model, "rb") as file:
        shared = own.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _model(shared)
        for batch in batches:
            for low, high in _slices(batch.column("text")):
                part = batch.slice(low, high - low)
                flat, sizes, decoded = array("i"), [], []
                texts = part.column("text").to_pylist()
                for text in texts:
                    before = len(flat)
                    flat.extend(chain.from_iterable(vocabulary.encode(text or "")))
                    vocabulary.forget()
                    sizes.append(len(flat) - before)
                    decoded.append(vocabulary.decode(flat[before:]))
                exact = [d == (t or "") for d, t in zip(decoded, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), _ranks(flat, sizes), pa.array(exact, pa.bool_()), pa.array(decoded, pa.string())],
                    ["doc_id", "ids", "exact", "decoded"])

    kind = own.schema["doc_id"].dataType.simpleString()
    coded = own.mapInArrow(run, f"doc_id {kind}, ids array<int>, exact boolean, decoded string")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), "ids", "exact", F.sha2("decoded", 256).alias("decoded_sha256"))


def decode(coded: DataFrame, id_column: str = "doc_id", ids_column: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) of id lists; a null list decodes to an empty text."""
    own = coded.select(F.col(id_column).alias("doc_id"), F.col(ids_column).alias("ids"))
    with open(model, "rb") as file:
        shared = own.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _model(shared)
        for batch in batches:
            texts = [vocabulary.decode(i or ()) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
