"""Vector code compression against plain Python integers."""

import hashlib
import math
import random

import pytest

from folioscope.llm.vector_codes import books_sha256, compress

rng = random.Random(11)
SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, v int, `group` int"


def plain(rows, parts, entries, rounds, least=1 << 30):
    """(id, label, code, error) per usable row, and the codebooks."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in kept if v and len(v) % parts == 0]
    usual = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0
    codable = [(i, [math.floor(1024 * x) for x in v], l) for i, v, l in kept if len(v) == usual and all(abs(x) <= least for x in v)]
    codable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = usual // parts
    books = [[v[p * width : (p + 1) * width] for _, v, _ in codable[:entries]] for p in range(parts)]

    def near(v, p):
        own = v[p * width : (p + 1) * width]
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        groups = [{} for _ in range(parts)]
        for _, v, _ in codable:
            for p in range(parts):
                groups[p].setdefault(near(v, p)[1], []).append(v[p * width : (p + 1) * width])
        for p in range(parts):
            for k, own in groups[p].items():
                books[p][k] = [sum(c) // len(c) for c in zip(*own)]
    out = []
    for i, v, l in codable:
        found = [near(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        out.append((i, l, "".join(f"{k:02x}" for _, k in found), error if error < 1 << 63 else None))
    out += [(i, l, None, None) for i, v, l in kept if len(v) != usual or any(abs(x) > least for x in v)]
    return out, books


def check(spark, rows, parts=4, entries=256, rounds=4):
    df = spark.createDataFrame([(i, v, l, "x", "y", 1, 2) for i, v, l in rows], SCHEMA).repartition(3)
    coded, books = compress(df, parts=parts, entries=entries, rounds=rounds)
    want, plain_books = plain(rows, parts, entries, rounds)
    totals = {}
    for _, label, _, error in want:
        if error is not None:
            totals[label] = totals.get(label, 0) + error
    got = sorted(map(repr, ((r.vec_id, r.label, r.code, r.error, r.label_error) for r in coded.collect())))
    assert got == sorted(repr((i, l, c, e, totals.get(l))) for i, l, c, e in want)
    joined = ",".join(str(x) for part in plain_books for entry in part for x in entry)
    assert books_sha256(books) == hashlib.sha256(joined.encode()).hexdigest()


def vectors(n, width=8, spread=0.5):
    f = lambda: rng.randrange(-1000, 1000) / 1999 * spread
    return [(i * 3, [float.fromhex((f()).hex()) for _ in range(width)], rng.choice([None, 1, 2, 2, 2])) for i in range(n)]


def test_every_odd_row(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [round(x * 256) / 256 for x in v], l) for i, v, l in vectors(60)]
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.5] * 8, None), (1003, [0.5] * 7 + [nan], 1), (1004, [0.5] * 7 + [-inf], 1),
             (1005, [0.5] * 7 + [None], 2), (1006, [0.25] * 4, 2), (1007, [2.0**31] + [0.0] * 7, 2), (None, [0.125] * 8, 1),
             (0, rows[0][1], rows[0][2]), (3, [-0.00048828125] * 8, 7)] + [(9, [0.75] * 8, 5)] * 20
    check(spark, rows, entries=16, rounds=3)
    check(spark, rows, parts=2, entries=256, rounds=4)


def test_few_rows_and_hot_vector(spark):
    rows = [(i, [round(x * 64) / 64 for x in v], l) for i, v, l in vectors(30)]
    check(spark, rows + [(i, [0.5] * 8, 3) for i in range(100, 400)], entries=8)
    check(spark, rows[:1])


def test_wide_values_stay_exact(spark):
    rows = [(i, [float(round(x * 2**20)) for x in v], i) for i, v, _ in vectors(25, spread=2.0)]
    check(spark, rows, entries=6, rounds=2)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    coded, books = compress(df)
    assert coded.count() == 0 and books_sha256(books) == hashlib.sha256(b"").hexdigest()
    only_bad = spark.createDataFrame([(1, [1.0, 2.0], 1, "x", "y", 1, 2)], SCHEMA)
    assert [tuple(r) for r in compress(only_bad)[0].collect()] == [(1, 1, None, None, None)]


def test_entries_are_two_digits(spark):
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([], SCHEMA), entries=257)
