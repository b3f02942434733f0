"""Words that a polynomial hash confuses, signatures, sampling and gradients."""

import random
import time

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.llm import ngram_join, quality_classifier, quality_rules, secrets
from folioscope.llm.components import connected_components
from folioscope.llm.words import U64, blocks, packed_words

rng = random.Random(21)
#: Equal under every polynomial hash modulo 2^64 from 1,024 letters on.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_confuses(spark):
    assert len(set(next(blocks(pa.array([f"{THUE} {MORSE}"]))).word_hashes())) == 1
    texts = [THUE, MORSE, f"x y {THUE} x y {MORSE}", f"x y {THUE} x y {THUE}", f"p {THUE} q r", f"p {MORSE} q r"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_join.linked_groups(docs).collect()}
    assert [got[i].component_id for i in range(6)] == list(range(6))
    assert [got[i].n_shingles for i in range(6)] == [len(brute.shingles(t, 3)) for t in texts]
    rules = {r.doc_id: r.n_repeat_words for r in quality_rules.clean_lines(docs).collect()}
    assert [rules[i] for i in range(6)] == [brute.quality(t)[4] for t in texts] == [0, 0, 0, 6, 0, 0]


def test_word_keys_tell_words_apart():
    words = ["", "a", "aa", "ab", "ba", "b", "é", "漢字", "字漢", "a" * 300, "a" * 301, THUE, MORSE] + [f"w{i}" for i in range(3000)]
    rows = [" ".join(rng.sample(words, 40)) + " \t" for _ in range(200)] + [" ".join(words), "", None]
    seen = {}
    for b in blocks(pa.array(rows), size=3000):
        own = b.words(0, len(b.starts))
        assert [w.encode() for w in packed_words(b).to_pylist()] == own
        for word, key in zip(own, b.word_keys().tolist()):
            assert seen.setdefault(word, key) == key
    assert len(set(seen.values())) == len(seen) == len(words) - 1


def test_signatures_never_hide_a_link(spark):
    rows, true = [], []
    for i in range(400):
        n = rng.choice([1, 5, 60, 64, 65, 127, 130, 500, 1100])
        a = rng.sample(range(1 << 40), n)
        b = [x for x in a if rng.random() < 0.95] + rng.sample(range(1 << 40, 1 << 41), rng.randrange(max(1, n // 8)))
        b = b or [7]
        token = np.array(a + b, dtype=U64)
        row = np.repeat([0, 1], [len(a), len(b)])
        words, sizes = ngram_join.signatures(row, token, np.array([len(a), len(b)]))
        rows.append((i, words[: sizes[0]].tolist(), words[sizes[0] :].tolist()))
        true.append(len(set(a) ^ set(b)))
    apart = spark.createDataFrame(rows, "i long, sa array<bigint>, sb array<bigint>").select("i", ngram_join._bits_apart("sa", "sb").alias("d"))
    got = {r.i: r.d for r in apart.collect()}
    assert all(got[i] <= d for i, d in enumerate(true)) and sum(got.values()) > 0.3 * sum(true)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    rng.shuffle(edges)
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 160)} | {(200, 200), (201, 200)}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def prose(n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(rng.randrange(40)) for _ in range(n))


def test_labels_of_absent_documents_do_not_use_up_the_sample(spark):
    table = spark.createDataFrame([(i, prose(40) if i % 2 else prose(40).upper()) for i in range(40)], "doc_id long, text string")
    own = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    foreign = spark.range(10_000, 50_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    for labels in (own, own.unionByName(foreign)):
        model = quality_classifier.train(table, labels, rows=40)
        assert {r.doc_id for r in quality_classifier.score(table, model).where("kept").collect()} == {i for i in range(40) if i % 2}


def test_fit_goes_down_the_likelihood():
    """Small steps against the plain likelihood: thresholds in order, and a slope near zero at the end."""
    n, k = 60, 8
    rows = np.repeat(np.arange(n, dtype=np.int32), 3)
    slots = np.array([rng.randrange(k) for _ in range(3 * n)], dtype=np.int32)
    values = np.array([rng.random() + 0.5 for _ in range(3 * n)], dtype=np.float32)
    weight = np.zeros(n)
    np.add.at(weight, rows, (slots % 3 - 1) * values)
    grades = np.digitize(weight + np.array([rng.gauss(0, 1) for _ in range(n)]), [-0.7, 0.7]).astype(np.int64)

    def loss(model):
        score = np.zeros(n)
        np.add.at(score, rows, model.weights[slots] * values)
        edges = np.concatenate([[-np.inf], model.thresholds, [np.inf]])
        p = [1 / (1 + np.exp(-(edges[g + 1] - s))) - 1 / (1 + np.exp(-(edges[g] - s))) for g, s in zip(grades, score)]
        return -np.mean(np.log(p)) + quality_classifier.PENALTY / 2 * (model.weights**2).sum()

    model = quality_classifier.fit(rows, slots, values, grades)
    least = loss(model)
    assert model.thresholds[0] < model.thresholds[1]
    start = quality_classifier.Fit(np.zeros_like(model.weights), model.thresholds)
    assert least < loss(start) - 0.05
    for at in range(k):
        for step in (-1e-3, 1e-3):
            moved = model.weights.copy()
            moved[at] += step
            assert loss(model._replace(weights=moved)) > least - 2e-5
    for at in range(2):
        for step in (-1e-3, 1e-3):
            cuts = model.thresholds.copy()
            cuts[at] += step
            assert loss(model._replace(thresholds=cuts)) > least - 2e-5


def test_many_equal_rows(spark):
    docs = spark.createDataFrame([(1, prose(50)), (2, prose(50))], "doc_id long, text string")
    many = docs.unionByName(docs.where("doc_id = 1").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(10_000)))).drop("n"))
    got = ngram_join.linked_groups(many).groupBy("doc_id", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 1, 10_001), (2, 2, 1)}


@pytest.mark.parametrize("texts", [[], [None, "", "one", "one two"], ["same words here"] * 3])
def test_short_sets(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, groups = brute.groups(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_groups(docs).collect()}
    assert got == {i: (sizes[i], groups[i]) for i in range(len(texts))}


def test_very_many_secrets_in_one_text(spark):
    hexes = [f"{rng.randrange(1 << 100):025x}"[-25:] for _ in range(50_000)]
    text = " ".join(f"é{h}" if i % 3 else f"token={h}" for i, h in enumerate(hexes))
    docs = spark.createDataFrame([(1, text, 0), (2, "token=abcdef password: 'tokenxyz", 0)], "doc_id long, text string, n_chars int")
    started = time.time()
    got = {r.doc_id: r for r in secrets.mask_secrets(docs).collect()}
    assert time.time() - started < 40
    assert got[1].text == " ".join("é<secret>" if i % 3 else "<secret>" for i in range(50_000))
    assert got[1].n_chars == len(got[1].text)
    found = {r.doc_id: r for r in secrets.report(secrets.find_secrets(docs)).collect()}
    for i, t in ((1, text), (2, docs.collect()[1].text)):
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex, found[i].base_sha256) == brute.secrets(t)
