"""Registered queries against their SQL on the smallest tables, and the pipeline against plain versions."""

import os
import sys

import brute
import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline
from check_oracle import TABLES, _rows
from pyspark.sql import functions as F

from folioscope.llm import quality_classifier
from folioscope.llm.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, key):
    df = QUERIES[key](spark, SF_DIR)
    got = df.collect()
    if key not in ORACLES:
        assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
        return
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    result = con.execute(ORACLES[key])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert _rows(df.columns, got) == _rows(names, result.fetchall())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SF_DIR).write.parquet(path)
        after = spark.read.parquet(path)
        out[name] = (docs.collect(), after.collect(), docs.columns, after.columns)
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES]
    for name, (_, _, before, after) in list(stages.items())[:-1]:
        assert before == after, name


def test_classifier_stage(spark, stages):
    before, after, *_ = stages["quality_classifier"]
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    good = [i for i, r in labels.items() if r.quality and not r.toxic]
    bad = [i for i, r in labels.items() if r.toxic or not r.quality]
    assert sum(i in kept for i in good) > 0.95 * len(good) and sum(i in kept for i in bad) < 0.1 * len(bad)
    assert quality_classifier.GRADES == 3 and set(after) <= set(before)


def test_near_duplicate_stage(stages):
    before, after, *_ = stages["near_duplicates"]
    _, group = brute.groups([r.text for r in before], 5, 80)
    first = {}
    for r, g in zip(before, group):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    assert {r.doc_id for r in after} == set(first.values())


def test_decontamination_stage(spark, stages):
    before, after, *_ = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hit = brute.contamination([r.text for r in before], items)
    assert {r.doc_id for r in after} == {r.doc_id for r, h in zip(before, hit) if not h[4]}


def test_masking_stage(stages):
    before, after, *_ = stages["secret_masking"]
    texts = {r.doc_id: r for r in after}
    for r in before:
        left = texts[r.doc_id]
        if sum(brute.secrets(r.text)[:3]):
            assert left.text != r.text and sum(brute.secrets(left.text)[:3]) == 0
        else:
            assert left.text == r.text or "<secret>" in left.text
        assert left.n_chars == len(left.text)


def test_token_stage(stages):
    import sentencepiece as library

    from folioscope.llm.sentencepiece import MODEL

    before, after, *_ = stages["token_ids"]
    reference = library.SentencePieceProcessor(model_file=MODEL)
    ids = {r.doc_id: list(r.ids) for r in after}
    assert all(r.exact for r in after)
    assert ids == {r.doc_id: reference.encode(r.text) for r in before}


def test_extra_and_clashing_columns_pass_all_stages(spark, tmp_path):
    names = ["row", "k1", "k2", "_key1", "_key2", "group", "found", "rules", "n", "f", "spans", "contaminated", "kept"]
    rows = [(i, f"Words {i} of a text that tells number {i * i} and some more things. " * (3 + i % 4), "en", "s") for i in range(30)] + [(30, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("*", *(F.lit("x").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns and {r[n] for r in after.collect() for n in names} <= {"x"}, name
        docs = after
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert out.count() == docs.count()


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows = [(None, "The same words stand in this text. " * 9), (None, "Other words stand in that text. " * 9), (1, None), (2, ""), (2, ""), (3, "few")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[1:]:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 6, name
    empty = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0, name
        if name == "secret_masking":
            break
