"""Corpus pipeline: classifier, near duplicates, decontamination, secrets, token ids.

``STAGES`` lists (name, function) in order; each function takes (spark, docs, sf_dir) and works on all
rows that the stage before kept. All but the last return the columns of ``documents``:

1. quality_classifier - documents whose tail probability of the good grade is too low go;
2. near_duplicates - one document of each group linked by word shingles stays, the one with the least id
   (five words a shingle, similarity 0.8 or more);
3. decontamination - documents that the benchmark covers go;
4. secret_masking - secrets in the texts left are masked and ``n_chars`` follows;
5. token_ids - SentencePiece ids of each text, and whether they decode to it.

Rows whose id is null are told apart by their text. Of repeated rows with a text, one stays after stage
2; documents without words link with nothing and pass it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import decontamination, ngram_join, quality_classifier, secrets, sentencepiece
from folioscope.llm.frames import written

SHINGLE, PERCENT = 5, 80


def _joined(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Documents with ("left_semi") or without ("left_anti") the given row keys, columns as they were.

    The keys are written first, so that Spark knows their size when it chooses how to join.
    """
    key = F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("k2")
    own = written(keys.select("k1", "k2").distinct(), "keys")
    return docs.select(F.struct("*").alias("row"), *key).join(own, ["k1", "k2"], how).select("row.*")


def _short_batches(spark: SparkSession) -> None:
    """Hand texts to Python a thousand rows at a time, unless the session says otherwise."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, "1000")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(docs, model, carry=True).where("kept").select("row.*")


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    groups = written(ngram_join.linked_groups(docs, size=SHINGLE, percent=PERCENT).where("n_shingles > 0"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "k1", "k2")
    first = written(groups.groupBy("group").agg(F.min(order).alias("f")), "first")  # by itself, so that a hot group's rows can be split in the join
    later = groups.join(first, "group").where((F.col("k1") != F.col("f.k1")) | (F.col("k2") != F.col("f.k2"))).select("k1", "k2")
    repeated = groups.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2")
    once = _joined(docs, repeated.join(later, ["k1", "k2"], "left_anti"), "left_semi").dropDuplicates(["doc_id", "text"])
    return _joined(docs, later.union(repeated), "left_anti").unionByName(once)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    found = decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _joined(docs, found.where("contaminated"), "left_anti")


def secret_masking_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def token_ids_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _short_batches(spark)
    return sentencepiece.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("secret_masking", secret_masking_stage),
    ("token_ids", token_ids_stage),
]

#: A fitted classifier and BPE ids cannot be said in SQL; tests check the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
