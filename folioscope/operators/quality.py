"""Quality and latency statistics over samples, and classifier evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.jsontext import collect_texts
from folioscope.operators.records import identity_of_lines
from folioscope.operators.routing import hitl
from folioscope.operators.telemetry import server_ms
from folioscope.rules import AUTO_ACCEPT, REJECT_BELOW
from folioscope.session import written

PERCENTILES = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}

_CHILD = "struct<label:string,probability:string,confidence:string,is_car:boolean,damage_detected:boolean>"
_BODY = (
    "confidence_score:string,overall_confidence:string,confidence:string,is_car:boolean,damage_detected:boolean,"
    f"classification:{_CHILD},car_classification:{_CHILD}"
)
RESPONSE = f"struct<{_BODY},data:struct<{_BODY}>>"


def response_metrics(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Confidence, label and flags of a response JSON, wrapped in ``data`` or bare.

    One parse per row; the first numeric confidence candidate counts.
    """
    def number(c: Column) -> Column:
        flag = F.when(c == "true", 1.0).when(c == "false", 0.0)
        return F.round(F.coalesce(flag, c.try_cast("double")), 4)

    def both(path: str) -> list[Column]:
        return [F.col(f"_r.data.{path}"), F.col(f"_r.{path}")]

    paths = (
        "confidence_score", "overall_confidence", "confidence", "classification.probability",
        "classification.confidence", "car_classification.confidence",
    )
    # A wrapped body answers alone; bare fields only count without one.
    wrapped = F.col("_r.data").isNotNull()

    def first(columns: Sequence[str], convert) -> Column:
        inner = F.coalesce(*[convert(both(p)[0]) for p in columns])
        bare = F.coalesce(*[convert(both(p)[1]) for p in columns])
        return F.when(wrapped, inner).otherwise(bare)

    parsed = df.withColumn("_r", F.from_json(payload, RESPONSE))
    same = lambda c: c
    return (
        parsed.withColumn("confidence_score", first(paths, number))
        .withColumn("classification_label", first(["classification.label"], same))
        .withColumn("is_car", first(["is_car", "car_classification.is_car"], same))
        .withColumn("damage_detected", first(["damage_detected", "car_classification.damage_detected"], same))
        .drop("_r")
    )


def _same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, k: a & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")), keys, F.lit(True))


#: Distinct values a bucket may have to be ranked one by one; fuller ones are cut again.
RANKED = 4096
#: Parts that a full bucket is cut into.
PARTS = 1024


def _by_value(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(_key, _v, _c, _s): how often each group has each value, and their exact sum. A null value counts nothing."""
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    v = F.col(value)
    # Combined before the shuffle and spread by value, so a group holding most rows is shared out.
    return df.groupBy(key.alias("_key"), v.cast("double").alias("_v")).agg(
        F.count(v).alias("_c"), F.sum(v.cast("decimal(28,8)")).alias("_s")
    )


def _buckets(level: DataFrame, *within: str) -> DataFrame:
    """Bounds, distinct values and first rank of every bucket of a level, counted from the start of its ``within``."""
    steps = W.partitionBy(*within).orderBy("_b")
    return (
        level.groupBy(*within, "_b").agg(
            F.sum("_c").alias("_bc"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        .withColumn("_end", F.sum("_bc").over(steps.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .withColumn("_n", F.sum("_bc").over(W.partitionBy(*within)))
        .withColumn("_start", F.col("_end") - F.col("_bc"))
    )


def _holding(ranks: Column) -> Column:
    return F.filter(ranks, lambda r: (r["rank"] >= F.col("_start")) & (r["rank"] < F.col("_end")))


def exact_percentiles(counted: DataFrame, probs: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles, rank (n-1)*p, of the groups of a value count (``_by_value``) of any size.

    All wanted ranks narrow down together. Counts per order-keeping bucket say which bucket holds a rank; a bucket with
    more than ``RANKED`` distinct values is cut into ``PARTS`` even parts between its bounds, and so on, so no
    bucket is ever ranked whole however narrow the band is that most values lie in. Each level reads only the
    values of the full buckets before it; as the first buckets have equal relative width, a few levels reach single values.
    """
    spots = F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.floor((F.col("_n") - 1) * p).alias("low"),
            ((F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)).alias("part"),
        )
        for name, p in probs.items()
    ])
    ranks = F.flatten(F.transform(spots, lambda s: F.array(
        F.struct(s["name"].alias("name"), s["low"].alias("rank"), (1.0 - s["part"]).alias("weight")),
        F.struct(s["name"].alias("name"), F.least(s["low"] + 1, F.col("_n") - 1).alias("rank"), s["part"].alias("weight")),
    )))
    kept = ["_key", "_b", "_d", "_lo", "_hi", "_start", "_want"]
    # asinh keeps the order and gives buckets of equal relative width.
    first = F.floor(F.asinh(F.col("_v") * 1e6) * 256).cast("bigint")
    level = counted.where("_c > 0").select("_key", F.array(first).alias("_b"), "_v", "_c")
    wanted = written(_buckets(level, "_key").withColumn("_want", _holding(ranks)).where(F.size("_want") > 0).select(*kept), "ranks")
    within = W.partitionBy("_key", "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    hits = []
    while True:
        hits.append(
            level.join(wanted.where(F.col("_d") <= RANKED), ["_key", "_b"])
            .withColumn("_hi", F.col("_start") + F.sum("_c").over(within))
            .withColumn("_hit", F.explode(F.filter("_want", lambda r: (r["rank"] >= F.col("_hi") - F.col("_c")) & (r["rank"] < F.col("_hi")))))
            .select("_key", "_v", "_hit")
        )
        full = wanted.where(F.col("_d") > RANKED)
        if full.isEmpty():
            break
        # Halves, so that the distance of the bounds is finite.
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        part = F.least(F.floor(share * PARTS), F.lit(PARTS - 1)).cast("bigint")
        cut = level.join(full, ["_key", "_b"])
        level = written(cut.select("_key", F.col("_b").alias("_up"), F.concat("_b", F.array(part)).alias("_b"), "_v", "_c"), "level")
        above = full.select("_key", F.col("_b").alias("_up"), F.col("_start").alias("_from"), F.col("_want").alias("_asked"))
        parts = _buckets(level, "_key", "_up").join(above, ["_key", "_up"])
        parts = parts.withColumn("_start", F.col("_start") + F.col("_from")).withColumn("_end", F.col("_end") + F.col("_from"))
        wanted = written(parts.withColumn("_want", _holding(F.col("_asked"))).where(F.size("_want") > 0).select(*kept), "ranks")
        level = level.drop("_up")
    return reduce(DataFrame.union, hits).groupBy("_key").agg(*[
        F.sum(F.when(F.col("_hit.name") == name, F.col("_v") * F.col("_hit.weight"))).alias(name) for name in probs
    ])


def latency_summary(df: DataFrame, by: Sequence[str], value: str = "elapsed_ms",
                    percentiles: dict[str, float] | None = None, empty: float | None = None) -> DataFrame:
    """min / mean / percentiles / max per group, two decimals; ``empty`` fills groups without values.

    The samples are read once: every figure comes from one written table of values and their counts per group. The mean
    is over exact decimal sums, the same whatever the partitioning.
    """
    probs = percentiles or PERCENTILES
    counted = written(_by_value(df, by, value), "values")
    base = counted.groupBy("_key").agg(
        F.sum("_c").alias("n"), F.min("_v").alias("min"), F.try_divide(F.sum("_s"), F.sum("_c")).cast("decimal(28,8)").alias("mean"), F.max("_v").alias("max")
    )
    joined = base.join(exact_percentiles(counted, probs), "_key", "left")
    stats = ["min", "mean", *probs, "max"]
    rounded = [F.round(s, 2).cast("double").alias(s) for s in stats]
    if empty is not None:
        rounded = [F.coalesce(c, F.lit(empty)).alias(s) for c, s in zip(rounded, stats)]
    return joined.select(*[F.col("_key")[k].alias(k) for k in by], "n", *rounded)


def success_rate(df: DataFrame, by: Sequence[str], percent: bool = False) -> DataFrame:
    """Runs, ok, failed and the rate: fraction with 4 decimals, or percent with 2."""
    runs, ok = F.count(F.lit(1)), F.count_if(F.col("ok"))
    rate = F.round(ok / runs * 100.0, 2) if percent else F.round(ok / runs, 4)
    return df.groupBy(*by).agg(
        runs.alias("runs"), ok.alias("ok"), (runs - ok).alias("failed"), rate.alias("success_rate")
    )


def throughput(df: DataFrame, by: Sequence[str], ts: str = "ts") -> DataFrame:
    """Requests per second of wall time; null when no time passed."""
    wall = (F.unix_micros(F.max(ts).cast("timestamp")) - F.unix_micros(F.min(ts).cast("timestamp"))) / 1e6
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.when(wall > 0, F.round(F.count(F.lit(1)) / wall, 4)).alias("throughput_rps")
    )


def category_counts(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Occurrences of each non-null value, as text."""
    return (
        df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("string").alias("category"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def first_example(df: DataFrame, by: Sequence[str], files: str = "upload_files", order: str = "run_index") -> DataFrame:
    """First upload path seen for every field name."""
    return (
        df.select(*by, order, F.explode(files).alias("field", "path")).groupBy(*by, "field")
        .agg(F.min(F.struct(order, "path"))["path"].alias("path"))
    )


def format_counts(df: DataFrame, by: Sequence[str], formats: str = "sample_formats") -> DataFrame:
    return (
        df.select(*by, F.explode(F.map_values(formats)).alias("format")).groupBy(*by, "format")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per group. Spark limits each map task to k rows per group before the shuffle."""
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def drop_warmup(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Leave out the first ``n`` runs of each group.

    Only the n warm-up rows per group are ranked (cut off before the shuffle); the rest is
    compared with the last of them. Those last rows are written first: Spark then knows their
    size, so with few groups the samples are not shuffled, and with many the join is one whose
    hot groups it can split. ``order`` must be unique within a group.
    """
    if n <= 0:
        return df
    by = list(by)
    warm = top_k(df.select(*by, *order), by, [F.col(c) for c in order], n)
    last = written(warm.groupBy(*by).agg(F.max(F.struct(*order)).alias("_last")), "warm-up")
    left, right = df.alias("l"), last.alias("r")
    return (
        left.join(right, _same_keys("l", "r", by), "left")
        .where(F.struct(*[F.col(f"l.{c}").alias(c) for c in order]) > F.col("_last")).select("l.*")
    )


def join_truth(pred: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    return pred.join(labels, key)


def confusion(df: DataFrame, threshold: float, by: Sequence[str] = ()) -> DataFrame:
    """TP / TN / FP / FN with precision and recall of ``score`` against boolean ``truth``."""
    said, truth = F.col("score") >= threshold, F.col("truth")
    counts = df.groupBy(*by).agg(
        F.count_if(said & truth).alias("tp"), F.count_if(~said & ~truth).alias("tn"),
        F.count_if(said & ~truth).alias("fp"), F.count_if(~said & truth).alias("fn"),
    )
    return _rates(counts)


def _rates(counts: DataFrame) -> DataFrame:
    return counts.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 4)).withColumn(
        "recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 4)
    )


def threshold_sweep(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Detections and confusion at many thresholds.

    Rows collapse to counts per number of thresholds passed, a handful of rows, before any
    of them is repeated for a threshold; a threshold with no detections still reports.
    """
    marks = sorted(set(thresholds))
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in marks]), lambda t: F.col("score") >= t))
    levels = df.groupBy(passed.alias("passed"), "truth").agg(F.count(F.lit(1)).alias("n"))
    spots = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(marks)])
    said, truth, n = F.col("passed") > F.col("s.i"), F.col("truth"), F.col("n")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n)), F.lit(0))

    counts = levels.withColumn("s", F.explode(spots)).groupBy(F.col("s.threshold").alias("threshold")).agg(
        total(said).alias("detections"), total(said & truth).alias("tp"), total(~said & ~truth).alias("tn"),
        total(said & ~truth).alias("fp"), total(~said & truth).alias("fn"),
    )
    return _rates(counts)


def parse_samples(samples: DataFrame, payload: str = "payload", accept: float = AUTO_ACCEPT,
                  reject: float = REJECT_BELOW, headers: str | None = None) -> DataFrame:
    """Response fields, the review decision and what the recognised lines show, of every sample.

    Samples without lines have no identity fields. With ``headers``, a header map, the server's time is read from it.
    """
    parsed = response_metrics(samples, payload).withColumn("hitl_decision", hitl(F.col("confidence_score"), accept, reject))
    if headers:
        parsed = parsed.withColumn("server_ms", server_ms(F.col(headers)))
    # Only payloads that name a text cross over to Python.
    named = F.when(F.contains(F.col(payload), F.lit('"text"')), F.col(payload))
    lines = parsed.withColumn("_lines", collect_texts(named))
    return lines.withColumn("_seen", identity_of_lines(F.col("_lines"))).withColumn(
        "aadhaar_number_found", F.col("_seen.id_found")).withColumn("required_field_count", F.col("_seen.score")).withColumn(
        "ocr_line_count", F.when(F.size("_lines") > 0, F.size("_lines"))).drop("_lines", "_seen")


def summaries(parsed: DataFrame, by: Sequence[str], ts: str = "ts") -> dict[str, DataFrame]:
    """Every summary of a parsed sample table; those whose column is not there are left out."""
    numbers = {"latency": "elapsed_ms", "confidence": "confidence_score", "server": "server_ms"}
    categories = {"decisions": "hitl_decision", "status_codes": "status_code", "errors": "error"}
    seen = {"aadhaar_number_found", "required_field_count", "ocr_line_count"} <= set(parsed.columns)
    identity = parsed.groupBy(*by).agg(
        F.count("ocr_line_count").alias("with_lines"), F.sum("ocr_line_count").alias("ocr_lines"),
        F.count_if("aadhaar_number_found").alias("identity_found"), F.sum("required_field_count").alias("identity_fields"),
    ) if seen else None
    return {
        "samples": parsed,
        "success": success_rate(parsed, by),
        "throughput": throughput(parsed, by, ts),
        **{n: latency_summary(parsed, by, c) for n, c in numbers.items() if c in parsed.columns},
        **{n: category_counts(parsed, c, by) for n, c in categories.items() if c in parsed.columns},
        **({"identity": identity} if identity is not None else {}),
    }
