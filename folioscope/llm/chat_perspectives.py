"""Multi-party perspective rotation of dialogues.

For every participant the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask holds the stretches to learn from: the speaker's own words with their end mark.
System turns are context in every perspective and no participant.

Turns are put in order by (turn, role, text), so ties and repeated rows have a fixed place; all are
rendered. A conversation is rendered in parts of ``per_part`` turn numbers. Where more than ``per_part``
turns share such a part (null, tied or repeated numbers), it is cut again every ``per_part`` positions,
and the conversation's later parts are numbered on from there. So no row holds more than ``per_part``
turns, and one conversation of any length spreads over many rows. Rows without a conversation id are
dialogues of their own, told apart by turn, role and text. A null role speaks as ``unknown``, a null text is empty, a null turn
comes first. A dialogue of system turns alone has no perspective. Marks inside a text are defused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folioscope.functions.binding import let
from folioscope.llm.frames import written

PER_PART = 64
START, END = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"


def _head(role: Column, speaker: Column) -> Column:
    name = F.when(role == SYSTEM, SYSTEM).when(role == speaker, "assistant").otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), name, F.lit("\n"))


def _mask(turns: Column, speaker: Column) -> Column:
    """Spans of the speaker's turns in the rendered text, in code points, end exclusive."""
    def step(a: Column, t: Column) -> Column:
        low = a["at"] + F.length(_head(t["role"], speaker))
        return let(low + F.length(t["text"]) + len(END), lambda high: F.struct(
            (high + 1).alias("at"),
            F.when(t["role"] == speaker, F.concat(a["out"], F.array(F.struct(low.alias("start"), high.alias("end")))))
            .otherwise(a["out"]).alias("out")))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    return F.aggregate(turns, empty, step, lambda a: a["out"])


def _with_before(rows: DataFrame, group: list[str], order: list[str], value: str) -> DataFrame:
    """The rows with ``before``: the sum of ``value`` over earlier rows of their group.

    Rows are dealt by ranges of group and order, so a large group fills many buckets; sums run within
    a bucket and go on from the totals of the buckets before it.
    """
    own = written(rows.repartitionByRange(*group, *order).withColumn("bucket", F.spark_partition_id()), "ranges")

    def earlier(name: str, keys: list[str], by: list[str]) -> Column:
        return F.coalesce(F.sum(name).over(W.partitionBy(*keys).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    totals = own.groupBy(*group, "bucket").agg(F.sum(value).alias("total"))
    starts = totals.select(*group, "bucket", earlier("total", group, ["bucket"]).alias("start"))
    within = own.withColumn("before", earlier(value, [*group, "bucket"], order))
    return within.join(starts, [*group, "bucket"]).withColumn("before", F.col("before") + F.col("start")).drop("bucket", "start")


def _cut(own: DataFrame, per_part: int) -> DataFrame:
    """The turns with ``times``, in parts of ``per_part`` turns at most."""
    talk = ["c", "a", "free"]
    sizes = own.groupBy(*talk, "part").agg(F.count(F.lit(1)).alias("n"))
    long = written(sizes.where(F.col("n") > per_part).select(*talk, "part"), "long")
    if long.isEmpty():
        return own.withColumn("times", F.lit(1))
    parts = sizes.join(long.select(*talk).distinct(), talk, "left_semi").withColumn("more", F.floor((F.col("n") - 1) / per_part))
    moved = written(_with_before(parts, talk, ["part"], "more").withColumnRenamed("before", "shift").drop("more"), "parts")
    marked = own.join(moved, [*talk, "part"], "left").withColumn("part", F.col("part") + F.coalesce("shift", F.lit(0))).drop("shift")
    short = marked.where(F.coalesce("n", F.lit(0)) <= per_part).withColumn("times", F.lit(1))
    order = ["turn", "role", "text"]
    counted = marked.where(F.col("n") > per_part).groupBy(*talk, "conv_id", "part", *order).agg(F.count(F.lit(1)).alias("times"))
    placed = _with_before(counted, [*talk, "part"], order, "times").withColumn("after", F.col("before") + F.col("times"))
    pieces = placed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("before") / per_part), F.floor((F.col("after") - 1) / per_part))))
    inside = F.least("after", (F.col("piece") + 1) * per_part) - F.greatest("before", F.col("piece") * per_part)
    cut = pieces.select(*talk, "conv_id", (F.col("part") + F.col("piece")).alias("part"), *order, inside.cast("int").alias("times"))
    return short.select(cut.columns).unionByName(cut)


def rotate(turns: DataFrame, per_part: int = PER_PART) -> DataFrame:
    """One row per conversation, speaker and part: conv_id, speaker, part, n_turns, rendered, mask."""
    role = F.coalesce("role", F.lit(UNKNOWN))
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("< |im_"))
    own = turns.select(
        "conv_id", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")).alias("alone"),
        F.floor(F.coalesce("turn", F.lit(0)) / per_part).cast("bigint").alias("part"), F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"), text.alias("text"))
    key = [F.coalesce("conv_id", F.lit(0)).alias("c"), F.coalesce("alone", F.lit(0)).alias("a"), F.col("conv_id").isNull().alias("free")]
    own = own.select(*key, "conv_id", "part", "turn", "role", "text")
    speakers = own.where(F.col("role") != SYSTEM).select("c", "a", "free", F.col("role").alias("speaker")).distinct()
    counted = _cut(own, per_part).groupBy("c", "a", "free", "part").agg(
        F.first("conv_id").alias("conv_id"), F.array_sort(F.collect_list(F.struct("turn", "role", "text", "times"))).alias("counted"))
    repeated = F.flatten(F.transform("counted", lambda t: F.array_repeat(t.dropFields("times"), t["times"])))
    parts = counted.select("c", "a", "free", "part", "conv_id", repeated.alias("turns"))
    each = parts.join(speakers, ["c", "a", "free"])
    rendered = F.array_join(F.transform("turns", lambda t: F.concat(_head(t["role"], F.col("speaker")), t["text"], F.lit(END + "\n"))), "")
    return each.select(
        "conv_id", "speaker", "part", F.size("turns").cast("bigint").alias("n_turns"), rendered.alias("rendered"),
        _mask(F.col("turns"), F.col("speaker")).alias("mask"))
