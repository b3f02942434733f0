"""Claims: the car gate, per-view predictions, plates and the claim report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scores import fallback_severity
from folioscope.rules import (
    CAR_THRESHOLD, GENERAL_DAMAGE_ACTION, GENERAL_DAMAGE_TYPE, NO_CAR_MESSAGE, PLATE_UNAVAILABLE, VIEW_PRIORITY,
)


def car_gate(views: DataFrame, gate: DataFrame, threshold: float = CAR_THRESHOLD,
             keys: tuple[str, ...] = ("claim_id", "view")) -> tuple[DataFrame, DataFrame]:
    """(views that show a car, views skipped with reason and confidence).

    ``gate`` holds one car probability per view.
    """
    passed = gate.where(F.col("car_prob") >= threshold).select(*keys)
    failed = gate.where(F.col("car_prob") < threshold).select(
        *keys, F.lit("not_a_car").alias("reason"), F.round(1.0 - F.col("car_prob"), 4).alias("car_confidence")
    )
    return views.join(passed, list(keys), "left_semi"), failed.join(views, list(keys), "left_semi")


def gate_in_place(views: DataFrame, threshold: float = CAR_THRESHOLD) -> DataFrame:
    """The same gate where the probability already sits on the view row: no join."""
    is_car = F.col("car_prob") >= threshold
    return views.withColumn("is_car", is_car).withColumn(
        "car_confidence", F.round(F.when(is_car, F.col("car_prob")).otherwise(1.0 - F.col("car_prob")), 4)
    )


def view_rank(view: Column) -> Column:
    rank = F.lit(None).cast("int")
    for position, name in reversed(list(enumerate(VIEW_PRIORITY))):
        rank = F.when(view == name, position).otherwise(rank)
    return rank


def priority_view(views: DataFrame, claim: str = "claim_id") -> DataFrame:
    """First available of front, back, left, right."""
    return views.groupBy(claim).agg(F.min_by("view", view_rank(F.col("view"))).alias("source_view"))


def fallback_damage(views: DataFrame) -> DataFrame:
    """Give damaged views without a localised entry one general entry."""
    general = F.struct(
        F.lit(GENERAL_DAMAGE_TYPE).alias("type"), fallback_severity(F.col("prob_damaged")).alias("severity"),
        F.round("prob_damaged", 4).alias("confidence"),
        F.array(F.lit(0.5), F.lit(0.5), F.lit(1.0), F.lit(1.0)).alias("bbox"),
        F.lit("unknown").alias("region"), F.array(F.lit("undetermined")).alias("parts_at_risk"),
        F.lit(False).alias("replace"), F.lit(GENERAL_DAMAGE_ACTION).alias("repair_action"),
        F.col("view").alias("view"),
    )
    needed = F.col("damage_detected") & (F.coalesce(F.size("damages"), F.lit(0)) <= 0)
    return views.withColumn("general_damage", F.when(needed, general))


def best_effort(fn, default):
    """Wrap a per-value function for use inside a vectorised UDF: (value, error) per row,
    so a failing row yields the default and its reason while the rest goes on."""

    def guarded(value):
        try:
            return {"value": fn(value), "error": None}
        except Exception as exc:  # a bad row must not stop the job
            return {"value": default, "error": f"{type(exc).__name__}: {exc}"}

    return guarded


def claim_rollup(views: DataFrame, claims: DataFrame, claim: str = "claim_id") -> DataFrame:
    """One report per claim from its gated view predictions.

    ``views`` has claim, view, is_car, car_confidence, damage_detected, confidence_score,
    prob_damaged, prob_clean and optionally view_error and damages. Every view name is
    reported, known or not; a null name counts as "unknown". Repeated rows of a view: one that
    shows a car speaks, then the one with the highest damage probability. Rows combine to one
    a view before a claim's views meet in a map.
    """
    error = F.col("view_error") if "view_error" in views.columns else F.lit(None).cast("string")
    damages = [F.col("damages")] if "damages" in views.columns else []
    detected = F.coalesce(error.isNull() & F.col("damage_detected"), F.lit(False))
    prediction = F.struct(
        detected.alias("damage_detected"), "confidence_score", "prob_damaged", "prob_clean", *damages, error.alias("error")
    )
    order = F.struct("is_car", "prob_damaged", "car_confidence")
    name = F.coalesce("view", F.lit("unknown")).alias("view")
    each = views.groupBy(claim, name).agg(
        F.max_by(F.struct("is_car", "car_confidence", prediction.alias("p")), order).alias("v")
    ).select(claim, "view", "v.*")
    damaged = F.col("is_car") & F.col("p.damage_detected")
    skipped = F.struct(F.lit("not_a_car").alias("reason"), "car_confidence")

    def by_view(wanted: Column, value: Column) -> Column:
        return F.map_from_entries(F.sort_array(F.collect_list(F.when(wanted, F.struct("view", value.alias("value"))))))

    sums = each.groupBy(claim).agg(
        F.bool_or(damaged).alias("_damaged"), F.max(F.when(damaged, F.col("p.confidence_score"))).alias("_best"),
        F.bool_or(F.col("is_car") & F.col("p.error").isNotNull()).alias("_error"),
        by_view(F.col("is_car"), F.col("p")).alias("_seen"), by_view(~F.col("is_car"), skipped).alias("_skip"),
    )
    total = F.coalesce(F.size("per_view"), F.lit(0))
    return (
        claims.select(claim).distinct().join(sums, claim, "left")
        .select(
            claim, F.coalesce("_damaged", F.lit(False)).alias("damage_detected"),
            F.round(F.coalesce("_best", F.lit(0.0)), 4).alias("overall_confidence"),
            F.coalesce("_seen", F.map_from_arrays(F.array(), F.array()).cast(sums.schema["_seen"].dataType)).alias("per_view"),
            F.coalesce("_error", F.lit(False)).alias("any_view_error"),
            F.coalesce("_skip", F.map_from_arrays(F.array(), F.array()).cast(sums.schema["_skip"].dataType)).alias("skipped_views"),
        )
        .withColumn("total_views_analyzed", total)
        .withColumn("message", F.when(F.col("total_views_analyzed") == 0, F.lit(NO_CAR_MESSAGE)))
    )


def attach_plate(claims: DataFrame, plates: DataFrame, due: Column, claim: str = "claim_id") -> DataFrame:
    """Add the plate read on each claim's chosen view; default values otherwise.

    ``plates`` has claim, source_view, detected, plate_text, confidence and may have error. The
    default names a reason only where a read was ``due``: a claim without a car view has none.
    """
    error = F.col("error") if "error" in plates.columns else F.lit(None).cast("string")
    found = plates.select(
        claim,
        F.struct("detected", "plate_text", "confidence", "source_view", error.alias("error")).alias("_plate"),
    )
    default = F.struct(
        F.lit(False).alias("detected"), F.lit("").alias("plate_text"), F.lit(0.0).alias("confidence"),
        F.lit(None).cast("string").alias("source_view"), F.when(due, F.lit(PLATE_UNAVAILABLE)).alias("error"),
    )
    return claims.join(found, claim, "left").withColumn("plate", F.coalesce("_plate", default)).drop("_plate")
