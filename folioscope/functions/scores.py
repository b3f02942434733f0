"""Score and box columns: probabilities, thresholds, IoU, box geometry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.binding import let
from folioscope.rules import CENTER_REACH, FRAME_SIZE, MINOR_MAX_AREA, MODERATE_MAX_AREA


def softmax(scores: Column) -> Column:
    exps = let(
        F.array_max(scores).cast("double"),
        lambda top: F.transform(scores, lambda s: F.exp(s.cast("double") - top)),
    )
    return let(exps, lambda es: let(
        F.aggregate(es, F.lit(0.0), lambda acc, e: acc + e), lambda total: F.transform(es, lambda e: e / total)
    ))


def sigmoid(x: Column) -> Column:
    clipped = F.greatest(F.least(x.cast("double"), F.lit(60.0)), F.lit(-60.0))
    return 1.0 / (1.0 + F.exp(-clipped))


def as_probability(x: Column) -> Column:
    return F.when(x.between(0.0, 1.0), x.cast("double")).otherwise(sigmoid(x))


def positive_probability(output: Column, positive_index: int = 1, high_is_positive: bool = True) -> Column:
    """Probability of the positive class of a raw model output of one or more values."""
    single = as_probability(F.get(output, F.lit(0)))
    if not high_is_positive:
        single = 1.0 - single
    total = F.aggregate(output, F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    proper = ~F.exists(output, lambda v: (v < 0.0) | (v > 1.0)) & (F.abs(total - 1.0) <= 1e-3 + 1e-5)
    index = F.least(F.lit(max(positive_index, 0)), F.size(output) - 1)
    vector = F.when(proper, F.get(output, index).cast("double")).otherwise(F.get(softmax(output), index))
    return F.when(F.size(output) == 1, single).otherwise(vector)


def threshold_label(p: Column, threshold: float, positive: str, negative: str) -> Column:
    chosen = p >= threshold
    return F.struct(
        F.when(chosen, positive).otherwise(negative).alias("label"),
        F.round(F.when(chosen, p).otherwise(1.0 - p), 4).alias("confidence"),
    )


def damage_prediction(prob_clean: Column, prob_damaged: Column, threshold: float) -> Column:
    """View prediction: label by threshold, confidence is the chosen label's probability."""
    damaged = prob_damaged >= threshold
    return F.struct(
        damaged.alias("damage_detected"),
        F.round(F.when(damaged, prob_damaged).otherwise(prob_clean), 4).alias("confidence_score"),
        F.round(prob_damaged, 4).alias("prob_damaged"),
        F.round(prob_clean, 4).alias("prob_clean"),
    )


def argmax_class(scores: Column, names: Sequence[str], floor: float | None = None) -> Column:
    """Best class and its score (first on ties); null below the floor."""
    wild = F.exists(scores, lambda s: (s < 0.0) | (s > 1.0))
    top = F.array_max(scores)
    best = F.when(wild, sigmoid(top)).otherwise(top.cast("double"))
    index = (F.array_position(scores, top) - 1).cast("int")
    labels = F.array(*[F.lit(n) for n in names])
    result = F.struct(
        index.alias("class_id"),
        F.coalesce(F.get(labels, index), index.cast("string")).alias("label"),
        best.alias("score"),
    )
    return result if floor is None else F.when(best >= floor, result)


def severity(w: Column, h: Column) -> Column:
    area = w * h
    return F.when(area < MINOR_MAX_AREA, "minor").when(area < MODERATE_MAX_AREA, "moderate").otherwise("severe")


def fallback_severity(p: Column) -> Column:
    return F.when(p >= 0.80, "severe").when(p >= 0.65, "moderate").otherwise("minor")


def region(cx: Column, cy: Column) -> Column:
    """Where on the car a box centre lies, relative to the middle of the frame."""
    rx, ry = (cx - 0.5) / 0.5, (cy - 0.5) / 0.5
    central = (F.abs(rx) < CENTER_REACH) & (F.abs(ry) < CENTER_REACH)
    side = F.when(rx <= 0, "left").otherwise("right")
    level = F.when(ry <= 0, "top").otherwise("bottom")
    return F.when(central, "center").otherwise(F.concat_ws("_", level, side))


def to_frame(v: Column, size: int = FRAME_SIZE) -> Column:
    return F.round(v / float(size), 4)


def to_xyxy(cx: Column, cy: Column, w: Column, h: Column) -> Column:
    return F.struct(
        (cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2")
    )


def unletterbox(box: Column, ratio: Column, pad_x: Column, pad_y: Column, width: Column, height: Column) -> Column:
    """Map a box from the padded square back to the original image, clipped to it."""

    def back(v: Column, pad: Column, limit: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least((v - pad) / ratio, limit.cast("double")))

    return F.struct(
        back(box["x1"], pad_x, width).alias("x1"),
        back(box["y1"], pad_y, height).alias("y1"),
        back(box["x2"], pad_x, width).alias("x2"),
        back(box["y2"], pad_y, height).alias("y2"),
    )


def crop_rect(box: Column, width: Column, height: Column, pad: int = 5) -> Column:
    return F.struct(
        F.greatest(F.lit(0.0), box["x1"] - pad).alias("x1"),
        F.greatest(F.lit(0.0), box["y1"] - pad).alias("y1"),
        F.least(width.cast("double"), box["x2"] + pad).alias("x2"),
        F.least(height.cast("double"), box["y2"] + pad).alias("y2"),
    )


def iou(a: Column, b: Column, floored: bool = False) -> Column:
    """Overlap of two centre-form boxes (structs with cx, cy, w, h).

    A union of zero or less gives 0; ``floored`` divides by at least 1e-9 instead
    and takes negative extents as empty.
    """

    def reach(axis: str, size: str) -> Column:
        hi = F.least(a[axis] + a[size] / 2, b[axis] + b[size] / 2)
        lo = F.greatest(a[axis] - a[size] / 2, b[axis] - b[size] / 2)
        return F.greatest(F.lit(0.0), hi - lo)

    def area(box: Column) -> Column:
        if floored:
            return F.greatest(F.lit(0.0), box["w"]) * F.greatest(F.lit(0.0), box["h"])
        return box["w"] * box["h"]

    both = area(a) + area(b)
    if floored:
        return let(reach("cx", "w") * reach("cy", "h"), lambda s: s / F.greatest(both - s, F.lit(1e-9)))
    return let(
        reach("cx", "w") * reach("cy", "h"), lambda s: F.when(both - s > 0, s / (both - s)).otherwise(F.lit(0.0))
    )
