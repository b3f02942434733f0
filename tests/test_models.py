"""Order-dependent operators against plain-Python models, including the paths for large groups."""

import json
import math
import random
import re
import time
from collections import Counter
from statistics import quantiles

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioscope.catalog.views import table
from folioscope.functions import jsontext as js
from folioscope.operators import detections as det
from folioscope.operators import quality as q
from folioscope.operators.chunks import chunk_lines, chunk_errors, rag_chunks
from folioscope.operators.lines import reading_order
from folioscope.operators.records import extract_vin
from folioscope.rules import VIN_ARTIFACTS
from folioscope.streaming import breaker as br
from folioscope.streaming import ingest

SF_DIR = "/root/testdata/sf0.001"


# --- chunks -------------------------------------------------------------------
def model_chunks(lines, max_chars, overlap):
    """Chunk k is a slice of the lines; each slice starts ``overlap`` lines before the last cut."""
    lines = [x for x in lines if x]
    spans, lo, used = [], 0, 0
    for i, line in enumerate(lines):
        if i > lo and used + len(line) + 1 > max_chars:
            spans.append((lo, i))
            lo = max(lo, i - overlap)
            used = sum(len(x) + 1 for x in lines[lo:i])
        used += len(line) + 1
    if lines:
        spans.append((lo, len(lines)))
    return [t for t in ("\n".join(lines[a:b]).strip() for a, b in spans) if t]


@pytest.mark.parametrize("max_chars,overlap", [(1200, 3), (60, 2), (25, 0), (1, 1), (40, 5)])
def test_chunks_match_model(spark, max_chars, overlap):
    rng = random.Random(max_chars)
    docs = [["".join(rng.choices("ab c", k=rng.randrange(0, 30))) for _ in range(rng.randrange(0, 60))] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, lines array<string>")
    got = dict(df.select("id", chunk_lines(F.col("lines"), max_chars, overlap)).collect())
    for i, lines in enumerate(docs):
        assert got[i] == model_chunks(lines, max_chars, overlap)
        for line in lines:
            assert not line.strip() or any(line.strip() in c for c in got[i])


def test_rag_chunks_shapes(spark):
    raws = [
        ("pages.json", json.dumps({"pages": [{"page": None, "lines": ["a", {"text": " b  c "}, 3, None]}, "odd", {"lines": []}, {"lines": [{"t": 1}, True]}]})),
        ("flat.json", json.dumps({"lines": [{"text": "x", "confidence": 1.0}], "n": None, "e": [], "d": {}, "b": False})),
        ("scalar.json", '" hello  there "'),
        ("bad.json", "{oops"),
        ("none.json", json.dumps({"pages": [{"lines": None}]})),
        ("part.json", json.dumps({"pages": [{"lines": ["ok"]}, {"lines": None}, {"lines": ["also"]}]})),
    ]
    df = spark.createDataFrame(raws, "source_file string, raw string")
    rows = {(r.source_file, r.chunk_id): r for r in rag_chunks(df).collect()}
    assert rows[("pages.json", "page-None-chunk-1")].text == "a\nb c\n3"
    assert rows[("pages.json", "page-4-chunk-1")].text == "True"
    assert rows[("flat.json", "chunk-1")].text == "lines[1].text: x\nlines[1].confidence: 1.0\nn: \ne: []\nb: False"
    assert rows[("scalar.json", "chunk-1")].text == "hello there"
    assert rows[("part.json", "page-1-chunk-1")].text == "ok" and rows[("part.json", "page-3-chunk-1")].text == "also"
    assert len(rows) == 6
    assert {(r.source_file, r.position) for r in chunk_errors(df).collect()} == {("bad.json", None), ("none.json", 1), ("part.json", 2)}


# --- reading order ------------------------------------------------------------
@pytest.mark.parametrize("rtl", [False, True])
def test_reading_order_of_ruled_pages(spark, rtl):
    """Boxes laid out on known rows and columns come back row by row, whatever order they arrive in."""
    rng, pages = random.Random(2), []
    for n_rows in (1, 3, 12):
        boxes = [Row(x0=float(40 * c), y0=float(30 * r + rng.randrange(5)), x1=float(40 * c + 30), y1=float(30 * r + 14), line_index=10 * r + c)
                 for r in range(n_rows) for c in range(4)]
        rng.shuffle(boxes)
        pages.append((n_rows, boxes))
    df = spark.createDataFrame(pages, "n int, boxes array<struct<x0:double,y0:double,x1:double,y1:double,line_index:int>>")
    for row in df.select("n", reading_order(F.col("boxes"), rtl)["line_index"].alias("got")).collect():
        assert row.got == [10 * r + c for r in range(row.n) for c in (range(3, -1, -1) if rtl else range(4))]


def model_order(boxes, rtl):
    """All rows stay open: a box joins the first one in reach of its centre."""
    heights = sorted(max(1.0, b["y1"] - b["y0"]) for b in boxes)
    reach = max(8.0, 0.6 * heights[len(heights) // 2]) if boxes else 0
    rows = []
    for b in sorted(boxes, key=lambda b: (b["y0"] + b["y1"]) / 2):
        centre = (b["y0"] + b["y1"]) / 2
        row = next((r for r in rows if abs(centre - r[0]) <= reach), None)
        if row is None:
            rows.append([centre, [b]])
        else:
            row[0] = (row[0] * len(row[1]) + centre) / (len(row[1]) + 1)
            row[1].append(b)
    rows.sort(key=lambda r: r[0])
    return [b["line_index"] for r in rows for b in sorted(r[1], key=lambda b: -b["x1"] if rtl else b["x0"])]


BOXES = "n int, boxes array<struct<x0:double,y0:double,x1:double,y1:double,line_index:int>>"


@pytest.mark.parametrize("rtl", [False, True])
def test_reading_order_of_uneven_pages(spark, rtl):
    rng, pages = random.Random(4), [(0, []), (1, [Row(x0=1.0, y0=2.0, x1=3.0, y1=4.0, line_index=0)] * 2)]
    for n in range(2, 60):
        tall = rng.choice([1, 12, 40])
        pages.append((n, [Row(x0=float(x), y0=y, x1=float(x + rng.randrange(30)), y1=y + rng.uniform(-1, tall), line_index=i)
                          for i, (x, y) in enumerate((rng.randrange(6), rng.uniform(0, 3 * n)) for _ in range(n))]))
    df = spark.createDataFrame(pages, BOXES)
    for row in df.select("n", reading_order(F.col("boxes"), rtl)["line_index"].alias("got")).collect():
        assert row.got == model_order(pages[row.n][1], rtl)


def test_reading_order_of_nulls_and_long_pages(spark):
    null = [Row(x0=None, y0=None, x1=1.0, y1=5.0, line_index=1), Row(x0=0.0, y0=0.0, x1=1.0, y1=9.0, line_index=2), None]
    df = spark.createDataFrame([(1, null), (2, None)], BOXES)
    got = {r.n: r.got for r in df.select("n", reading_order(F.col("boxes"))["line_index"].alias("got")).collect()}
    assert got == {1: [1, None, 2], 2: None}
    page = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(59_999)), lambda i: F.struct(
        (i % 3).cast("double").alias("x0"), (F.lit(20_000) - F.floor(i / 3)).cast("double").alias("top"), i.alias("i"))).alias("b"))
    page = page.select(F.transform("b", lambda b: F.struct(
        b["x0"], (b["top"] * 20).alias("y0"), (b["x0"] + 1).alias("x1"), (b["top"] * 20 + 10).alias("y1"), b["i"].alias("line_index"))).alias("boxes"))
    began = time.time()
    order = page.select(reading_order(F.col("boxes"))["line_index"].alias("o")).first().o
    assert order == [3 * r + c for r in range(19_999, -1, -1) for c in range(3)]
    assert time.time() - began < 60


# --- uploads ------------------------------------------------------------------
def test_ingest_gives_repeated_names_their_own_outcome(spark, tmp_path):
    good, bad_page = '{"pages": [{"page": 1, "lines": ["a b"]}]}', '{"pages": [{"page": 1, "lines": ["c"]}, {"lines": 7}]}'
    rows = [("x.json", "file", 1, good), ("x.json", "file", 1, "{oops"), ("x.json", "file", 1, bad_page), ("x.json", "movie", 1, good),
            (None, "file", 1, good), ("y.json", "file", 1, None)]
    batch = spark.createDataFrame(rows, "filename string, process_type string, size_bytes long, raw string")
    out, aside, manifest = (str(tmp_path / n) for n in ("out", "aside", "manifest"))
    ingest.ingest_batch(batch, 0, out, aside, manifest)
    chunks = ingest.committed(spark, out, manifest, "source_file string, upload_key string, text string").collect()
    held = ingest.committed(spark, aside, manifest, "filename string, process_type string, upload_key string, error_code string, error_detail string").collect()
    assert sorted((r.source_file, r.text) for r in chunks) == [("x.json", "a b"), ("x.json", "c")]
    assert len({r.upload_key for r in chunks}) == 2
    clean = next(r.upload_key for r in chunks if r.text == "a b")
    assert clean not in {r.upload_key for r in held}
    assert sorted((r.filename or "", r.process_type, r.error_detail is None) for r in held) == [
        ("", "file", True), ("x.json", "file", False), ("x.json", "file", False), ("x.json", "movie", True), ("y.json", "file", False)]
    assert {r.error_code for r in held} == {"VALIDATION_ERROR"}


def test_batch_that_ends_between_its_sinks_is_not_seen(spark, tmp_path):
    batch = spark.createDataFrame([("x.json", "file", 1, '{"pages": [{"page": 1, "lines": ["a"]}]}')], "filename string, process_type string, size_bytes long, raw string")
    out, aside, manifest = (str(tmp_path / n) for n in ("out", "aside", "manifest"))
    ingest.ingest_batch(batch, 0, out, aside, manifest)
    blocked = tmp_path / "file"
    blocked.write_text("")
    with pytest.raises(Exception):
        ingest.ingest_batch(batch, 1, out, str(blocked), manifest)
    assert spark.read.parquet(out).count() == 2
    assert ingest.committed(spark, out, manifest, "source_file string").count() == 1
    ingest.ingest_batch(batch, 1, out, aside, manifest)
    ingest.ingest_batch(batch, 1, out, aside, manifest)
    assert [ingest.committed(spark, f, manifest, "upload_key string").count() for f in (out, aside)] == [2, 0]


# --- suppression --------------------------------------------------------------
def model_iou(a, b):
    def reach(c, s):
        return max(0.0, min(a[c] + a[s] / 2, b[c] + b[s] / 2) - max(a[c] - a[s] / 2, b[c] - b[s] / 2))

    shared = reach("cx", "w") * reach("cy", "h")
    union = a["w"] * a["h"] + b["w"] * b["h"] - shared
    return shared / union if union > 0 else 0.0


def model_nms(boxes, hides):
    kept = []
    for b in sorted(boxes, key=lambda b: (-b["score"], b["det_id"])):
        if not any(hides(model_iou(k, b)) for k in kept):
            kept.append(b)
    return kept


@pytest.fixture(scope="module")
def skewed_boxes(spark):
    rng = random.Random(5)
    rows = []
    for image in (0,) * 120 + tuple(range(1, 25)) * 3:
        rows.append((image, f"d{len(rows):04d}", rng.randrange(1, 20) / 20, rng.uniform(0, 200), rng.uniform(0, 200),
                     rng.choice([0.0, 20.0, 60.0, 80.0]), rng.choice([20.0, 60.0, 80.0])))
    df = spark.createDataFrame(rows, "image_id int, det_id string, score double, cx double, cy double, w double, h double")
    return df, [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("strict,cap", [(True, None), (False, 5)])
def test_nms_matches_model(spark, skewed_boxes, strict, cap):
    df, rows = skewed_boxes
    got = {(r.image_id, r.det_id) for r in det.nms(df, threshold=0.3, strict=strict, cap=cap).collect()}
    want = set()
    for image in {r["image_id"] for r in rows}:
        kept = model_nms([r for r in rows if r["image_id"] == image], (lambda v: v >= 0.3) if strict else (lambda v: v > 0.3))
        want |= {(image, k["det_id"]) for k in kept[:cap]}
    assert got == want


def test_suppression_pairs_match_model(spark, skewed_boxes):
    df, rows = skewed_boxes
    got = {(r.image_id, r.det_id): r.kept_id for r in det.suppression_pairs(df, threshold=0.3).collect()}
    want = {}
    for image in {r["image_id"] for r in rows}:
        boxes = [r for r in rows if r["image_id"] == image]
        kept = model_nms(boxes, lambda v: v >= 0.3)
        for b in boxes:
            hider = next((k for k in kept if k is not b and model_iou(k, b) >= 0.3), None)
            if hider:
                want[(image, b["det_id"])] = hider["det_id"]
    assert got == want


def model_pairs(rows, threshold):
    """Every two boxes of an image that overlap by the threshold; of equal ranks either may come first, the names are the same."""
    ordered = sorted(rows, key=lambda r: (-r["score"] if r["score"] is not None else math.inf, r["det_id"]))
    return Counter((b["image_id"], b["det_id"], k["det_id"], round(model_iou(k, b), 9)) for i, k in enumerate(ordered)
                   for b in ordered[i + 1:] if k["image_id"] == b["image_id"] and model_iou(k, b) >= threshold)


@pytest.mark.parametrize("per_image,per_block", [(64, 1024), (2, 1024), (2, 3), (10_000, 3)])
def test_overlap_pairs_match_model(spark, skewed_boxes, monkeypatch, per_image, per_block):
    """Whatever the sizes of lists and blocks: every pair, also of two suppressed boxes and of repeated rows."""
    monkeypatch.setattr(det, "PER_IMAGE", per_image)
    monkeypatch.setattr(det, "PER_BLOCK", per_block)
    df, rows = skewed_boxes
    df, rows = df.unionByName(df.where("det_id < 'd0040'")), rows + [r for r in rows if r["det_id"] < "d0040"]
    for threshold in (0.3, 1.0):
        got = Counter((r.image_id, r.det_id, r.better_id, round(r.iou, 9)) for r in det.overlap_pairs(df, threshold=threshold).collect())
        assert got == model_pairs(rows, threshold) and got
    hidden = {(r.image_id, r.det_id, r.kept_id) for r in det.suppression_pairs(df, threshold=0.3).collect()}
    every = {(r.image_id, r.det_id, r.better_id) for r in det.overlap_pairs(df, threshold=0.3).collect()}
    assert hidden < every


def test_overlap_pairs_of_odd_boxes(spark):
    nan = float("nan")
    rows = [(1, "a", 0.9, 10.0, 10.0, 8.0, 8.0)] * 100 + [(None, "n", 0.5, 10.0, 10.0, 8.0, 8.0), (None, "m", 0.6, 10.0, 10.0, 8.0, 8.0)]
    rows += [(1, "nul", 0.9, None, 10.0, 8.0, 8.0), (1, "nan", 0.9, nan, 10.0, 8.0, 8.0), (1, "flat", 0.9, 10.0, 10.0, 0.0, 8.0), (1, "back", 0.9, 10.0, 10.0, -8.0, 8.0)] * 2
    rows += [(1, "unscored", None, 10.5, 10.0, 8.0, 8.0), (2, None, None, 1.0, 1.0, 8.0, 8.0), (2, None, None, 1.0, 1.0, 8.0, 8.0), (3, "far", 0.1, 1.0, 1.0, 8.0, 8.0)]
    got = Counter((r.image_id, r.det_id, r.better_id) for r in det.overlap_pairs(boxes(spark, rows)).collect())
    assert got == {(None, "n", "m"): 1, (1, "a", "a"): 4950, (1, "unscored", "a"): 100, (2, None, None): 1}
    assert det.overlap_pairs(boxes(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        det.overlap_pairs(boxes(spark, rows), threshold=0.0)


BOX = "image_id int, det_id string, score double, cx double, cy double, w double, h double, rank int, b int, cell int, note string"


def boxes(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "n") for r in rows], BOX)


def test_suppression_of_odd_boxes(spark):
    nan = float("nan")
    rows = [(1, "a", 0.9, 10.0, 10.0, 8.0, 8.0)] * 200 + [(None, "n", 0.5, 10.0, 10.0, 8.0, 8.0), (None, "m", 0.6, 10.0, 10.0, 8.0, 8.0)]
    rows += [(1, "nul", 0.9, None, 10.0, 8.0, 8.0), (1, "nan", 0.9, nan, 10.0, 8.0, 8.0), (1, "flat", 0.9, 10.0, 10.0, 0.0, 8.0)] * 2
    rows += [(1, "unscored", None, 10.5, 10.0, 8.0, 8.0), (2, None, None, 1.0, 1.0, 8.0, 8.0), (2, None, None, 1.0, 1.0, 8.0, 8.0)]
    df = boxes(spark, rows)
    got = det.nms(df)
    assert got.columns == df.columns
    assert sorted((r.image_id or 0, r.det_id or "-") for r in got.collect()) == [
        (0, "m"), (1, "a"), (1, "flat"), (1, "flat"), (1, "nan"), (1, "nan"), (1, "nul"), (1, "nul"), (2, "-")]
    pairs = sorted((r.image_id or 0, r.det_id or "-", r.kept_id or "-") for r in det.suppression_pairs(df).collect())
    assert pairs == [(0, "n", "m")] + [(1, "a", "a")] * 199 + [(1, "unscored", "a"), (2, "-", "-")]
    assert det.nms(df.limit(0)).count() == 0 and det.suppression_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        det.nms(df, threshold=0.0)


def test_crowds_end_in_few_rounds(spark, monkeypatch):
    rounds = []
    once = det._round
    monkeypatch.setattr(det, "_round", lambda *a: rounds.append(1) or once(*a))
    rows = [(1, f"s{i:05d}", 0.5 + i % 7 / 100, 10.0 * (i % 100), 10.0 * (i // 100), 9.0, 9.0) for i in range(10_000)]
    wide = [(1, "wide", 0.52, 500.0, 500.0, 1000.0, 1000.0), (1, "wide2", 0.51, 500.0, 501.0, 1000.0, 998.0)]
    rng = random.Random(9)
    crowd = [(2, f"c{i:04d}", rng.random(), rng.gauss(0, 30), rng.gauss(0, 30), 2.0 ** rng.uniform(2, 8), 2.0 ** rng.uniform(2, 8)) for i in range(1500)]
    got = {(r.image_id, r.det_id) for r in det.nms(boxes(spark, rows + wide + crowd)).collect()}
    assert len(rounds) < 10, len(rounds)
    names = ("image_id", "det_id", "score", "cx", "cy", "w", "h")
    kept = model_nms([dict(zip(names, r)) for r in crowd], lambda v: v >= 0.45)
    assert got == {(1, r[1]) for r in rows} | {(1, "wide")} | {(2, k["det_id"]) for k in kept}


def test_neighbours_hold_every_overlap(spark):
    rng = random.Random(10)
    rows = []
    for _ in range(4000):
        a = [rng.uniform(-300, 300), rng.uniform(-300, 300), 2.0 ** rng.choice([0, 2, 4, rng.uniform(-4, 9)]), 2.0 ** rng.choice([2, 3.5, rng.uniform(-4, 9)])]
        b = [a[0] + rng.uniform(-1, 1) * a[2], a[1] + rng.uniform(-1, 1) * a[3], a[2] * rng.uniform(0.3, 3), a[3] * rng.uniform(0.3, 3)]
        rows.append((*a, *b))
    names = ("cx", "cy", "w", "h")
    df = spark.createDataFrame(rows, ", ".join(f"{p}{n} double" for p in "ab" for n in names))
    a, b = (F.struct(*[F.col(f"{p}{n}").alias(n) for n in names]) for p in "ab")
    missed = df.where(det.iou(a, b) >= 0.2).where(~F.array_contains(det._neighbours(a, 0.2), det._home(b)))
    assert df.where(det.iou(a, b) >= 0.2).count() > 300 and missed.count() == 0


# --- percentiles --------------------------------------------------------------
def test_percentiles_of_skewed_groups(spark):
    rng = random.Random(3)
    rows = [("hot", rng.lognormvariate(3, 2)) for _ in range(500)] + [("flat", 7.0)] * 40 + [("one", -3.5)] + [("mixed", v) for v in (-5.0, 0.0, 1e-9, 2.0)]
    rows += [(None, 1.0), (None, 2.0), ("empty", None)]
    got = {r.g: r for r in q.latency_summary(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    hot = sorted(v for g, v in rows if g == "hot")
    cuts = quantiles(hot, n=100, method="inclusive")
    for name, at in (("p50", 50), ("p90", 90), ("p95", 95), ("p99", 99)):
        assert got["hot"][name] == pytest.approx(cuts[at - 1], abs=0.006)
    assert (got["flat"].min, got["flat"].p50, got["flat"].p99) == (7.0, 7.0, 7.0)
    assert got["one"].p95 == -3.5 and got["mixed"].p50 == 0.0 and got[None].p50 == 1.5
    assert got["empty"].n == 0 and got["empty"].p50 is None and got["empty"]["min"] is None


def test_percentiles_in_a_narrow_band(spark, monkeypatch):
    """Nine tenths of all rows in one group and between two close values, the rest far off; repeats, null keys, huge values."""
    monkeypatch.setattr(q, "RANKED", 8)
    monkeypatch.setattr(q, "PARTS", 4)
    rng = random.Random(4)
    rows = [("hot", "x", 100.0 + rng.random() ** 9 / 1000) for _ in range(9000)]
    rows += [("hot", "x", v) for v in (1e-300, -1e300, 1e300)] + [("hot", None, rng.choice([5.0, 6.0])) for _ in range(500)]
    rows += [(None, None, float(i)) for i in range(400)] + [("near", "y", 1.0 + i * 2.0**-52) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, h string, v double")
    counted = q._by_value(df, ["g", "h"], "v")
    got = {(r._key.g, r._key.h): r for r in q.exact_percentiles(counted, q.PERCENTILES).collect()}
    assert len(got) == 4
    for key, r in got.items():
        values = sorted(v for g, h, v in rows if (g, h) == key)
        for name, p in q.PERCENTILES.items():
            at = (len(values) - 1) * p
            low = int(at)
            want = values[low] * (1 - (at - low)) + values[min(low + 1, len(values) - 1)] * (at - low)
            assert r[name] == pytest.approx(want, rel=1e-15), (key, name)
    none = q.latency_summary(df.limit(0), ["g"], "v")
    assert none.columns == ["g", "n", "min", "mean", "p50", "p90", "p95", "p99", "max"] and none.count() == 0


def test_warmup_drops_short_groups(spark):
    rows = [("a", i) for i in range(5)] + [("b", 1), ("b", 2), (None, 1), (None, 2), (None, 3)]
    left = q.drop_warmup(spark.createDataFrame(rows, "g string, i int"), ["g"], ["i"], 2).collect()
    assert sorted((r.g or "-", r.i) for r in left) == [("-", 3), ("a", 2), ("a", 3), ("a", 4)]


# --- circuit breaker ----------------------------------------------------------
def model_breaker(calls, failures, recovery_us):
    state, bad, opened, out = "closed", 0, 0, []
    for us, call_id, ok, ignored in sorted(calls):
        if state == "open" and us - opened >= recovery_us:
            state = "half_open"
        ran = state != "open"
        if ran and ok:
            state, bad = "closed", 0
        elif ran and not ignored:
            bad += 1
            if state == "half_open" or bad >= failures:
                state, opened = "open", us
        out.append((call_id, ran, state))
    return out


@pytest.mark.parametrize("block_seconds", [5, 60, 100_000])
@pytest.mark.parametrize("failures,recovery", [(3, 4.0), (1, 30.0), (5, 0.5)])
def test_breaker_blocks_match_sequential_run(spark, block_seconds, failures, recovery):
    rng = random.Random(failures)
    base, rows, us = 1_700_000_000_000_000, [], 0
    for n in range(400):
        us += rng.choice([0, 200_000, 700_000, 3_000_000])
        ok = rng.random() > 0.6
        rows.append(("hot" if n % 4 else f"c{n % 3}", base + us, n, ok, not ok and rng.random() > 0.8))
    df = spark.createDataFrame(rows, "circuit string, us long, call_id long, ok boolean, ignored boolean").withColumn("ts", F.timestamp_micros("us"))
    got = {(r.circuit, r.call_id): (r.admitted, r.state) for r in br.breaker_states(df, failures, recovery, block_seconds=block_seconds).collect()}
    for circuit in {r[0] for r in rows}:
        calls = [r[1:] for r in rows if r[0] == circuit]
        for call_id, ran, state in model_breaker(calls, failures, int(recovery * 1e6)):
            assert got[(circuit, call_id)] == (ran, state)


def test_breaker_stream_keeps_slots_not_circuits(spark, tmp_path):
    """Calls in three batches, late by less than the watermark; circuits share slots, state goes on from batch to batch."""
    from folioscope.catalog.streams import ROCKSDB

    rng, base, minute = random.Random(7), 1_700_000_000_000_000, 60_000_000
    rows, schema = [], "circuit string, us long, call_id long, ok boolean, ignored boolean"
    for batch in range(3):
        some = []
        for n in range(1200):
            ok = rng.random() > 0.5
            circuit = None if n % 150 == 0 else f"c{rng.randrange(300)}"
            some.append((circuit, base + (60 * batch - 4) * minute + rng.randrange(64 * minute), 2**60 + 1200 * batch + n, ok, not ok and rng.random() > 0.8))
        some.append(("last", base + 60 * (batch + 1) * minute, 2**61 + batch, True, False))
        spark.createDataFrame(some, schema).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are taken in the order of their times
        rows += some
    calls = spark.readStream.schema(schema + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    try:
        states = br.breaker_stream(calls, 2, 300.0, watermark="5 minutes", slots=16)
        query = states.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    timers = [op.customMetrics["numRegisteredTimers"] for p in query.recentProgress for op in p.stateOperators]
    assert len(timers) >= 4 and 0 < max(timers) <= 32  # one for each slot, with those of a slot that wakes twice in a batch
    out = spark.read.schema(br.STATES).parquet(f"{tmp_path}/out").select("circuit", "call_id", F.unix_micros("ts").alias("us"), "admitted", "state").collect()
    got = {(r.circuit, r.call_id): (r.us, r.admitted, r.state) for r in out}
    end, want = max(r[1] for r in rows) - 5 * minute, {}
    for circuit in {r[0] for r in rows}:
        calls = [r[1:] for r in rows if r[0] == circuit]
        times = {c[1]: c[0] for c in calls}
        want |= {(circuit, c): (times[c], ran, state) for c, ran, state in model_breaker(calls, 2, 300 * 1_000_000) if times[c] // 1000 + 1 <= end // 1000}
    assert got == want and len(out) == len(want)


# --- chassis numbers ----------------------------------------------------------
def model_vin(text):
    """Word-by-word reading: runs of two or more letters and digits, joined over gaps of space and dash."""
    found, run, gap = [], "", True
    words, word = [], ""
    for ch in text + "\0":
        if ch.isascii() and ch.isalnum():
            word += ch
            continue
        if word:
            words.append(("word", word))
            word = ""
        words.append(("gap" if ch == "-" or ch.isspace() else "stop", ch))
    for kind, value in words:
        if kind == "word" and len(value) >= 2:
            run += value
        elif kind != "gap":
            found.append(run)
            run = ""
    found.append(run)
    for kind, value in words:
        while kind == "word" and len(value) >= 11:
            found.append(value[:20])
            value = value[20:]
    good = []
    for c in (f.upper() for f in found):
        if 11 <= len(c) <= 20 and not c.startswith(VIN_ARTIFACTS) and not c.endswith(VIN_ARTIFACTS) and c not in good:
            good.append(c)
    exact = [c for c in good if len(c) == 17 and any(x.isdigit() for x in c) and any(x.isalpha() for x in c)]
    pool = exact[:1] or [c for c in good if c[0].isalpha()] or good
    return max(pool, key=len) if pool else None


def test_vin_matches_model_on_documents(spark):
    rows = table(spark, SF_DIR, "documents").select("text", extract_vin(F.col("text")).alias("vin")).collect()
    assert any(r.vin for r in rows)
    for r in rows:
        assert r.vin == model_vin(r.text)


def test_vin_literals(spark):
    cases = {
        "JTDBR32E 520012345": "JTDBR32E520012345", "ROYAL OMAN POLICE 12": None, "jtdbr32e-520012345 x": "JTDBR32E520012345",
        "ABCDEFGHIJK 123": "ABCDEFGHIJK123", "12345678901": "12345678901", "short": None, "A B C D E F G H I J K": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.vin for r in df.select("t", extract_vin(F.col("t")).alias("vin")).collect()} == cases


# --- JSON ---------------------------------------------------------------------
KEYS = st.text("kz", min_size=1, max_size=3)
TREES = st.recursive(
    st.integers(-9, 9) | st.text("ab", min_size=1, max_size=5),
    lambda kids: st.lists(kids, min_size=1, max_size=3) | st.dictionaries(KEYS, kids, min_size=1, max_size=3), max_leaves=12,
)


def rebuilt(lines):
    """The tree that path lines describe, with every leaf as text."""
    root = {}
    for line in lines:
        path, _, value = line.partition(": ")
        steps = [int(n) if n else k for k, n in re.findall(r"([^.\[\]]+)(?![^\[]*\])|\[(\d+)\]", path)]
        node = root
        for step in steps[:-1]:
            node = node.setdefault(step, {})
        node[steps[-1]] = value
    return root


def shaped(node):
    if isinstance(node, dict):
        return {k: shaped(v) for k, v in node.items()}
    if isinstance(node, list):
        return {n: shaped(v) for n, v in enumerate(node, 1)}
    return str(node)


@settings(max_examples=200, deadline=None)
@given(TREES.filter(lambda t: isinstance(t, (dict, list))))
def test_tree_lines_rebuild_the_tree(tree):
    assert rebuilt(js._tree_lines(tree)) == shaped(tree)
