"""Literal cases: boundaries the given tables do not contain."""

import csv
import random
import struct
import sys
import unicodedata
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioscope.functions import scores as sc
from folioscope.functions import text as tx
from folioscope.functions.jsontext import json_profile
from folioscope.operators import claims, lines, records, routing, telemetry, translate
from folioscope.operators.chunks import chunk_pages
from folioscope.plans.jobs import file_job
from folioscope.sources import files as src
from folioscope.sources.sinks import write_chunks, write_samples


def apply(spark, fn, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    rows = {r.i: r.out for r in df.select("i", fn(F.col("v")).alias("out")).collect()}
    return [rows[i] for i in range(len(values))]


def test_whitespace_and_normalisation(spark):
    assert apply(spark, tx.collapse_ws, [" a  b\n", None, "", "\x1ca\x1f"]) == ["a b", "", "", "a"]
    assert apply(spark, tx.normalize_text, ["ﬁx", "abـc", "‏a‫ b", " ascii  only "]) == ["fix", "abc", "a b", "ascii only"]
    assert apply(spark, tx.field_key_text, ["رقم / 12_a-B.", None]) == ["رقم12_ab", ""]


def test_digits_and_numbers(spark):
    assert apply(spark, tx.ascii_digits, ["٠١٩ ۰۹ 7"]) == ["019 09 7"]
    assert apply(spark, tx.numeric_tokens, ["12345678 00120034 2019/01/02 x7y ٤٢", ""]) == [["1234", "5678", "120034", "7", "42"], []]
    assert apply(spark, lambda c: tx.coerce_int(c, 5, 50), ["a 7 b", "x7", "99", "12345ب", None]) == [7, None, None, None, None]
    assert apply(spark, lambda c: tx.coerce_int(c, kind="double"), [3.9, -2.5], "double") == [3, -2]
    assert apply(spark, tx.coerce_year, ["15", "1999", "1800", "no", "2101"]) == [2015, 1999, None, None, None]


def test_dates(spark):
    got = apply(spark, lambda c: tx.issue_expiry(tx.date_strings(c)), ["20/5/1 then 2019/12/31 and 20/5/1", "only 2020/1/1", "none", "2020/13/45 19/1/1"])
    assert [(r.issue_date, r.expiry_date) for r in got] == [("2019/12/31", "20/5/1"), (None, "2020/1/1"), (None, None), ("19/1/1", "2020/13/45")]
    assert [str(x) for x in apply(spark, tx.as_date, ["20/5/1", "2020/13/45"])] == ["2020-05-01", "None"]


def test_arabic_runs(spark):
    assert apply(spark, tx.fix_reversed_runs, ["abc دمحم 12", "", "مقر"]) == ["abc محمد 12", "", "رقم"]
    assert apply(spark, tx.has_arabic, ["abc", "aﺎ", "ࢡ"]) == [False, True, True]


def test_text_preview(spark):
    rows = apply(spark, tx.text_preview, [b"a\r\nb\rc\n", b"\xff\x41", b"", "x y".encode()], "binary")
    assert [(r.text_preview, r.encoding_used, r.line_count_preview) for r in rows] == [
        ("a\nb\nc\n", "utf-8", 3), ("�A", "utf-8-replace", 1), ("", "utf-8", 0), ("x y", "utf-8", 2)]


def test_urls_and_ids(spark):
    urls = ["http://localhost:8000/", "https://u:p@LOCALHOST/a//", "http://localhost.example/x", "http://other/", "http://localhost?q=1"]
    assert apply(spark, tx.normalize_base_url, urls) == [
        "http://127.0.0.1:8000", "https://u:p@127.0.0.1/a", "http://localhost.example/x", "http://other", "http://127.0.0.1?q=1"]
    kept, short, long = apply(spark, telemetry.ensure_request_id, ["abc", "", "x" * 129])
    assert kept == "abc" and len(short) == 32 and len(long) == 32


def test_scores(spark):
    assert apply(spark, sc.as_probability, [0.3, 100.0, -100.0], "double") == pytest.approx([0.3, 1.0, 0.0])
    assert apply(spark, sc.positive_probability, [[0.2, 0.8], [1.0, 3.0], [0.9]], "array<double>") == pytest.approx([0.8, 0.880797, 0.9])
    regions = spark.createDataFrame([(0.5, 0.5), (0.65, 0.5), (0.5, 0.35), (0.2, 0.9), (0.36, 0.64)], "x double, y double")
    assert [r[0] for r in regions.select(sc.region(F.col("x"), F.col("y"))).collect()] == ["center", "top_right", "top_left", "bottom_left", "center"]
    boxes = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], "cx double, cy double, w double, h double").select(F.struct("*").alias("b"))
    assert boxes.select(sc.iou(F.col("b"), F.col("b")), sc.iou(F.col("b"), F.col("b"), floored=True)).first()[:] == (0.0, 0.0)


def test_json_profile(spark):
    rows = apply(spark, json_profile, ['{"b":1,"a":2}', "[1,2,3]", "1.5", "7", "null", "{} x", ""])
    assert [r.top_level_type for r in rows] == ["dict", "list", "float", "int", "NoneType", None, None]
    assert rows[0].top_level_keys == ["b", "a"] and rows[1].item_count == 3 and rows[5].json_error


def test_category_order(spark):
    names = ["a.PDF", "b.jpg", "c.xml", "d.json", "e.csv", "f.docx", "g", "h.log", ".hidden"]
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    typed = routing.categorize(df.withColumn("extension", routing.suffix_of(F.col("filename"))).withColumn("mime_type", routing.media_type(F.col("filename"))))
    assert [r.category for r in typed.collect()] == ["pdf", "image", "text", "json", "text", "archive", "binary", "text", "binary"]


CARD = ["شرطة عمان", "رقم اللوحة", "12345 ب", "نوع المركبة", "خصوصي", "اللون", "ابيض", "بلد الولايات المتحدة", "سنة الصنع", "15", "سعة المحرك", "1798",
        "الوزن فارغ", "1320", "الحمولة القصوى", "475", "عدد الركاب", "5", "القاعدة", "JTDBR32E520012345", "x", "2019/03/04", "20/03/04", "nil"]


def test_card_record(spark):
    df = spark.createDataFrame([(1, CARD), (2, []), (3, ["رقم اللوحة", "بم", "1999", "4321 kg"]), (4, ["الوزن", "اللون", "55 x"])], "doc_id int, lines array<string>")
    got = {r.doc_id: r.record for r in records.extract_record(df).collect()}
    one = got[1]
    assert (one.plate_number, one.plate_text, one.year, one.model_year, one.vin_or_chassis) == ("12345ب", None, 2015, None, "JTDBR32E520012345")
    assert (one.engine_cc, one.empty_weight_kg, one.max_load_kg, one.seats, one.engine_number) == (1798, 1320, 475, 5, "NIL")
    assert (one.issue_date, one.expiry_date, one.country_of_origin, one.color) == ("2019/03/04", "20/03/04", "الولايات المتحدة الامريكية", "ابيض")
    assert all(v is None for k, v in got[2].asDict().items() if k != "notes")
    assert (got[3].plate_number, got[3].plate_text, got[3].year, got[3].engine_cc) == ("1999", None, None, 4321)
    assert got[4].empty_weight_kg is None and got[4].seats == 55


def test_record_notes_and_fallback(spark):
    docs = spark.createDataFrame([
        (1, CARD, ["99"], "ar"), (2, ["اللون"], ["CHASSIS", "ZZ1AAAAAAAAAAAA99", "2001/01/02", "2003/01/02"], "ar"), (3, ["اللون"], ["2001/01/02"], "en"), (4, ["اللون"], None, "ar"),
    ], "doc_id int, lines array<string>, aux_lines array<string>, lang string")
    got = {r.doc_id: r for r in records.with_fallback(docs).collect()}
    assert [got[i].auxiliary_ocr_lang for i in (1, 2, 3, 4)] == [None, "en", None, None]
    assert got[2].record.vin_or_chassis == "ZZ1AAAAAAAAAAAA99" and got[2].record.notes.endswith("fallback.")
    notes = records.extract_record(docs).select("doc_id", records.validation_notes(F.col("record")).alias("n"))
    assert {r.doc_id: r.n for r in notes.collect()}[1] == ["weights: empty_weight_kg (1320) > max_load_kg (475)"]


def test_translation_order(spark):
    out = apply(spark, translate.translate, ["سلطنة عمان", " شرطة  عمان السلطانية", None, " ", "plain", "رقم اللوحة 5"])
    assert out == ["Sultanate of Oman", "Oman Police السلطانية", None, "", "plain", "Number Plate 5"]
    assert apply(spark, lambda c: translate.translate(c, {"a": "b", "b": "c"}), ["xa", "a"]) == ["xc", "b"]


def test_claim_rollup_edges(spark):
    views = spark.createDataFrame([
        (1, "front", True, 0.9, True, 0.7, 0.7, 0.3, None), (1, "back", True, 0.9, False, 0.95, 0.05, 0.95, None), (1, "left", False, 0.8, False, None, None, None, None),
        (2, "front", False, 0.8, False, None, None, None, None), (3, "right", True, 0.9, True, 0.9, 0.9, 0.1, "boom"),
    ], "claim_id int, view string, is_car boolean, car_confidence double, damage_detected boolean, confidence_score double, prob_damaged double, prob_clean double, view_error string")
    spine = spark.createDataFrame([(1,), (2,), (3,), (4,)], "claim_id int")
    got = {r.claim_id: r for r in claims.claim_rollup(views, spine).collect()}
    assert (got[1].damage_detected, got[1].overall_confidence, got[1].total_views_analyzed) == (True, 0.7, 2)
    assert set(got[1].per_view) == {"front", "back"} and got[1].skipped_views["left"].reason == "not_a_car"
    assert got[2].total_views_analyzed == 0 and got[2].message.startswith("No car") and got[4].message
    assert got[3].any_view_error and not got[3].damage_detected and got[3].per_view["right"].error == "boom"


def test_plate_text_modes(spark):
    df = spark.createDataFrame([([(2, 5.0, "a-i", 0.5), (1, 9.0, "x12", 0.7), (1, 1.0, "34", 0.9)],), ([],)], "f array<struct<zone:int,x:double,text:string,confidence:double>>")
    rows = df.select(lines.plate_text(F.col("f")).alias("s"), lines.plate_text(F.col("f"), True).alias("r")).collect()
    assert (rows[0].s.plate_text, rows[0].s.confidence) == ("AI X12 34", 0.7)
    assert (rows[0].r.plate_text, rows[0].r.confidence) == ("34 12 A", 0.7)
    assert (rows[1].s.plate_text, rows[1].s.confidence) == ("", 0.0)


def test_page_stats_text_layer(spark):
    df = spark.createDataFrame([(1, 1, [("a", 0.5), ("b", 0.7)], False), (1, 2, [], False), (1, 3, [("c", 1.0)], True)],
                               "doc_id int, page int, lines array<struct<text:string,confidence:double>>, layer boolean")
    got = {r.page: r for r in lines.page_stats(df, text_layer="layer", count_text_layer=False).collect()}
    assert (got[1].lines, got[1].conf_min, got[2].conf_mean, got[3].lines, got[3].conf_max, got[3].error) == (2, 0.5, 0.0, 0, 1.0, "pdf_text_layer")


def png(width, height):
    def part(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + b"\x10\x20\x30" * width for _ in range(height))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "pic.png").write_bytes(png(5, 3))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    with open(tmp_path / "t.tsv", "w", newline="") as f:
        csv.writer(f, delimiter="\t").writerows([["h", "q"], ["1", "two\nlines"]] + [["x", "y"]] * 9)
    (tmp_path / "wide.tsv").write_bytes(b"\xff" + b"w\t" * src.HEAD_BYTES + b"z\nlast")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for i in range(40):
            z.writestr(f"m{i}", "x")
    with zipfile.ZipFile(tmp_path / "long.zip", "w") as z:
        for i in range(9000):
            z.writestr(f"{'n' * 60}{i}", "")
    (tmp_path / "hidden.bin").write_bytes((tmp_path / "z.zip").read_bytes())
    (tmp_path / "broken.docx").write_bytes(b"nope")
    (tmp_path / "a.json").write_text('{"k": [1, 2]}')
    (tmp_path / "sub" / "b.JSON").write_text("[]")
    (tmp_path / "notes.md").write_text("one\ntwo\n")
    return tmp_path


def test_file_sources(spark, folder):
    read = lambda pattern: src.read_files(spark, str(folder), pattern)
    previews = {r.path.rsplit("/", 1)[1]: r for r in src.tabular_preview(read("*.tsv")).collect()}
    assert previews["t.tsv"].preview_rows[1] == ["1", "two\nlines"] and len(previews["t.tsv"].preview_rows) == 5
    first, second = previews["wide.tsv"].preview_rows
    assert len(first) == src.HEAD_BYTES + 1 and first[0] == "\ufffdw" and second == ["last"]
    members = {r.path.rsplit("/", 1)[1]: r for r in src.archive_listing(read("*.{zip,docx}")).collect()}
    assert members["z.zip"].archive_entries == [f"m{i}" for i in range(30)]
    assert members["long.zip"].archive_entries[29].endswith("n29") and members["broken.docx"].archive_error
    images = {r.path.rsplit("/", 1)[1]: r for r in src.image_metadata(spark, [str(folder / "pic.png"), str(folder / "bad.png")]).collect()}
    assert (images["pic.png"].width, images["pic.png"].height, images["pic.png"].mode) == (5, 3, "RGB") and images["bad.png"].image_error


def test_json_corpus_takes_each_file_once(spark, folder):
    inputs = [str(folder), str(folder / "sub"), str(folder / "a.json"), str(folder / "sub" / "b.JSON")]
    names = sorted(r.path.rsplit("/", 1)[1] for r in src.read_json_corpus(spark, inputs).collect())
    assert names == ["a.json", "b.JSON"]


def test_file_job(spark, folder):
    out = file_job(src.read_files(spark, str(folder)))
    kinds = {r.filename: r.category for r in out["inventory"].collect()}
    assert kinds["pic.png"] == "image" and kinds["t.tsv"] == "text" and kinds["z.zip"] == "archive" and kinds["hidden.bin"] == "archive" and kinds["a.json"] == "json"
    assert {r.path.rsplit("/", 1)[1] for r in out["json"].collect()} == {"a.json", "b.JSON"}
    assert out["chunks"].count() == len(kinds)


def test_sinks_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([("d", 1, ["é  x", None, ""]), ("d", None, ["y"])], "s string, p int, t array<string>")
    chunks = chunk_pages(pages, F.col("s"), F.col("p"), F.col("t"))
    write_chunks(chunks, str(tmp_path / "c"))
    text = spark.read.text(str(tmp_path / "c")).collect()
    assert any('"text":"é x"' in r.value and '"page":1' in r.value for r in text) and any('"page":null' in r.value for r in text)
    samples = spark.createDataFrame([(1, 'a "b"\nc', None)], "i int, s string, e double")
    write_samples(samples, str(tmp_path / "s"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(samples.schema).csv(str(tmp_path / "s"))
    assert back.collect() == samples.collect()


def test_settled_characters_are_left_alone_by_nfkc():
    rng, runs = random.Random(3), tx.settled_runs()
    settled = [chr(c) for a, b in runs for c in range(a, b + 1)]
    held = set(settled)
    assert len(runs) < 100 and held >= set("abcé\u0634\u0631\u0627\u0660\u06f5\u05d0\u4e00\uac00\ue000 \t\n")
    assert not held & set("\ufb01\u0301\u064b\uff21\u00a0\u1161\u00b2\u0675")
    for _ in range(20_000):
        text = "".join(rng.choices(settled, k=8))
        assert unicodedata.is_normalized("NFKC", text), ascii(text)
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and set(parts) <= held:
            assert unicodedata.is_normalized("NFKC", parts), ascii(parts)


def test_normalize_text_equals_nfkc_on_mixed_texts(spark):
    rng = random.Random(5)
    alphabet = "ab é\u0634\u0631\u064b\u0640\u0301\u1100\u1161\u11a8\uac00\ufb01\uff21\u212b\U0001d400\u4e00\u0622\u0627\u0653\u00a0"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(8))) for _ in range(500)]
    want = [" ".join(unicodedata.normalize("NFKC", t).replace("\u0640", "").split()) for t in texts]
    assert apply(spark, tx.normalize_text, texts) == want
