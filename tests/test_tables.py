"""Queries on tables of several files, and work that must not be done twice."""

import re
from pathlib import Path

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from folioscope.catalog.views import cards, documents
from folioscope.functions.text import SPACES, settled_runs, squeeze_key, unsettled
from folioscope.operators.chunks import rag_chunks, struct_chunks
from folioscope.operators.detections import suppression_pairs
from folioscope.operators.records import _SHORT_RUNS, annotate_lines, extract_record
from folioscope.operators.translate import translate_ocr
from folioscope.rules import FIELD_LABELS_AR, SPACE_CLASS
from folioscope.sources.sinks import write_each
from folioscope.streaming import ingest


def test_streams_take_a_folder_of_files(spark, tmp_path):
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("a line\nof "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"),
        F.lit("web").alias("source"), F.lit(9).cast("bigint").alias("n_chars"))
    (tmp_path / "file").mkdir()
    docs.repartition(3).write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.toPandas().to_parquet(tmp_path / "file" / "documents.parquet")
    found = [sorted(queries()["stream_ingest"](spark, str(tmp_path / kind)).collect()) for kind in ("folder", "file")]
    assert found[0] == found[1] and sum(r["n"] for r in found[0]) >= 40


def test_a_stream_without_rows_has_no_outcomes(spark, tmp_path):
    assert ingest.committed(spark, str(tmp_path / "out"), str(tmp_path / "manifest"), "source_file string").collect() == []


def test_cards_of_one_row_group_are_dealt_over_the_cores(spark, tmp_path):
    """One small file with one row group is one task, in sessions without the test option."""
    spark.range(200).select(F.col("id").alias("p_partkey")).toPandas().to_parquet(tmp_path / "part.parquet")
    spread = spark.conf.get("spark.folioscope.spread")
    spark.conf.unset("spark.folioscope.spread")
    try:
        rows = cards(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        assert rows.count() == 200
    finally:
        spark.conf.set("spark.folioscope.spread", spread)


def test_the_own_number_is_found_once_a_card_not_once_a_number(spark):
    """A column used once is written into the place of its use, which must not be the body of a lambda over the numbers."""
    frame = spark.range(3).select("id", F.array(*map(F.lit, ("رقم اللوحة", "12345 ب", "سنة الصنع", "19", "1600 5 700"))).alias("lines"))
    found = extract_record(frame).select("record.year", "record.model_year")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"filter\(_nums#\d+, lambdafunction\(NOT \(lambda \S+ <=> (?!lambda)", plan)
    assert [tuple(r) for r in found.collect()] == [(2019, None)] * 3


def test_no_task_holds_a_language(spark, tmp_path):
    docs = spark.range(60).select(F.lit("en").alias("lang"), F.format_string("text %d", "id").alias("text"))
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    size = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        frame = queries()["file_inventory"](spark, str(tmp_path))
        written = {Path(p).parent for p in frame.inputFiles()}
        assert len(written) == 2 and len(frame.inputFiles()) == 8
        assert sorted((r.lang, r.extension, r.size_bytes) for r in frame.collect()) == [
            ("en", ".json", sum(len(f'{{"text":"text {i}"}}\n') for i in range(60))), ("en", ".txt", sum(len(f"text {i}\n") for i in range(60)))]
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", size)


def test_documents_reach_python_a_thousand_at_a_time(spark, tmp_path):
    setting, given = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.range(5000).selectExpr("id AS doc_id", "'a text' AS text", "'en' AS lang", "'web' AS source", "6L AS n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    try:
        for before, most in (("10000", 1000), ("500", 500)):  # the default gives way, a chosen number stays
            spark.conf.set(setting, before)
            rows = documents(spark, str(tmp_path)).coalesce(1).select("text")
            sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
            assert sum(sizes) == 5000 and max(sizes) == most
    finally:
        spark.conf.set(setting, given)


def test_lines_are_looked_up_before_they_are_compared(spark):
    """Equal keys and digits are found by position: only other lines are compared with all values, and those are plain texts."""
    record = F.struct(*[F.lit(v).alias(n) for n, v in {
        **dict.fromkeys(FIELD_LABELS_AR), "plate_number": "123", "make": "AB", "model": "ABC", "color": "XYZ", "year": "2019", "seats": "123"}.items()])
    texts = ["a b", "12 3", "no. 123.", "xABCx", "B", "", None, "2019 XYZ", "q", "x y"]
    frame = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.array(*map(F.lit, texts))).alias("lines"), record.alias("record"))
    found = annotate_lines(frame)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"lambdafunction\([^\n]*filter\(_values#", plan)
    # Equal digits speak for a numeric field, the first in order; contained texts go by length, then by order.
    assert sorted((r.line_index, r.text, r.field) for r in found.collect()) == [
        (1, "a b", "make"), (2, "12 3", "plate_number"), (3, "no. 123.", "plate_number"), (4, "xABCx", "model"), (5, "B", "model"),
        (8, "2019 XYZ", "year"), (10, "x y", "color")]


def test_plates_are_the_only_key(spark, tmp_path):
    """Digits and letters follow from the plate, so they are neither cleaned for every word nor moved."""
    docs = [(0, "a-1 A1\nb", "en", "web", 7), (1, "a.17 1io", "en", "web", 8)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries()["clean_plate"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == [("1IO8", "18", "", 1), ("A17", "17", "A", 2), ("A178", "178", "A", 1), ("B7", "7", "B", 1)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[plate#\d+\]|Aggregate \[_groupingexpression#\d+\]", plan)) == 1


def test_text_classes_leave_early(spark):
    """The class of characters that may change under NFKC asks common letters first, and says what the plain class says."""
    assert unsettled().startswith(r"[[^\x{0}-\x{9f}]&&[[^\x{bf}-\x{131}]&&[[^\x{61b}-\x{64a}]&&")
    plain = "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in settled_runs())
    spaces = r"(?:[\t-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\x20(?=[" + SPACE_CLASS + "]))[" + SPACE_CLASS + "]*"
    chars = [c for c in range(1, 0x11000) if not 0xD800 <= c <= 0xDFFF]
    rows = spark.createDataFrame([(f"a {chr(c)}  B",) for c in chars], "t string")
    other = rows.where(
        (F.col("t").rlike(f"[^{plain}]") != F.col("t").rlike(unsettled())) | (F.regexp_replace("t", spaces, "_") != F.regexp_replace("t", SPACES, "_"))
        | (F.lower(F.regexp_replace("t", r"[^\p{L}\p{N}_\x{0600}-\x{06FF}]", "")) != squeeze_key(F.col("t"))))
    assert other.count() == 0


def test_every_row_is_a_file_written_by_its_task(spark, tmp_path):
    """Spark's writers start a process for the mode of every local file; equal rows are files too."""
    rows = spark.range(0, 300, 1, 6).select(F.format_string("text é %d", F.col("id") % 100).alias("t"))
    folder = tmp_path / "some files"
    for _ in range(2):  # a repeated task writes the same files
        write_each(rows, F.col("t"), str(folder), ".txt")
        files = [p for p in folder.rglob("*") if p.is_file()]
        assert len(files) == 300 and len({p.parent for p in files}) == 6 and {p.suffix for p in files} == {".txt"}
        assert sorted(p.read_text() for p in files) == sorted(f"text é {i % 100}" for i in range(300))
    spark.createDataFrame([(i, "u", "<p>" if i else None) for i in range(70)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    frame = queries()["json_corpus"](spark, str(tmp_path))
    names = frame.inputFiles()
    assert len(names) == 70 and not any(p.name.endswith(".crc") for p in Path(names[0].removeprefix("file:")).parent.iterdir())
    assert sorted(frame.collect())[1:] == [(i, "u", 3) for i in range(1, 70)]
    assert frame.rdd.getNumPartitions() <= 10


def test_places_of_boxes_are_compared_not_boxes(spark):
    """Equal rows: the first hides the others; comparing whole structs for each pair was most of the time."""
    rows = [(1, "a", 0.9, 10.0, 10.0, 8.0, 8.0), (1, "a", 0.9, 10.0, 10.0, 8.0, 8.0), (1, "b", 0.5, 10.5, 10.0, 8.0, 8.0), (1, "c", 0.4, 90.0, 90.0, 8.0, 8.0), (2, "d", 0.1, 1.0, 1.0, 2.0, 2.0)]
    found = suppression_pairs(spark.createDataFrame(rows, "image_id long, det_id string, score double, cx double, cy double, w double, h double"))
    assert sorted((r.image_id, r.det_id, r.kept_id) for r in found.collect()) == [(1, "a", "a"), (1, "b", "a")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains(at#" in plan and "array_contains(kept#" not in plan and "size(at#" in plan


def test_iou_pairs_has_every_pair_that_overlaps(spark, tmp_path):
    """The box of line 9 hides those of lines 1 and 5, which overlap each other as well: their pair was left out."""
    rows = [(7, 1, 1, 1, 0.0), (7, 1, 1, 5, 0.0), (7, 1, 1, 9, 0.0), (7, 4, 5, 2, 2.0), (None, 1, 1, 1, 0.0), (None, 1, 1, 5, 0.0), (8, 1, 1, 1, 0.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = sorted((r.image_id or 0, r.det_id, r.better_id, r.iou) for r in queries()["iou_pairs"](spark, str(tmp_path)).collect())
    assert found == [(0, "1-1-1-0", "5-1-1-0", 1.0), (7, "1-1-1-0", "5-1-1-0", 1.0), (7, "1-1-1-0", "9-1-1-0", 1.0), (7, "5-1-1-0", "9-1-1-0", 1.0)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted((r[0] or 0, *r[1:]) for r in con.execute(oracle_sql()["iou_pairs"]).fetchall()) == found


def test_translation_has_the_lines_and_their_count(spark, tmp_path):
    """The translation of a card is that of its fields and of its OCR lines; lines and count were left out."""
    spark.createDataFrame([(3,), (5,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    rows = queries()["translate_record"](spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.lines for r in cards(spark, str(tmp_path)).collect()}
    lines = sorted((r for r in rows if r.part == "line"), key=lambda r: (r.doc_id, r.line_index))
    assert [(r.doc_id, r.line_index, r.value) for r in lines] == [(k, i + 1, t) for k in (3, 5) for i, t in enumerate(texts[k])]
    assert {(r.page, r.line_count) for r in lines} == {(1, 23)} and lines[0].translation == "Oman Police" and lines[0].confidence == 0.09
    assert sum(r.part == "field" for r in rows) == 2 * 19 and len(rows) == 2 * 19 + 2 * 23
    line, page = "struct<text:string,confidence:double>", "struct<page:int,lines:array<struct<text:string,confidence:double>>>"
    docs = [(1, [(4, [("\u0631\u0642\u0645  x", 0.5), None, (None, 0.25)]), None, (9, None), (None, [(" ", None)])], None), (2, None, [("plain", 1.0)]), (3, None, None), (4, [], [("unread", 1.0)])]
    found = translate_ocr(spark.createDataFrame(docs, f"doc_id int, pages array<{page}>, lines array<{line}>"))
    assert found.columns == ["doc_id", "line_count", "page", "line_index", "text", "translation", "confidence"]
    assert sorted(map(tuple, found.collect()), key=str) == [
        (1, 3, 4, 1, "\u0631\u0642\u0645  x", "Number x", 0.5), (1, 3, 4, 3, None, None, 0.25), (1, 3, None, 1, " ", "", None),
        (2, 1, 1, 1, "plain", "plain", 1.0), (3, 0, None, None, None, None, None), (4, 0, None, None, None, None, None)]


def test_the_report_of_damage_views_is_read_once(spark):
    plan = queries()["damage_views"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") == 1  # of the boxes with and without an area
    assert plan.count("Generate explode(concat(transform(map_entries(") == 1


def test_prose_leaves_the_card_rules_early(spark):
    runs = ["one two three four five six seven", "ab-cd 1 efghijklmno pqr", "ABCDEFGHIJK 1 LMNOPQRSTUVWXYZABCDEFGH", "ABCD EFGHIJKLM NO PQ RSTU V", "ABCD EFGHIJKLM NO PQ RS"]
    df = spark.createDataFrame([(r,) for r in runs], "t string")
    found = df.select("t", F.regexp_extract_all("t", F.lit(_SHORT_RUNS), F.lit(1)).alias("r")).collect()
    assert [[x for x in row.r if x] for row in found] == [[], ["ab-cd ", "efghijklmno pqr"], ["ABCDEFGHIJK "], [], ["ABCD EFGHIJKLM NO PQ RS"]]
    texts = [["n\u0131l and \u00e9nil"], ["a \u00e9 NIL."], ["\U0001d7d7\U0001d7d8\U0001d7d9 x"], [], ["Vin", "no", "JTDBR32E520012345"], ["\u0627\u0644\u0645\u062d\u0631\u0643", "\u0661\u0662\u0660\u0660"]]
    read = extract_record(spark.createDataFrame(list(enumerate(texts)), "n int, lines array<string>"))
    got = {r.n: (r.engine_number, r.plate_number, r.vin_or_chassis, r.engine_cc, r.make) for r in read.select("n", "record.*").collect()}
    assert got == {0: ("NIL", None, None, None, None), 1: ("NIL", None, None, None, None), 2: (None, None, None, None, None), 3: (None,) * 5,
                   4: (None, None, "JTDBR32E520012345", None, None), 5: (None, "1200", None, 1200, None)}
    assert "_wide" in read._jdf.queryExecution().optimizedPlan().toString()


def test_records_are_chunked_without_their_json(spark):
    kind = "a string, n int, notes array<string>, source struct<lang:string,pairs:array<struct<k:string,v:bigint>>>"
    rows = [(0, (" x  y\u00a0", 7, None, ("ar", []))), (1, (None, None, [], None)), (2, ('q"\\\n\x1cz', -1, ["one", None, " "], ("", [("k", 5), None, (None, None)]))),
            (3, ("w" * 700, 1, ["v" * 499, "u" * 500, "\u0645" * 1300], None)), (4, ("w" * 1100, 1, ["v" * 31], None))]
    frame = spark.createDataFrame(rows, f"id int, value struct<{kind.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>")
    source = F.col("id").cast("string")
    direct = struct_chunks(frame, source, "value")
    parsed = rag_chunks(frame.select(source.alias("source_file"), F.to_json("value", {"ignoreNullFields": "false"}).alias("raw")))
    key = lambda r: (r.source_file, r.chunk_id)
    assert sorted(direct.collect(), key=key) == sorted(parsed.collect(), key=key) and direct.schema.simpleString() == parsed.schema.simpleString()
    assert "Python" not in direct._jdf.queryExecution().executedPlan().toString()
