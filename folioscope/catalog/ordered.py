"""Registered order-dependent and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.catalog.joins import nms_sql
from folioscope.catalog.routing import COLLAPSED
from folioscope.catalog.sources import page_chunks
from folioscope.catalog.views import (
    CARDS_SQL, DETECTIONS_SQL, LINES_SQL, PAGE_LINES_SQL, REQUESTS_SQL, cards, detections, documents, ocr_documents, ocr_pages,
    requests, table, with_sql,
)
from folioscope.functions.text import ordered_distinct as distinct_in_order
from folioscope.operators import lines as ln
from folioscope.operators import quality as q
from folioscope.operators.chunks import chunk_lines as pack
from folioscope.operators.chunks import rag_chunks as chunk_json
from folioscope.operators.detections import nms as suppress
from folioscope.rules import ENGINE_LABEL, MAX_LOAD_LABEL, SEATS_LABEL
from folioscope.sources.files import distinct_inputs as union_once


def flatten_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ocr_pages(spark, sf_dir).select("doc_id", F.array(F.struct("page", "lines")).alias("pages"))
    return ln.flatten_lines(docs)


def line_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines got boxes: three to a row, with uneven tops and heights."""
    def box(t, i):
        x0 = ((i * 37 + F.col("doc_id")) % 5 * 100).cast("double")
        y0 = (F.floor(i / 3) * 18 + (i * 7 + F.col("doc_id")) % 6).cast("double")
        return F.struct(
            x0.alias("x0"), y0.alias("y0"), (x0 + 60 + i % 4).alias("x1"), (y0 + 9 + (i * 3) % 7).alias("y1"),
            (i + 1).alias("line_index"), t["text"].alias("text"),
        )

    return ocr_documents(spark, sf_dir).select("doc_id", F.transform("lines", box).alias("boxes"))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = line_boxes(spark, sf_dir)
    return boxes.select(
        "doc_id", F.array_join(ln.reading_order(F.col("boxes"))["line_index"], ",").alias("ltr"),
        F.array_join(ln.reading_order(F.col("boxes"), rtl=True)["line_index"], ",").alias("rtl"),
    )


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ocr_documents(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(pack(F.col("lines")["text"], 400, 2)).alias("chunk_index", "text"))


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress(detections(spark, sf_dir)).select("image_id", "det_id", "score")


def nms_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All boxes of the table in seven images."""
    hot = detections(spark, sf_dir).withColumn("det_id", F.concat_ws("/", "image_id", "det_id")).withColumn("image_id", F.col("image_id") % 7)
    return suppress(hot).select("image_id", "det_id", "score")


def value_after_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ocr_documents(spark, sf_dir)
    return docs.select("doc_id", F.coalesce(ln.value_after(F.col("lines")["text"], "ing"), F.lit("-")).alias("value"))


def number_near_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [
        ln.number_near(F.col("lines"), ENGINE_LABEL, 4, 200, 10000), ln.number_near(F.col("lines"), MAX_LOAD_LABEL, 4, 100, 100000),
        ln.number_near(F.col("lines"), SEATS_LABEL, 3, 1, 80),
    ]
    return cards(spark, sf_dir).select(
        "doc_id", *[F.coalesce(c, F.lit(-1)).alias(n) for c, n in zip(found, ("engine_cc", "max_load_kg", "seats"))]
    )


def label_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ocr_documents(spark, sf_dir)
    text = ln.label_context(F.col("lines")["text"], ("tion", "heit"), 2, 3, "|")
    return docs.select("doc_id", F.md5(F.coalesce(text, F.lit("-"))).alias("context_md5"))


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = q.top_k(detections(spark, sf_dir), ["class_id"], [F.desc("score"), F.col("image_id"), F.col("det_id")], 20)
    return best.select("class_id", "rank", "image_id", "det_id", "score")


def drop_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = requests(spark, sf_dir).select("scenario", "ts", "event_id", "elapsed_ms")
    return q.drop_warmup(runs, ["scenario"], ["ts", "event_id"], 25).select("scenario", "event_id", "elapsed_ms")


def distinct_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("path"), "n_chars")
    first = docs.groupBy("path").agg(F.min("n_chars").alias("size"))
    second = docs.groupBy("path").agg(F.max("n_chars").alias("size"))
    english = second.where(F.col("path").endswith("/en"))
    return union_once(english, first)


def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lower("text"), "[ \n]")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.size(distinct_in_order(words)).alias("n_words"), F.md5(F.array_join(distinct_in_order(words), " ")).alias("words_md5")
    )


def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON payloads of both kinds: pages from conversations, records from documents."""
    pages = ocr_pages(spark, sf_dir).select(
        F.concat(F.lit("conv-"), F.col("doc_id").cast("string"), F.lit(".json")).alias("source_file"),
        F.to_json(F.struct(F.array(F.struct("page", "lines")).alias("pages"))).alias("raw"),
    )
    records = documents(spark, sf_dir).select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".json")).alias("source_file"),
        F.to_json(F.struct("lang", "source", F.split("text", "\n").alias("lines"))).alias("raw"),
    )
    return pages.unionByName(records)


def rag_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_json(json_documents(spark, sf_dir))
    return chunks.select("source_file", "document_type", "chunk_id", "text", "metadata.page", "metadata.chunk_index")


def rag_chunks_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = page_chunks(spark, sf_dir)
    return chunks.select("source_file", "document_type", "chunk_id", "text", "metadata.page", "metadata.chunk_index")


QUERIES = {
    "flatten_lines": flatten_lines,
    "reading_order": reading_order,
    "chunk_lines": chunk_lines,
    "nms": nms,
    "nms_hot": nms_hot,
    "value_after_label": value_after_label,
    "number_near_label": number_near_label,
    "label_context": label_context,
    "top_k": top_k,
    "drop_warmup": drop_warmup,
    "distinct_inputs": distinct_inputs,
    "ordered_distinct": ordered_distinct,
    "rag_chunks": rag_chunks,
    "rag_chunks_native": rag_chunks_native,
}

_CC = "CASE WHEN k % 7 = 0 THEN -1 ELSE cc END"

# Greedy packing as a recursion over the lines of each document or page.
PACK_SQL = """walk AS (
  SELECT key, 0 AS i, 0 AS size, CAST([] AS VARCHAR[]) AS cur, CAST([] AS VARCHAR[]) AS done FROM sized GROUP BY key
  UNION ALL
  SELECT w.key, w.i + 1,
         CASE WHEN len(w.cur) > 0 AND w.size + length(l.text) + 1 > {max_chars}
              THEN coalesce(list_sum(list_transform(w.cur[-{overlap}:], lambda x: length(x) + 1)), 0) ELSE w.size END + length(l.text) + 1,
         CASE WHEN len(w.cur) > 0 AND w.size + length(l.text) + 1 > {max_chars} THEN list_append(w.cur[-{overlap}:], l.text) ELSE list_append(w.cur, l.text) END,
         CASE WHEN len(w.cur) > 0 AND w.size + length(l.text) + 1 > {max_chars} THEN list_append(w.done, array_to_string(w.cur, chr(10))) ELSE w.done END
  FROM walk w JOIN sized l ON l.key = w.key AND l.i = w.i + 1),
packed AS (
  SELECT key, list_append(arg_max(done, i), array_to_string(arg_max(cur, i), chr(10))) AS chunks FROM walk GROUP BY key)"""


def pack_sql(max_chars: int, overlap: int) -> str:
    return PACK_SQL.format(max_chars=max_chars, overlap=overlap)


# Reading order as a recursion over the boxes of a page by falling centre: mean centre, size and number of every row that is there.
READING_SQL = """boxes AS (
  SELECT doc_id, line_index, ((i * 37 + doc_id) % 5 * 100)::DOUBLE AS x0, (i // 3 * 18 + (i * 7 + doc_id) % 6)::DOUBLE AS y0, i % 4 AS wide, 9 + (i * 3) % 7 AS high
  FROM (SELECT doc_id, line_index, line_index - 1 AS i FROM lines)),
reach AS (SELECT doc_id, greatest(8.0e0, 0.6e0 * list_sort(list(high))[count(*) // 2 + 1]) AS tol FROM boxes GROUP BY doc_id),
falling AS (
  SELECT b.*, tol, y0 + high / 2.0e0 AS yc, row_number() OVER (PARTITION BY doc_id ORDER BY y0 + high / 2.0e0, line_index) AS pos
  FROM boxes b JOIN reach USING (doc_id)),
walk AS (
  SELECT doc_id, 0::BIGINT AS pos, CAST([] AS STRUCT(yc DOUBLE, n DOUBLE)[]) AS rws, 0::BIGINT AS hit FROM reach
  UNION ALL
  SELECT doc_id, pos, CASE WHEN hit > len(rws) THEN list_append(rws, {'yc': yc, 'n': 1.0e0})
           ELSE list_transform(rws, lambda r, k: CASE WHEN k = hit THEN {'yc': (r.yc * r.n + yc) / (r.n + 1), 'n': r.n + 1} ELSE r END) END, hit
  FROM (SELECT f.doc_id, f.pos, f.yc, w.rws,
               coalesce(nullif(list_position(list_transform(w.rws, lambda r: abs(f.yc - r.yc) <= f.tol), true), 0), len(w.rws) + 1)::BIGINT AS hit
        FROM walk w JOIN falling f ON f.doc_id = w.doc_id AND f.pos = w.pos + 1)),
last_rows AS (SELECT doc_id, arg_max(rws, pos) AS rws FROM walk GROUP BY doc_id),
placed AS (
  SELECT f.*, w.hit, l.rws[w.hit].yc AS centre FROM falling f JOIN walk w ON w.doc_id = f.doc_id AND w.pos = f.pos JOIN last_rows l ON l.doc_id = f.doc_id)"""

ORACLES = {
    "reading_order": "WITH RECURSIVE " + LINES_SQL + ", " + READING_SQL + """
SELECT doc_id, string_agg(line_index, ',' ORDER BY centre, hit, x0, pos) AS ltr, string_agg(line_index, ',' ORDER BY centre, hit, -(x0 + 60 + wide), pos) AS rtl
FROM placed GROUP BY doc_id""",
    "flatten_lines": with_sql(PAGE_LINES_SQL) + "SELECT doc_id, page, line_index, text, confidence FROM page_lines",
    "chunk_lines": "WITH RECURSIVE " + LINES_SQL + """, sized AS (
  SELECT doc_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY line_index) AS i, text FROM lines WHERE text <> ''),
""" + pack_sql(400, 2) + """
SELECT key AS doc_id, i - 1 AS chunk_index, trim(text, chr(10) || ' ') AS text FROM (
  SELECT key, unnest(chunks) AS text, generate_subscripts(chunks, 1) AS i FROM packed)""",
    "nms_hot": "WITH RECURSIVE " + DETECTIONS_SQL + """, boxes AS (
  SELECT * REPLACE (image_id % 7 AS image_id, image_id || '/' || det_id AS det_id) FROM detections),
""" + nms_sql() + """
SELECT image_id, k.det_id AS det_id, score FROM (SELECT image_id, unnest(kept) AS k FROM final) f
JOIN (SELECT image_id AS im, det_id AS di, score FROM boxes) b ON b.im = f.image_id AND b.di = f.k.det_id""",
    "nms": "WITH RECURSIVE " + DETECTIONS_SQL + ", boxes AS (SELECT * FROM detections),\n" + nms_sql() + """
SELECT image_id, k.det_id AS det_id, score FROM (SELECT image_id, unnest(kept) AS k FROM final) f
JOIN (SELECT image_id AS im, det_id AS di, score FROM boxes) b ON b.im = f.image_id AND b.di = f.k.det_id""",
    "value_after_label": with_sql(LINES_SQL) + """, n AS (
  SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY line_index) AS nxt FROM lines),
hit AS (SELECT doc_id, arg_min(nxt, line_index) AS v FROM n WHERE contains(text, 'ing') AND nxt IS NOT NULL GROUP BY 1)
SELECT d.doc_id, coalesce(nullif(trim(v), ''), '-') AS value FROM documents d LEFT JOIN hit h ON d.doc_id = h.doc_id""",
    "number_near_label": with_sql(CARDS_SQL) + f"""
SELECT doc_id, {_CC} AS engine_cc, max_w AS max_load_kg, CASE WHEN k % 6 = 0 THEN -1 ELSE seat_n END AS seats FROM cards""",
    "label_context": with_sql(LINES_SQL) + """, hit AS (
  SELECT doc_id, min(line_index) AS pos FROM lines WHERE contains(text, 'tion') OR contains(text, 'heit') GROUP BY 1),
ctx AS (SELECT l.doc_id, string_agg(text, '|' ORDER BY line_index) AS c FROM lines l JOIN hit h ON l.doc_id = h.doc_id
        AND line_index BETWEEN pos - 2 AND pos + 3 GROUP BY 1)
SELECT d.doc_id, md5(coalesce(c, '-')) AS context_md5 FROM documents d LEFT JOIN ctx ON d.doc_id = ctx.doc_id""",
    "top_k": with_sql(DETECTIONS_SQL) + """
SELECT class_id, CAST(row_number() OVER (PARTITION BY class_id ORDER BY score DESC, image_id, det_id) AS INT) AS rank, image_id, det_id, score
FROM detections QUALIFY row_number() OVER (PARTITION BY class_id ORDER BY score DESC, image_id, det_id) <= 20""",
    "drop_warmup": with_sql(REQUESTS_SQL) + """
SELECT scenario, event_id, elapsed_ms FROM requests QUALIFY row_number() OVER (PARTITION BY scenario ORDER BY ts, event_id) > 25""",
    "distinct_inputs": """
SELECT source || '/' || lang AS path, CASE WHEN lang = 'en' THEN max(n_chars) ELSE min(n_chars) END AS size FROM documents GROUP BY source, lang""",
    "ordered_distinct": """
SELECT doc_id, count(*) AS n_words, md5(string_agg(w, ' ' ORDER BY i)) AS words_md5 FROM (
  SELECT doc_id, w, min(i) AS i FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, regexp_split_to_array(lower(text), '[ \\n]') AS ws FROM documents)) GROUP BY 1, 2) GROUP BY 1""",
}

_PAGE_SIZED = f"""tidy AS (SELECT doc_id, page, line_index, {COLLAPSED} AS text FROM page_lines),
sized AS (SELECT (doc_id, page) AS key, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_index) AS i, text FROM tidy WHERE text <> ''),
"""
_PAGE_CHUNKS = """
SELECT {source} AS source_file, 'ocr_pages' AS document_type, 'page-' || key[2] || '-chunk-' || i AS chunk_id, text, key[2] AS page, CAST(i AS INT) AS chunk_index
FROM (SELECT key, unnest(chunks) AS text, generate_subscripts(chunks, 1) AS i FROM packed)"""
ORACLES["rag_chunks_native"] = "WITH RECURSIVE " + PAGE_LINES_SQL + ",\n" + _PAGE_SIZED + pack_sql(1200, 3) + _PAGE_CHUNKS.format(source="CAST(key[1] AS VARCHAR)")
ORACLES["chunks_jsonl"] = ORACLES["rag_chunks_native"]
ORACLES["rag_chunks"] = "WITH RECURSIVE " + PAGE_LINES_SQL + ", " + LINES_SQL + f""",
both_kinds AS (
  SELECT 'conv-' || doc_id || '.json' AS src, page, line_index, {COLLAPSED} AS text FROM page_lines
  UNION ALL SELECT 'doc-' || doc_id || '.json', NULL, line_index + 10, 'lines[' || line_index || ']: ' || {COLLAPSED} FROM lines
  UNION ALL SELECT 'doc-' || doc_id || '.json', NULL, 1, 'lang: ' || lang FROM documents
  UNION ALL SELECT 'doc-' || doc_id || '.json', NULL, 2, 'source: ' || source FROM documents),
sized AS (SELECT (src, coalesce(page, -1)) AS key, row_number() OVER (PARTITION BY src, page ORDER BY line_index) AS i, text FROM both_kinds WHERE text <> ''),
""" + PACK_SQL.replace("w.cur[-{overlap}:]", "(CASE WHEN w.key[2] >= 0 THEN w.cur[-3:] ELSE [] END)").format(max_chars=1200) + """
SELECT key[1] AS source_file, CASE WHEN key[2] >= 0 THEN 'ocr_pages' ELSE 'structured_json' END AS document_type,
       CASE WHEN key[2] >= 0 THEN 'page-' || key[2] || '-chunk-' || i ELSE 'chunk-' || i END AS chunk_id, trim(text) AS text,
       CASE WHEN key[2] >= 0 THEN key[2] END AS page, CAST(i AS INT) AS chunk_index
FROM (SELECT key, unnest(chunks) AS text, generate_subscripts(chunks, 1) AS i FROM packed)"""
