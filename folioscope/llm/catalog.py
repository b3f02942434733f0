"""One query per operator over its whole table, and oracle SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    chat_perspectives,
    decontamination,
    divergence,
    html_extraction,
    licenses,
    ngram_join,
    secrets,
    sentencepiece,
    substring_dedup,
    vector_codes,
    warc_fixity,
)
from folioscope.llm import quality_classifier as classifier
from folioscope.llm import quality_rules as rules


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_secrets(table(spark, sf_dir, "documents")))


def damaged(page_id: Column, record: Column) -> Column:
    """A record as the replica has it, with flipped characters or cut, null where it is lost; all fixed by the page id."""
    flipped = F.concat(F.lit("w"), F.substring(record, 2, 1 << 30))
    kept = F.when(page_id % 97 == 3, flipped).when(page_id % 389 == 7, F.substring(record, 1, 60)).otherwise(record)
    return F.when(~F.coalesce(page_id % 193 == 5, F.lit(False)), kept)


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_fixity.page_records(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    record = F.col("record")
    hashed = records.select(
        "file", "page_id", warc_fixity.record_size(record).alias("size"), F.sha2(record, 256).alias("digest"),
        F.sha2(damaged(F.col("page_id"), record), 256).alias("replica_digest"))
    both = warc_fixity.placed(hashed, "replica_digest")
    return warc_fixity.audit(both, both.select("file", "offset", F.col("replica_digest").alias("digest")))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ",")
    return chat_perspectives.rotate(table(spark, sf_dir, "conversations")).select(
        "conv_id", "speaker", "part", "n_turns", F.length("rendered").cast("bigint").alias("n_chars"),
        F.sha2("rendered", 256).alias("rendered_sha256"), spans.alias("mask"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clean_lines(table(spark, sf_dir, "documents")).drop("cleaned")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op9_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", F.array_join("licenses", ",").alias("licenses"), F.array_join("notices", ",").alias("notices"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("k1", "k2", "items")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_sha256(books)).alias("codebooks_sha256"))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_text(table(spark, sf_dir, "pages"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_secrets": op2_secrets,
    "op3_warc_fixity": op3_warc_fixity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_chat_perspectives": op6_chat_perspectives,
    "op7_quality_rules": op7_quality_rules,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_license_digests": op9_license_digests,
    "op10_decontamination": op10_decontamination,
    "op11_vector_codes": op11_vector_codes,
    "op12_html_text": op12_html_text,
    "op13_source_divergence": op13_source_divergence,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
SQL_TEXT = {name: getattr(rules, name).replace("'", "''") for name in ("PUNCTUATION", "CLOSED", "SEPARATOR", "NAVIGATION", "BOILERPLATE")}



def _sql_string(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_lines(text: str) -> str:
    out = f"regexp_replace({LOWER.format(text)}, {_sql_string(licenses.MARKS)}, ' ', 'g')"
    out = f"regexp_replace({out}, {_sql_string(licenses.COPYRIGHT)}, '\\1', 'g')"
    for spelling, same in licenses.EQUIVALENT:
        out = f"replace({out}, '{spelling}', '{same}')"
    return out


def _canonical(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'), ' ')"


_known_rows = ", ".join(f"({_sql_string(name)}, {_sql_string(text)})" for name, text in licenses.KNOWN)


def _secret_spans(number: int, rule: secrets.Rule) -> str:
    """Passing spans of one rule; positions are sums over gaps and matches."""
    pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "|".join(
        "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")))
    pattern = pattern.replace("'", "''")
    return f"""
  SELECT rid, {number} AS kind, '{rule.kind}' AS name, pos AS start, pos + length(m) AS stop FROM (
    SELECT rid, ms[i] AS m, gs[i] AS g, length(array_to_string(gaps[1:i], '')) + length(array_to_string(ms[1:i-1], '')) AS pos
    FROM (SELECT rid, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS ms,
                 regexp_extract_all(text, '{pattern}', {rule.group}) AS gs FROM doc) AS t, unnest(range(1, len(ms) + 1)) AS u(i))
  WHERE length(g) >= {rule.least}"""


_found = " UNION ALL".join(_secret_spans(i, r) for i, r in enumerate(secrets.RULES))
_base = [i for i, r in enumerate(secrets.RULES) if r.base]


def _vector_round(k: int) -> str:
    """Nearest entries under codebook k, and codebook k + 1; floors of quotients are written out for negative sums."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT DISTINCT ON (rid, part) rid, part, entry, d FROM (
    SELECT rid, part, entry, sum((c.v - b.v) * (c.v - b.v)) AS d FROM comp AS c JOIN book{k} AS b USING (part, pos) GROUP BY rid, part, entry)
  ORDER BY rid, part, d, entry),
book{k + 1} AS MATERIALIZED (
  SELECT part, entry, pos, coalesce(m.v, b.v) AS v FROM book{k} AS b LEFT JOIN (
    SELECT part, entry, pos, (sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*) AS v
    FROM comp JOIN near{k} USING (rid, part) GROUP BY part, entry, pos) AS m USING (part, entry, pos)),"""


ORACLES = {
    "op2_secrets": f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
span AS ({_found}),
listed AS (
  SELECT rid, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans,
         string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind <= {max(_base)}) AS base,
         {", ".join(f"count(*) FILTER (kind = {i}) AS n_{secrets.RULES[i].kind}" for i in _base)}
  FROM span GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{secrets.RULES[i].kind}, 0) AS n_{secrets.RULES[i].kind}" for i in _base)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN listed USING (rid)
""",
    "op3_warc_fixity": f"""
WITH rec AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
         || coalesce(CAST(page_id AS VARCHAR), 'null') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') AS record FROM pages),
placed AS (
  SELECT *, CAST(floor(page_id / {warc_fixity.PER_FILE}) AS BIGINT) AS file,
         CAST(coalesce(sum(strlen(record) + 4) OVER (
           PARTITION BY floor(page_id / {warc_fixity.PER_FILE}) ORDER BY page_id, sha256(record)
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM rec)
SELECT file, "offset", CASE WHEN page_id % 193 = 5 THEN 'missing' ELSE 'altered' END AS status, sha256(record) AS left_digest,
       CASE WHEN page_id % 193 = 5 THEN NULL WHEN page_id % 97 = 3 THEN sha256('w' || substr(record, 2))
            ELSE sha256(substr(record, 1, 60)) END AS right_digest
FROM placed WHERE page_id % 193 = 5 OR page_id % 97 = 3 OR page_id % 389 = 7
""",
    "op6_chat_perspectives": f"""
WITH turns AS (
  SELECT conv_id, CAST(floor(coalesce(turn, 0) / {chat_perspectives.PER_PART}) AS BIGINT) AS part, turn, coalesce(role, 'unknown') AS role,
         replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM turns WHERE role <> 'system'),
head AS (
  SELECT t.*, speaker, '<|im_start|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
         ELSE 'user name=' || role END || chr(10) AS head FROM turns AS t JOIN speakers AS s USING (conv_id)),
placed AS (
  SELECT *, length(head) + length(text) + 11 AS size,
         coalesce(sum(length(head) + length(text) + 11) OVER (
           PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM head)
SELECT conv_id, speaker, part, count(*) AS n_turns, CAST(sum(size) AS BIGINT) AS n_chars,
       sha256(string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS rendered_sha256,
       coalesce(string_agg((pos + length(head)) || ':' || (pos + size - 1), ',' ORDER BY pos) FILTER (role = speaker), '') AS mask
FROM placed GROUP BY conv_id, speaker, part
""",
    "op9_license_digests": f"""
WITH known AS (
  SELECT license, sha256(form) AS digest FROM (
    SELECT DISTINCT license, {_canonical(_canonical_lines("text"))} AS form FROM (VALUES {_known_rows}) AS k(license, text)) AS f
  WHERE form <> ''),
doc AS (SELECT row_number() OVER () AS rid, doc_id, {_canonical_lines("coalesce(text, '')")} AS lines FROM documents),
whole AS (SELECT rid, doc_id, sha256({_canonical("lines")}) AS digest FROM doc),
line AS (SELECT DISTINCT rid, sha256({_canonical("l")}) AS digest FROM (SELECT rid, unnest(string_split(lines, chr(10))) AS l FROM doc) AS t),
named AS (SELECT digest, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM known GROUP BY digest),
notice AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM line JOIN known USING (digest) GROUP BY rid)
SELECT doc_id, digest, coalesce(licenses, '') AS licenses, coalesce(notices, '') AS notices
FROM whole LEFT JOIN named USING (digest) LEFT JOIN notice USING (rid)
""",
    "op4_substring_dedup": rf"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT rid, s, md5(array_to_string(w[s : s + 34], ' ')) AS x FROM doc, unnest(range(1, len(w) - 33)) AS t(s)),
twice AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT rid, i FROM (SELECT rid, s FROM win WHERE x IN (SELECT x FROM twice)) AS r, unnest(range(s, s + 35)) AS t(i)),
word AS (SELECT rid, i, w[i] AS x FROM doc, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT rid, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS x FROM word ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256
FROM doc LEFT JOIN kept USING (rid)
""",
    "op5_ngram_jaccard": rf"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS rid, doc_id, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
shingle AS (
  SELECT DISTINCT rid, md5(array_to_string(w[s : s + 2], ' ')) AS x FROM doc, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(s)
  WHERE len(w) > 0),
size AS (SELECT rid, count(*) AS n FROM shingle GROUP BY rid),
overlap AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS o FROM shingle AS a JOIN shingle AS b ON a.x = b.x AND a.rid <> b.rid GROUP BY 1, 2),
link AS (
  SELECT a, b FROM overlap JOIN size AS s ON s.rid = a JOIN size AS t ON t.rid = b WHERE 100 * o >= 90 * (s.n + t.n - o)),
reach AS (
  SELECT rid AS a, rid AS b FROM doc
  UNION
  SELECT r.a, l.b FROM reach AS r JOIN link AS l ON l.a = r.b)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, c.component_id
FROM doc AS d LEFT JOIN size AS s USING (rid)
JOIN (SELECT a AS rid, min(doc_id) AS component_id FROM reach JOIN doc ON doc.rid = reach.b GROUP BY a) AS c USING (rid)
""",
    "op7_quality_rules": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
line AS (
  SELECT rid, i, l, len(lw) AS n, rtrim(l, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS r,
         length(regexp_replace(l, '[^!-/:-@\[-`{{-~]', '', 'g')) AS marks, length(array_to_string(lw, '')) AS chars
  FROM (SELECT rid, i, ls[i] AS l, {WORDS.format("ls[i]")} AS lw
        FROM (SELECT rid, string_split(text, chr(10)) AS ls FROM doc) AS t, unnest(range(1, len(ls) + 1)) AS u(i)) AS t),
judged AS (
  SELECT rid, n, row_number() OVER (PARTITION BY rid, l ORDER BY i) > 1 AS again,
         (n > 3 AND 3 * marks > chars) OR (n < 3 AND NOT regexp_matches(r, '{SQL_TEXT["CLOSED"]}'))
         OR len(regexp_extract_all(l, '{SQL_TEXT["SEPARATOR"]}')) >= 3
         OR regexp_matches({LOWER.format("r")}, '{SQL_TEXT["NAVIGATION"]}')
         OR regexp_matches({LOWER.format("l")}, '{SQL_TEXT["BOILERPLATE"]}') AS failed
  FROM line WHERE n > 0),
lines AS (
  SELECT rid, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(n) FILTER (NOT failed), 0) AS n_kept_words,
         count(*) FILTER (failed) AS n_removed_lines FROM judged GROUP BY rid),
win AS (SELECT rid, s, w[s : s + 2] AS x FROM doc, unnest(range(1, len(w) - 1)) AS t(s)),
twice AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, x) AS n FROM win) AS t WHERE n > 1),
again AS (SELECT rid, count(DISTINCT i) AS n_repeat_words FROM twice, unnest(range(s, s + 3)) AS t(i) GROUP BY rid),
counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_kept_words, 0) AS BIGINT) AS n_kept_words,
         coalesce(n_removed_lines, 0) AS n_removed_lines
  FROM doc LEFT JOIN lines USING (rid) LEFT JOIN again USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_kept_words >= n_words AS kept
FROM counts
""",
    "op10_decontamination": rf"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS words
  FROM item, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
doc AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
place AS (
  SELECT rid, k, s, array_to_string(w[s : s + k - 1], ' ') AS words
  FROM doc, (SELECT DISTINCT k FROM win) AS sizes, unnest(range(1, len(w) - k + 2)) AS t(s) WHERE len(w) >= k),
hit AS (SELECT DISTINCT rid, s, place.k, item_id FROM place JOIN win ON win.words = place.words AND win.k = place.k),
hits AS (
  SELECT rid, count(DISTINCT i) AS n_hit
  FROM (SELECT DISTINCT rid, s, k FROM hit) AS h, unnest(range(s, s + k)) AS t(i) GROUP BY rid),
found AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hit) AS h GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hits USING (rid) LEFT JOIN found USING (rid)
""",
    "op11_vector_codes": f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
comp AS MATERIALIZED (
  SELECT rid, (i - 1) // (len(embedding) // {vector_codes.PARTS}) AS part, (i - 1) % (len(embedding) // {vector_codes.PARTS}) AS pos,
         CAST(floor({vector_codes.SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
  FROM kept, unnest(range(1, len(embedding) + 1)) AS t(i)),
book0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, pos, v FROM comp WHERE rid <= {vector_codes.ENTRIES}),
{"".join(_vector_round(k) for k in range(vector_codes.ROUNDS + 1))}
coded AS (
  SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{vector_codes.ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{vector_codes.ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
""",
    # As far as pages hold one article element, whose blocks are headings and paragraphs, and no block repeats over a host.
    "op12_html_text": r"""
WITH piece AS (
  SELECT row_number() OVER () AS rid, page_id, url,
         string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h[1-6])>') AS ps FROM pages),
plain AS (
  SELECT page_id, url, list_transform(ps, lambda p: trim(regexp_replace(regexp_replace(replace(replace(replace(
           regexp_replace(regexp_replace(p, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
           '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS ls FROM piece)
SELECT page_id, url, array_to_string(list_filter(ls, lambda l: l <> ''), chr(10)) AS text,
       length(array_to_string(list_filter(ls, lambda l: l <> ''), chr(10))) AS n_chars FROM plain
""",
    "op13_source_divergence": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
word AS (SELECT rid, lang, source, unnest(w) AS term FROM doc),
kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM word GROUP BY lang, term HAVING count(DISTINCT rid) >= {divergence.LEAST}),
size AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
own AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM word SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT lang, source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM doc)
        LEFT JOIN (SELECT lang, source, sum(n) AS n FROM own GROUP BY lang, source) AS s USING (lang, source)),
share AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + 1000000000 * (coalesce(o.n, 0) + 1) // (g.n + s.v) AS p,
         1 + 1000000000 * (k.n + 1) // (s.n + s.v) AS q
  FROM grp AS g JOIN size AS s USING (lang) JOIN kept AS k USING (lang) LEFT JOIN own AS o USING (lang, source, term)),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM share AS a JOIN share AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM grp AS a JOIN grp AS b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM share WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term) AS t)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}
""",
}
