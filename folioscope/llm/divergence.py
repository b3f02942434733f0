"""Source divergence audit: how far the word use of every source lies from that of the other sources of its language.

Gustavson row accumulation. Kept terms stand in a term-major index: (lang, term) with the count in each source. The index is
dealt into slices by term. In a slice every source is a row: its terms are looked up in the index one run after another, and
each posting found adds to a dense accumulator with one cell a peer; nothing is emitted for a posting, only the finished
cells. A term that a source or its peer lacks still has a share there, the zero baseline. The sums over all terms as if no
two sources shared one follow from how often each share occurs in a source; the accumulator adds, for the terms that both
have, what that baseline gets wrong.

Contract: null text, lang and source count as ''. Terms are runs of ASCII letters and characters beyond ASCII, with only A-Z
lower-cased. A language keeps the V terms that occur in at least ``least`` of its documents (every row is a document).
Shares are p = 1 + floor(10^9 (count + 1) / (N + V)), with N the source's count of kept terms; the divergence of p from q
is floor((p - q)^2 / q), summed. All arithmetic is whole numbers. Every (lang, source) that occurs has its pairs, even
without terms; without kept terms their value is 0. No rows give no rows; extra columns are not read.

Words are counted per block of text and per task before the shuffle, so a frequent word or a source with a third of all
rows arrives as a few rows a task. A slice holds a bounded number of postings and one accumulator at a time. The table of
pairs has as many rows as there are pairs of sources, which is the result; it is joined by salted parts of a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.frames import written
from folioscope.llm.words import blocks, byte_class, packed_words

#: Bytes of terms ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+``.
LETTERS = byte_class([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
LEAST, UNIT, TOP = 3, 1_000_000_000, 200
TEXT_BLOCK = 1 << 23
SLICE_POSTINGS, CHUNK_POSTINGS, SALTS = 1 << 16, 1 << 20, 16


def term_counts(docs: DataFrame, text_column: str, lang_column: str, source_column: str) -> DataFrame:
    """(lang, source, term, n, documents): occurrences and documents of every term in every source."""
    own = docs.select(*(
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
        for c, a in ((text_column, "text"), (lang_column, "lang"), (source_column, "source"))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
            of_row = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            for b in blocks(batch.column("text"), LETTERS, lower=True, size=TEXT_BLOCK):
                if not len(b.starts):
                    continue
                words = packed_words(b).dictionary_encode()
                size = len(words.dictionary)
                held, times = np.unique(b.row_of_word() * size + words.indices.to_numpy(), return_counts=True)
                cell = of_row[b.row + held // size] * size + held % size
                order = np.argsort(cell, kind="stable")
                cells, at = np.unique(cell[order], return_index=True)
                group, term = cells // size, cells % size
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(group // len(source.dictionary))), source.dictionary.take(pa.array(group % len(source.dictionary))),
                     words.dictionary.take(pa.array(term)), pa.array(np.add.reduceat(times[order], at)),
                     pa.array(np.diff(np.append(at, len(cell))))], ["lang", "source", "term", "n", "documents"])

    found = own.mapInArrow(count, "lang string, source string, term string, n bigint, documents bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def term_index(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, term, total, postings): kept terms with their count in every source that has them."""
    terms = counts.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return terms.where(F.col("documents") >= least).drop("documents")


def _share(n: Column | str, all_: Column) -> Column:
    """1 + floor(UNIT (n + 1) / all), in decimals so that no count overflows."""
    n = F.col(n) if isinstance(n, str) else n
    top = F.lit(UNIT).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return 1 + F.call_function("div", top, all_.cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def source_shares(docs: DataFrame, index: DataFrame, lang_column: str, source_column: str) -> DataFrame:
    """(lang, source, n_all, held, kept, zero, lang_all, shares): every group's totals, share of a term it lacks, and
    how many terms have each of its shares."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_column, "lang"), (source_column, "source"))))
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_n"))
    counts = index.select("lang", F.explode("postings").alias("x")).groupBy("lang", F.col("x.source").alias("source"), F.col("x.n").alias("n")).agg(
        F.count(F.lit(1)).alias("times"))
    held = counts.groupBy("lang", "source").agg(
        F.sum(F.col("n") * F.col("times")).alias("n_all"), F.sum("times").alias("held"), F.collect_list(F.struct("n", "times")).alias("counts"))
    zero = F.lit(0).cast("bigint")
    joined = named.distinct().join(held, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("n_all", "held", "kept", "lang_n")), "counts")
    everything = F.col("n_all") + F.col("kept")
    shares = F.transform("counts", lambda x: F.struct(_share(x["n"], everything).alias("p"), x["times"].alias("times")))
    return joined.select(
        "lang", "source", "n_all", "held", "kept", (F.col("lang_n") + F.col("kept")).alias("lang_all"),
        F.when(F.col("kept") > 0, _share(zero, everything)).alias("zero"), F.coalesce(shares, F.array().cast("array<struct<p:bigint,times:bigint>>")).alias("shares"))


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return ((d * d).astype(np.uint64) // q.astype(np.uint64)).astype(np.int64)


def _accumulated(table: pa.Table) -> pa.Table:
    """Row by row over the slice's sources: corrections of the zero baseline for the terms shared with each peer."""
    table = table.combine_chunks()
    term = pc.dictionary_encode(table.column("term").combine_chunks()).indices.to_numpy()
    names = pc.dictionary_encode(table.column("source").combine_chunks())
    source, size = names.indices.to_numpy(), len(names.dictionary)
    share, zero = table.column("p").to_numpy(), table.column("zero").to_numpy()
    by_term = np.argsort(term, kind="stable")  # the term-major index: postings of a term stand together
    term, source, share, zero = term[by_term], source[by_term], share[by_term], zero[by_term]
    first = np.searchsorted(term, np.arange(term[-1] + 2))
    both_zero = np.zeros(size, np.int64)
    both_zero[source] = zero
    rows = np.argsort(source, kind="stable")
    bounds = np.searchsorted(source[rows], np.arange(size + 1))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(size):
        own = rows[bounds[i] : bounds[i + 1]]
        cells = np.zeros(size, np.int64)
        lacking = _divergence(both_zero[i], both_zero)  # neither has the term
        lengths = first[term[own] + 1] - first[term[own]]
        done = np.concatenate([[0], np.cumsum(lengths)])
        a = 0
        while a < len(own):
            b = max(a + 1, int(np.searchsorted(done, done[a] + CHUNK_POSTINGS, side="right")) - 1)
            part, n = own[a:b], lengths[a:b]
            peer = np.repeat(first[term[part]] - (done[a:b] - done[a]), n) + np.arange(done[b] - done[a])
            p, q, q0, h = np.repeat(share[part], n), share[peer], zero[peer], source[peer]
            np.add.at(cells, h, _divergence(p, q) - _divergence(p, q0) - _divergence(both_zero[i], q) + lacking[h])
            a = b
        peers = np.flatnonzero(np.arange(size) != i)
        out.append((np.full(len(peers), i), peers, cells[peers]))
    row, peer, value = (np.concatenate(c) for c in zip(*out))
    lang = table.column("lang")[0].as_py()
    return pa.table({
        "lang": pa.array([lang], pa.string()).take(pa.array(np.zeros(len(row), np.int64))), "source": names.dictionary.take(pa.array(row)),
        "item": names.dictionary.take(pa.array(peer)), "value": pa.array(value)})


def shared_corrections(postings: DataFrame, n_postings: int) -> DataFrame:
    """(lang, source, item, value) of every two sources that share a term, a row for each slice."""
    slices = max(1, -(-n_postings // SLICE_POSTINGS))
    dealt = postings.select("lang", F.pmod(F.xxhash64("term"), F.lit(slices)).alias("slice"), "term", "source", "p", "zero")
    return dealt.groupBy("lang", "slice").applyInArrow(_accumulated, "lang string, source string, item string, value bigint")


def _zero_baselines(groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): two rows for every two sources, from the terms that one has, as if the other had none.

    The peers' side is three numbers a source, so its salted copies stay small; a source's shares stay in its own row.
    """
    left = groups.withColumn("salt", F.pmod(F.xxhash64("source"), F.lit(SALTS)).cast("int"))
    right = groups.select(
        "lang", F.col("source").alias("item"), F.col("zero").alias("zero2"), F.col("held").alias("held2"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    both = left.join(right, ["lang", "salt"]).where("source <> item")
    start = F.lit(0).cast("bigint")
    lacking = (F.col("kept") - F.col("held") - F.col("held2")) * _apart(F.col("zero"), F.col("zero2"))
    own = F.aggregate("shares", start, lambda s, x: s + x["times"] * _apart(x["p"], F.col("zero2"))) + lacking
    seen = F.aggregate("shares", start, lambda s, x: s + x["times"] * _apart(F.col("zero2"), x["p"]))
    sides = F.array(
        F.struct("source", "item", own.alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), seen.alias("value")))
    return both.select("lang", F.when(F.col("kept") > 0, sides).otherwise(
        F.array(F.struct("source", "item", start.alias("value")))).alias("sides")).select("lang", F.inline("sides"))


def _pairs(groups: DataFrame, corrections: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language."""
    parts = _zero_baselines(groups).unionByName(corrections)
    return parts.groupBy("lang", "source", "item").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("bigint").alias("value"))


def audit(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", source_column: str = "source", least: int = LEAST, top: int = TOP,
) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against its peers (``pair``, all ranks) and the terms it
    uses more than its language does (``term``, the first ``top``), largest value first, then by item."""
    index = written(term_index(term_counts(docs, text_column, lang_column, source_column), least), "term-index")
    groups = written(source_shares(docs, index, lang_column, source_column), "source-shares")
    flat = index.select("lang", "term", "total", F.explode("postings").alias("x")).select(
        "lang", "term", "total", F.col("x.source").alias("source"), F.col("x.n").alias("n"))
    totals = groups.where("kept > 0").select("lang", "source", (F.col("n_all") + F.col("kept")).alias("all"), "lang_all", "zero")
    postings = flat.join(totals, ["lang", "source"]).select(
        "lang", "source", "term", "zero", _share("n", F.col("all")).alias("p"), _share("total", F.col("lang_all")).alias("q"))
    n_postings = index.agg(F.sum(F.size("postings"))).first()[0] or 0
    pairs = _pairs(groups, shared_corrections(postings, n_postings))
    terms = postings.where("p > q").select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    ranked = pairs.withColumn("part", F.lit("pair")).withColumn("rank", place).select(*columns)
    first = terms.withColumn("part", F.lit("term")).withColumn("rank", place).where(F.col("rank") <= top).select(*columns)
    return ranked.unionByName(first)
