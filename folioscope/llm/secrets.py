"""Secret scans over a trigram inverted index, with DataFrame functions alone.

Each rule's regular expression gives a Boolean trigram query: texts that lack it cannot match. The
index holds a posting (trigram, document) for every trigram that a query names; intersecting the
postings of a document leaves the rules it may match, and only those are verified on its text. Rules
without a mandatory trigram (such as runs of hexadecimal digits) read every text.

The index is a table of its own. Whether its candidates are broadcast or shuffled to the texts is
Spark's choice by their size.

Null texts count as empty: no spans, the digest of nothing. Repeated rows each get a row. Texts are
read whole; spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.binding import let
from folioscope.llm.frames import keyed_texts, written

MASK = "<secret>"


class Rule(NamedTuple):
    """Matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True


# The base kinds and well-known token formats.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, False),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 39, False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False),
)

_parser = re._parser  # the standard library's own pattern tree
_STRINGS = 64


def _literals(tree: list) -> set[str] | None:
    """All strings that a sequence matches, in lower case; None if there are too many."""
    found = {""}
    for op, value in tree:
        part = _literal(str(op), value)
        if part is None or len(found) * len(part) > _STRINGS:
            return None
        found = {a + b for a, b in product(found, part)}
    return found


def _literal(op: str, value: object) -> set[str] | None:
    if op == "LITERAL":
        return {chr(value).lower()}
    if op == "IN":
        if all(str(o) == "LITERAL" for o, _ in value):
            return {chr(v).lower() for _, v in value}
        return None
    if op == "SUBPATTERN":
        return _literals(value[-1])
    if op == "BRANCH":
        parts = [_literals(branch) for branch in value[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT":
        least, most, body = value
        if most == 1 and (own := _literals(body)) is not None:
            return own if least else own | {""}
    return None


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, in lower case: a matching text holds all of one of them. Empty: no mandatory trigram."""
    alternatives = [frozenset()]
    run = {""}

    def close(strings: set[str], known: list[frozenset[str]]) -> list[frozenset[str]]:
        if min(map(len, strings)) < 3:
            return known
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
        joint = {a | b for a, b in product(known, sets)}
        return [a for a in joint if not any(b < a for b in joint)]

    for op, value in _parser.parse(pattern):
        part = _literal(str(op), value)
        if part is not None and len(run) * len(part) <= _STRINGS:
            run = {a + b for a, b in product(run, part)}
            continue
        alternatives, run = close(run, alternatives), {""}
        if part is not None:
            run = part
        elif str(op) == "MAX_REPEAT" and value[0] and (own := _literals(value[2])):
            run = own  # the last repetition may run into what follows
            alternatives, run = close(run, alternatives), {""}
    alternatives = close(run, alternatives)
    return [] if alternatives == [frozenset()] else sorted(alternatives, key=sorted)


def _trigrams(rules: tuple[Rule, ...]) -> list[str]:
    return sorted({t for r in rules for a in trigram_query(r.pattern) for t in a})


def trigram_index(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, k1): postings of the trigrams that the rules' queries name, over all texts."""
    wanted = F.array(*(F.lit(t) for t in _trigrams(rules)))
    held = let(F.lower("text"), lambda low: F.filter(wanted, lambda t: F.contains(low, t)))
    return texts.select("k1", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(k1, rules): per document the rules whose query its postings satisfy, as a bit mask."""
    names = _trigrams(rules)
    where = {t: divmod(i, 62) for i, t in enumerate(names)}
    words = 1 + (len(names) - 1) // 62
    bits = [
        F.bit_or(F.coalesce(F.element_at(F.create_map(*(x for t, (w, b) in where.items() if w == i for x in (F.lit(t), F.lit(1 << b)))),
                                         F.col("trigram")), F.lit(0)).cast("bigint")).alias(f"w{i}")
        for i in range(words)]

    def holds(trigrams: frozenset[str]) -> Column:
        masks = [sum(1 << where[t][1] for t in trigrams if where[t][0] == i) for i in range(words)]
        met = [F.col(f"w{i}").bitwiseAND(F.lit(m).cast("bigint")) == F.lit(m).cast("bigint") for i, m in enumerate(masks) if m]
        return _every(met)

    may = F.lit(0)
    for i, rule in enumerate(rules):
        if query := trigram_query(rule.pattern):
            may = may.bitwiseOR(F.when(~_every([~holds(a) for a in query]), F.lit(1 << i)).otherwise(F.lit(0)))
    return index.groupBy("k1").agg(*bits).select("k1", may.alias("rules")).where("rules != 0")


def _every(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


SPAN = "array<struct<start:int,rule:int,end:int>>"


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """Passing matches of one rule: gaps between matches and the matches' lengths add up to positions."""
    pattern = F.lit(rule.pattern)
    steps = F.zip_with(
        F.zip_with(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                   lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size"))),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)),
        lambda s, g: F.struct(s["gap"].alias("gap"), s["size"].alias("size"), (F.length(g) >= rule.least).alias("ok")))
    span = lambda a, s: F.struct((a["at"] + s["gap"]).alias("start"), F.lit(number).alias("rule"), (a["at"] + s["gap"] + s["size"]).alias("end"))
    fold = lambda part: F.aggregate(
        part, F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
        lambda a, s: F.struct(
            (a["at"] + s["gap"] + F.coalesce(s["size"], F.lit(0))).alias("at"),
            F.when(s["ok"], F.concat(a["out"], F.array(span(a, s)))).otherwise(a["out"]).alias("out")))
    moved = lambda part, by: F.transform(part["out"], lambda s: F.struct(
        (s["start"] + by).alias("start"), s["rule"].alias("rule"), (s["end"] + by).alias("end")))
    folded = let(F.transform(_parts(steps), fold), lambda parts: F.flatten(F.zip_with(
        parts, _before(F.transform(parts, lambda p: p["at"]), lambda x, y: x + y), lambda p, by: F.when(p.isNotNull(), moved(p, by)).otherwise(F.array().cast(SPAN)))))
    return F.when(F.rlike(text, pattern), folded).otherwise(F.array().cast(SPAN))


def _parts(values: Column) -> Column:
    """An array in about as many parts as each part has elements, so that folds copy short lists only."""
    return let(values, lambda all_: let(F.ceil(F.sqrt(F.size(all_))).cast("int"), lambda c: F.transform(
        F.sequence(F.lit(0), ((F.size(all_) - 1) / c).cast("int")), lambda i: F.slice(all_, i * c + 1, c))))


def _before(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Running totals, from 0 before the first value to the total of all; one element more than the values."""
    return F.aggregate(values, F.array(F.lit(0)), lambda sums, x: F.concat(sums, F.array(add(F.element_at(sums, -1), x))))


def _found(rows: DataFrame, text: Column, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (k1, ...) with a column ``found``: spans by start, then rule."""
    may = written(candidates(written(trigram_index(rows.select("k1", text.alias("text")), rules), "trigrams"), rules), "candidates")
    whole = F.coalesce(text, F.lit(""))
    parts = []
    for i, rule in enumerate(rules):
        own = _spans(whole, i, rule)
        asked = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << i)) != 0
        parts.append(F.when(asked, own).otherwise(F.array().cast(SPAN)) if trigram_query(rule.pattern) else own)
    return rows.join(may, "k1", "left").select(*rows.columns, F.array_sort(F.concat(*parts)).alias("found"))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: k1, k2 (row key), doc_id, text, found (spans by start, then rule)."""
    return _found(keyed_texts(docs, id_column, text_column), F.col("text"), rules)


def mask_secrets(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = "n_chars",
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """The documents with secrets masked in their texts, and lengths of changed texts renewed where there is such a column; all columns stay."""
    rows = docs.select(F.xxhash64(id_column, text_column).alias("k1"), F.struct("*").alias("row"))
    text = F.col("row").getField(text_column)
    found = _found(rows, text, rules).select("row", masked(text, F.col("found")).alias("left"), (F.size("found") > 0).alias("changed"))
    out = F.col("row").withField(text_column, F.col("left"))
    if length_column in docs.columns:
        kind = docs.schema[length_column].dataType
        out = out.withField(length_column, F.length("left").cast(kind))
    return found.select(F.when(F.col("changed"), out).otherwise(F.col("row")).alias("row")).select("row.*")


def _listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"], s["end"])), ",")


def report(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans as kind:start:end lists."""
    base = F.array(*(F.lit(i) for i, r in enumerate(rules) if r.base))
    count = lambda i: F.size(F.filter("found", lambda s: s["rule"] == i)).cast("bigint")
    return found.select(
        "doc_id", *(count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base),
        F.sha2(_listed(F.filter("found", lambda s: F.array_contains(base, s["rule"])), rules), 256).alias("base_sha256"),
        _listed(F.col("found"), rules).alias("spans"))


def masked(text: Column, found: Column, mask: str = MASK) -> Column:
    """The text with every stretch covered by spans replaced by a mark.

    Spans are worked off in parts: each cuts its stretch from the text once and then cuts that, so the work does not
    grow with the number of spans times the length of the text.
    """

    def cut(part: Column, end: Column) -> Column:
        stretch = F.substring(text, end + 1, F.greatest(F.element_at(part, -1)["start"] - end, F.lit(0)))
        return let(stretch, lambda own: F.aggregate(
            part, F.struct(end.alias("at"), F.array().cast("array<string>").alias("out")),
            lambda a, s: F.struct(
                F.greatest(a["at"], s["end"]).alias("at"),
                F.when(s["start"] < a["at"], a["out"])
                .otherwise(F.concat(a["out"], F.array(F.concat(F.substring(own, a["at"] - end + 1, s["start"] - a["at"]), F.lit(mask))))).alias("out")),
            lambda a: F.array_join(a["out"], "")))

    def whole(parts: Column) -> Column:
        tops = F.transform(parts, lambda p: F.array_max(F.transform(p, lambda s: s["end"])))
        return let(_before(tops, F.greatest), lambda ends: F.concat(
            F.array_join(F.zip_with(parts, ends, lambda p, end: F.when(p.isNotNull(), cut(p, end)).otherwise(F.lit(""))), ""),
            F.substring(text, F.element_at(ends, -1) + 1, F.length(text))))

    return F.when(F.size(found) > 0, let(_parts(found), whole)).otherwise(text)
