"""Source divergence against plain sums over every kept term."""

import random
import re
from collections import Counter, defaultdict

import pytest

from folioscope.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}
rng = random.Random(5)
SCHEMA = "text string, lang string, source string, p int, zero int, term string, n int, item string, rank int, salt int"


def plain(rows, least=3, top=200):
    seen, counts, held = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        words = TERM.findall(text.translate(LOWER))
        held.add((lang, source))
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = []
    for lang, source in held:
        kept = [t for t, n in seen[lang].items() if n >= least]

        def shares(total):
            n = sum(total[t] for t in kept)
            return {t: 1 + 10**9 * (total[t] + 1) // (n + len(kept)) for t in kept}

        own = shares(counts[lang, source])
        parts = {"pair": [], "term": []}
        for other_lang, peer in held:
            if other_lang == lang and peer != source:
                q = shares(counts[lang, peer])
                parts["pair"].append((peer, sum((own[t] - q[t]) ** 2 // q[t] for t in kept)))
        whole = Counter()
        for (other_lang, _), c in counts.items():
            if other_lang == lang:
                whole.update(c)
        q = shares(whole)
        parts["term"] = [(t, (own[t] - q[t]) ** 2 // q[t]) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        for part, found in parts.items():
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "t", 3, "i", 4, 5) for r in rows], SCHEMA).repartition(3)


def check(spark, rows, **settings):
    got = divergence.audit(frame(spark, rows), **settings)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, **settings)


def prose(n, size):
    return " ".join(rng.choice(["The", "été", "x1y", "漢字", "A-b", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(size))]) for _ in range(n))


@pytest.fixture(params=["small", "tiny slices"])
def slices(request, monkeypatch):
    if request.param != "small":
        for name in ("SLICE_POSTINGS", "CHUNK_POSTINGS"):
            monkeypatch.setattr(divergence, name, 7)
        monkeypatch.setattr(divergence, "TEXT_BLOCK", 200)


def test_odd_rows(spark, slices):
    rows = [(prose(rng.randrange(40), 60), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None])) for _ in range(60)]
    rows += [(None, "en", "empty"), ("", None, "none"), ("12 34 \n", "zz", "digits"), ("Only ONE only", "zz", "x"), ("one", "one", "alone")]
    rows += [("hot words hot words", "en", "a")] * 200 + [("same same", "tie", s) for s in "pqr"] + [("same", "tie", "p")]
    rows += [(prose(5000, 300), "fr", "long")]
    check(spark, rows)
    check(spark, rows, least=1, top=4)


def test_shares_do_not_overflow(spark):
    rows = [("a " * 30_000, "en", "x")] * 3 + [("b", "en", s) for s in "xyz"] * 3
    check(spark, rows)


def test_no_rows(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    assert divergence.audit(frame(spark, [(None, None, None)])).count() == 0
