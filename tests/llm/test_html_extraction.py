"""Page text: blocks of odd pages, and what hosts repeat against plain substring search."""

import random

import numpy as np
import pytest

from folioscope.llm import html_extraction
from folioscope.llm.page_blocks import page_blocks

rng = random.Random(12)
SCHEMA = "page_id long, url string, html string, host string, k1 int, spans int, key int, text string"


def prose(n):
    return " ".join(f"w{rng.randrange(10**7)}" for _ in range(n))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "h", 1, 2, 3, "t") for r in rows], SCHEMA).repartition(3)
    out = html_extraction.extract_text(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    return got


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), (" \n ", ""), ("plain &amp; simple\n  text", "plain & simple text"), ("a<!-- x -->b<!--", "ab"),
    ("<p>one<p>two<br>three</p>four", "one\ntwo three\nfour"), ("<ul><li>a<li>b c</ul>d", "a\nb c\nd"),
    ("<article><h1>T</h1><p><b>x.<br><p>y &eacute;&#233;&#xe9; &am</article><footer>f</footer>", "T\nx.\ny ééé &am"),
    ("<nav>n</nav><div class='side-bar sidebar'>s</div><main><p>m</p></main><p>after", "m"),
    ("<div class=\"content-sidebar-wrap\"><div class=sidebar>s</div><article>a</article></div>", "a"),
    ("<article>a<div class=\"comments\">c</div><aside>x</aside><form>f</form><div hidden>h</div><p style='display: none'>n</p>b</article>", "a\nb"),
    ("<article>a<article>reply</article></article><article class='comment'>c</article>", "a"),
    ("<article><header><h1>t</h1></header>x</article><header>site</header>", "t\nx"),
    ("<div id=\"cookieNotice\">we use</div><div class=adBox>buy</div><div class=\"story shadow\">s</div>", "s"),
    ("<script>if (a < b) '</p>'</script><style>p</style>t<script>open", "t"), ("<p title=\"a > b\">x</p", "x"),
    ("a < b <3 c", "a < b <3 c"), ("<table><tr><td>1<td>2<tr><th>3</table>", "1 2\n3"), ("<SCRIPT>x</ScRiPt ><P>UP</P>", "UP"),
    ("</p></div>x</article>y", "x\ny"), ("<div><span>a</div>b</span>c", "a\nbc"), ("<p>" * 3000 + "deep", "deep"),
    ("<div>" * 3000 + "deep", "deep"), ("<p>a&nbsp;b c</p>", "a b c"), ("<p", ""), ("x<", "x<"),
])
def test_page(page, text):
    blocks = html_extraction.candidates(page_blocks(page))
    assert "\n".join(b.text for b in html_extraction._kept(blocks, None)) == text


def test_lists_of_links_go():
    page = "<div><a href=1>Home page</a> | <a href=2>About us</a></div><div>Some words with <a href=3>a link</a> inside them.</div>"
    blocks = html_extraction.candidates(page_blocks(page))
    assert [b.text for b in html_extraction._kept(blocks, None)] == ["Some words with a link inside them."]


def test_host_repeats(spark):
    notice, teaser = prose(40), prose(9)
    rows, want = [], {}
    for i in range(40):
        own = [prose(rng.randrange(30, 90)) for _ in range(3)]
        mixed = f"{prose(4)} {notice} {prose(3)}"  # repeated words cover most of the block
        rows.append((i, f"https://one.example/{i}", f"<div>{mixed}</div><p>{own[0]}</p><div>{teaser}</div><p>{own[1]}</p><p>{own[2]}</p>"))
        want[i] = "\n".join(own)
    shared = prose(60)
    for i in range(40, 60):  # inside articles: a quoted passage stays, what stands on every page goes
        own = [prose(50) for _ in range(3)]
        quoted = [shared] if i % 5 == 0 else []
        rows.append((i, f"http://USER@two.example:80/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in [*own, *quoted, teaser]) + "</article>"))
        want[i] = "\n".join(own + quoted)
    for i in range(60, 64):  # the same words on other hosts, and without a host
        rows.append((i, f"http://h{i}.example/" if i < 62 else (None, "no url")[i - 62], f"<div>{notice}</div><p>{teaser}</p>"))
        want[i] = f"{notice}\n{teaser}"
    copy = "<p>" + "</p><p>".join(prose(40) for _ in range(4)) + "</p>"
    for i in range(64, 70):  # copies and near copies keep their text
        rows.append((i, "http://three.example/", copy + (f"<p>{prose(5)}</p>" if i > 66 else "")))
        want[i] = "\n".join(b.text for b in page_blocks(rows[-1][2]))
    got = {r.page_id: r.text for r in run(spark, rows)}
    assert got == want


def test_odd_rows(spark):
    long = prose(60_000)
    rows = [(None, None, None), (None, "http://x/", ""), (1, "http://x/", f"<p>{long}</p>"), (2, "::bad::", "<p>a"), (2, "::bad::", "<p>a")]
    rows += [(3, "http://x/", "<article><p>same row</p></article>")] * 300
    got = run(spark, rows)
    assert sorted((r.page_id or 0, r.text) for r in got) == sorted(
        [(0, ""), (0, ""), (1, long), (2, "a"), (2, "a")] + [(3, "same row")] * 300)
    assert run(spark, []) == []


def test_every_long_common_substring_has_a_common_entry():
    size = html_extraction.PREFIX + html_extraction.SPAN - 1
    for _ in range(300):
        shared = np.array([rng.randrange(1 << 40) for _ in range(html_extraction.SPAN)], dtype=np.uint64)  # keys of its prefixes
        found = []
        for _ in range(2):
            before, after = (np.array([rng.randrange(1 << 40) for _ in range(rng.randrange(30))], dtype=np.uint64) for _ in range(2))
            keys = np.concatenate([before, shared, after])
            taken = html_extraction._sparse(keys, np.zeros(len(keys), np.int64))
            found.append({int(keys[i]) for i in taken if len(before) <= i < len(before) + len(shared)})
        assert found[0] & found[1] and size == 31
    rows = np.repeat([0, 2, 5], [1, 40, 3])
    taken = html_extraction._sparse(np.arange(44, dtype=np.uint64)[::-1].copy(), rows)
    assert set(rows[taken]) == {0, 2, 5} and list(html_extraction._sparse(np.zeros(0, np.uint64), np.zeros(0, np.int64))) == []
