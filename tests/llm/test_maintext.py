"""Main text of pages against hand-made pages and a plain search for repeated runs."""

import random
import re
from collections import defaultdict
from html import unescape

import pytest

from fleetmeter.llm import maintext, queries


def text_of(html):
    return "\n\n".join(t for z, t in maintext.blocks(html) if z == maintext.BODY)


def open_of(html):
    return [t for z, t in maintext.blocks(html) if z == maintext.OPEN]


def test_given_table(spark, sf):
    """Every page of the table has one article element: its blocks are the text, cut at tags by a plain rule."""
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    out = queries.queries()["op13_main_text"](spark, sf)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r for r in out.collect()}
    assert len(got) == len(rows)
    for r in rows:
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?p>|</?h1>", inner)]
        want = "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want) and got[r["page_id"]]["url"] == r["url"]


ARTICLE = "<article><h1>Title &amp; more</h1><p>One  <b>bold</b>\n word<p>two&nbsp;three<br>four</p></article>"
WANT = "Title & more\n\nOne bold word\n\ntwo three four"


@pytest.mark.parametrize("around", [
    "{}", "<nav><p>Home</nav>{}<footer>Foot</footer>", "<header><h1>Site</h1></header>{}", "<form>Name <input> {}</form>",
    "<script>var x = '<article><p>no</p></article>';</script>{}<style>p {{}}</style>", "<!-- <article>no</article> -->{}",
    '<div class="container sidebar-left">{}</div>', '<div class="ad-slot">Buy</div>{}<div id="comments"><article>Great!</article></div>',
    '<div class="cookieNotice">We use cookies</div>{}', "<aside><article>Teaser</article></aside>{}", '<div role="banner">Top</div>{}',
    '{}<section id=comments><p>First comment</p></section>', '<div style="display: none">x</div>{}<select><option>a</select>',
    '{}<article class="comment">Nice</article>', "<noscript>Turn it on</noscript>{}", '<main class="has-sidebar">{}</main><textarea>t <p> u</textarea>',
])
def test_parts_of_pages(around):
    page = f"<html><head><title>T</title></head><body class='no-ads sidebar'>{around.format(ARTICLE)}</body></html>"
    assert text_of(page) == WANT and open_of(page) == []


@pytest.mark.parametrize(("inside", "want"), [
    ("<header><h1>T</h1></header><p>a</p><aside>b</aside><p>c</p>", "T\n\na\n\nc"), ("<p>a <span class='ad'>buy</span> b</p>", "a b"),
    ("<ul><li>x<li>y</ul>", "x\n\ny"), ("<table><tr><td>1<td>2</tr><tr><td>3</table>", "1 2\n\n3"), ("<p>a<div class='share-buttons'>Share</div>b", "a\n\nb"),
    ("a &lt;b&gt; &#8364; &copy;", "a <b> € ©"), ("<p title='x > y'>a</p><p title=\"b>c</p>", "a\n\nc"), ("x</div></span>y", "x\n\ny"), ("a < b", "a < b"),
    ("<pre>a\n  b</pre>", "a b"), ("<p>" + "w " * 50_000, ("w " * 50_000).strip()), ("<P>A<BR/>b<HR>c", "A b\n\nc"), ("<svg><text>x</text></svg>a", "a"),
])
def test_blocks_of_articles(inside, want):
    assert text_of(f"<article>{inside}</article>") == want


def plain(rows):
    """Page texts by looking up each run of RUN words on all other pages of the host."""
    found = [(i, u, maintext.blocks(h)) for i, u, h in rows]
    host = lambda u: re.match(r"[^:]*://([^/?#]*)", u)[1].lower() if u and "://" in u else ""
    where = defaultdict(set)
    streams = [[w for z, t in f if z != maintext.BODY for w in t.split(" ")] for _, _, f in found]
    for (row, s) in zip(rows, streams):
        for k in range(len(s) - 5):
            where[host(row[1]), tuple(s[k : k + 6])].add(row)
    out = []
    for (row, s, (i, u, f)) in zip(rows, streams, found):
        gone = {k + j for k in range(len(s) - 5) if len(where[host(u), tuple(s[k : k + 6])]) > 1 for j in range(6)}
        at, texts = 0, []
        for z, t in f:
            words = t.split(" ")
            if z == maintext.BODY:
                texts.append(t)
            else:
                left = [w for k, w in enumerate(words) if at + k not in gone]
                texts += [" ".join(left)] if z == maintext.OPEN and left else []
                at += len(words)
        out.append((i, u, "\n\n".join(texts), len("\n\n".join(texts))))
    return sorted(out, key=str)


def test_repeats_on_other_pages_of_the_host(spark):
    r = random.Random(4)
    prose = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    menu, legal = prose(12), "All rights reserved by the people of this fine site"
    rows = []
    for i in range(30):
        host = ("a.example", "b.example", "A.Example")[i % 3]
        body = "".join(f"<p>{prose(r.randrange(3, 30))}</p>" for _ in range(3))
        page = f"<div>{menu}</div><div>{body}</div><div>{legal} {prose(2)}</div>"
        rows.append((i, f"http://{host}/{i}", page if i % 4 else f"{menu}<article>{body}<p>{menu}</p></article>{legal}"))
    rows += [(90, None, f"<p>{menu}</p>"), (91, "no host", f"<p>{menu} x</p>"), (92, "http://c/", f"<p>{menu}</p>"), (92, "http://c/", f"<p>{menu}</p>")]
    rows += [(93, "http://c/", None), (93, "http://c/", ""), (None, "http://c/2", "<p>only words of one page here</p>"), (94, "http://d/", "x " * 9)]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "page_id long, url string, html string, page long, host long").repartition(5)
    got = maintext.main_text(docs)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert got == plain(rows)
    texts = {x[0]: x[2] for x in got}
    assert not any(menu in texts[i] for i in range(30) if i % 4) and all(menu in texts[i] for i in range(0, 30, 4))
    assert texts[92] == menu and texts[93] == ""
    assert maintext.main_text(docs.limit(0)).count() == 0
