import random
import time

import pytest
from pyspark.sql import functions as F

from inkstrata.llm import html_extract as h


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("just &amp; text\n here", "just & text here"),
        ("<p>a<b>b</b>c<p>d<br>e", "abc d e"),
        ("<nav>menu</nav><header>top</header><article><header><h1>T</h1></header><p>x&nbsp;y &#233;&copy;</article><footer>f</footer>", "T x y é©"),
        ("<article><p>one</p><div class='comments'><p>first!</p></div><form>mail</form><p>two</p></article>tail", "one two"),
        ("<body><div id=cookie-notice>ok?</div><div class=content>c <script>if(a<b){'</p>'}</script>d</div>", "c d"),
        ("<body><main>m<aside>s</aside></main>out", "m"),
        ("<article><p>a <!-- <p>no</p> --> b</article>", "a b"),
        ("<article><ul><li>1<li>2</ul><table><tr><td>3<td>4<tr><td>5</table></article>", "1 2 3 4 5"),
        ("<article><p>cut off <b>here", "cut off here"),
        ("<article>1 < 2 and <p class=\"x>y\">q</p><p title='a", "1 < 2 and q"),
        ("<div class='sidebar'><article>teaser</article></div><article>real</article><article>more</article>", "real more"),
    ],
)
def test_extract(source, text):
    assert h.extract(source) == text


def site(i, body):
    return f"<html><body><div><a href=/>Home</a> of the site</div><div>{body}</div><section>All rights of the site</section></body></html>"


def test_site_template(spark):
    rows = [(i, f"http://one.example/{i}", site(i, f"Story number {i}")) for i in range(12)]
    rows += [(100, "http://two.example/", site(0, "lonely")), (101, None, None), (102, "http://[bad", "<p>x</p>"), (None, "http://one.example/x", site(0, "no id"))]
    rows += [(200 + i, "http://three.example/", site(0, "the same page")) for i in range(9)]
    rows += [(300 + i, f"http://four.example/{i}", f"<nav>{i}</nav><article><div><p>copied article</p></div></article>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for limit in (h.MAX_BROADCAST, 0):
        got = {r.page_id: r for r in h.main_texts(pages, limit).collect()}
        assert all(got[i].text == f"Story number {i}" for i in range(12))
        assert got[100].text == "Home of the site lonely All rights of the site"
        assert (got[101].text, got[101].n_chars, got[102].text) == ("", 0, "x")
        assert got[200].text == "Home of the site the same page All rights of the site"  # one page's copies are no template
        assert got[300].text == "copied article"
        assert got[None].text == "no id"
    assert h.main_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("marks", ['style="overflow:hidden"', 'title="The hidden valley"', 'data-hidden="false"', "data-x=/hidden/x", 'title="a class=ads b"', 'id="related-work"', 'class="market-share"'])
def test_values_are_no_attributes(marks):
    assert h.extract(f"<article><section {marks}><p>text</p></section><p>more</p></article>") == "text more"
    assert h.extract("<article><p hidden>no</p><p HIDDEN=''>no</p><div class='x Related'>no</div><p>text</p></article><p>out</p>") == "text"


@pytest.mark.parametrize("others", [0, 200])
def test_template_of_a_section_at_any_size_of_host(spark, others):
    rows = [(i, "http://one.example/", f"<div>Section notice</div><div>Story {i}</div>") for i in range(6)]
    rows += [(10 + i, "http://one.example/", f"<article><p>Told {i}</p><div>Join us</div></article>") for i in range(6)]
    rows += [(20 + i, "http://one.example/", f"<i>{i}</i><article><div>Copied</div><div>article</div></article>") for i in range(6)]
    rows += [(100 + i, "http://one.example/", f"<div>Other {i}</div>") for i in range(others)]
    got = {r.page_id: r.text for r in h.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert (got[i], got[10 + i], got[20 + i]) == (f"Story {i}", f"Told {i}", "Copied article")


def test_both_paths_serve_null_ids_alike(spark):
    rows = [(None if i % 2 else i, f"http://one.example/{i}", site(i, f"Story {i}")) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (h.MAX_BROADCAST, 0):
        assert sorted(r.text for r in h.main_texts(pages, limit).collect()) == sorted(f"Story {i}" for i in range(12))


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ('<article><p>Main text.</p></article><article class="comment"><p>Reader remark.</p></article>', "Main text."),
        ('<article><p>Main text.</p><article class="comment-body"><p>Reader remark.</p></article></article>', "Main text."),
        ('<article class="notice"><p>All there is</p></article>', "All there is"),
        ('<article><div class="search-results-story"><p>a</p></div><p class="share-prices">b</p><p id="reply-from-minister">c</p></article>', "a b c"),
        ("<body><form action=/><div><p>All of the page is in a form.</p></div></form></body>", "All of the page is in a form."),
        ("<form><article><p>x</p></article><input></form>", "x"),
        ("<body><p>Long enough a text</p><form><p>mail</p></form></body>", "Long enough a text"),
        (f"<body><div class=share-prices><p>{'Prices rose again. ' * 12}</p></div></body>", ("Prices rose again. " * 12).strip()),
        ("<body><p>a</p><div id=comment-list><p>remark</p></div><div class=cookie-bar>ok</div></body>", "a"),
        ("<article><p>told</p></article><article><a href=/>Read this next</a></article>", "told"),
        ("<article><div id=comments><p>remark</p></div><h2 id=comments>Comments on the law</h2></article>", "Comments on the law"),
        ("<p>&lt<b>;</b> &am<!-- -->p;</p>", "<; &amp;"),
        ("<p>&#x41;&nbsp;&nbsp;&copy</p>", "A ©"),
    ],
)
def test_meaning_of_marks(source, text):
    assert h.extract(source) == text


def test_nested_and_long_pages_are_linear():
    deep = "<div>" * 20_000 + "x" + "</div>" * 20_000
    wide = "<article>" + "<div><p>some words of a paragraph</p></div>" * 25_000 + "</article>"
    for source in (deep, wide, "<div><p>" + "word " * 200_000):
        start = time.perf_counter()
        h.extract(source, frozenset((1,)), "host")
        assert time.perf_counter() - start < 3 + 4 * len(source) / 1e6


def slow_template(pages):
    """Keys of the subtrees on MIN_PAGES pages of different content of their host, page by page."""
    seen = {}
    for _, url, source in pages:
        if source:
            page, host = h.Page(source), h.host_of(url)
            every = h.subtrees(page, host)
            rest = h.rests(page, [i for i, key in every if key & 1])
            for i, key in every:
                seen.setdefault((host, key), set()).add(rest[i] if key & 1 else source)
    return {key for (_, key), contents in seen.items() if len(contents) >= h.MIN_PAGES}


def test_counts_of_hosts_equal_a_recount(spark):
    rng = random.Random(7)
    blocks = [f"<div>block {k}</div>" for k in range(12)] + [f"<section><ul><li>{k}</li></ul></section>" for k in range(6)]
    rows = []
    for i in range(150):
        inside = "".join(rng.sample(blocks, 3)) + f"<article><p>story {rng.randrange(60)}</p>{rng.choice(blocks)}</article>" + rng.choice(blocks)
        rows.append((rng.choice([i, None]), f"http://{rng.choice('abc')}.example/{i}", inside if rng.random() > 0.05 else None))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wanted = slow_template(rows)
    assert len(wanted) > 20 and {r.key for r in h.templates(pages).collect()} == wanted
    texts = sorted(h.extract(source, wanted, h.host_of(url)) for _, url, source in rows)
    for limit in (h.MAX_BROADCAST, 0):
        assert sorted(r.text for r in h.main_texts(pages, limit).collect()) == texts


def test_digests_tell_markup_apart():
    page = h.Page("<div class=a><p>x y</p></div><div class=a> <p>x\n y</p> </div><div class=b><p>x y</p></div><div class=a><p>x</p>y</div><div class=a><p>x yz</p></div>")
    tops = [i for i, parent in enumerate(page.parent) if parent == 0]
    keys = [h.digests(page, 1)[i] for i in tops]
    assert keys[0] == keys[1] and len(set(keys)) == 4 and h.digests(page, 2)[tops[0]] != keys[0]
