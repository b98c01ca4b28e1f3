"""Main text extraction on hand-made pages and against the known layout of the test pages."""

import html
import re
import time

from pyspark.sql import functions as F

from tidemark.llm import html as web


def text(page):
    return "\n".join(t for t, _, _ in web.parse(page)["blocks"])


def test_parse():
    page = ('<html><head><title>T</title><script>var a="</p><article>";</script></head><body class="has-sidebar"><nav><ul><li>menu</ul></nav>'
            '<div class="cookie-notice">accept</div><article><header><h1>Head &amp; line</h1></header><p>One <b>two</b>\n three&nbsp;four'
            '<p>five<br>six<div class="share">tweet</div><ul><li>a<li>b</ul><section id="comments"><article><p>first!</p></article></section>'
            '</article><footer>(c)</footer>')
    assert text(page) == "Head & line\nOne two three four\nfive\nsix\na\nb"
    assert text(None) == text("") == "" and text("plain &lt;b&gt; text") == "plain <b> text"
    assert text("<p>cut &am") == "cut &am" and text("<p>cut &amp") == "cut &" and text('<p>a <a href="x') == "a"
    assert text('<p>a<a title="x>y">b</a></p><!-- no <p>x</p> -->') == "ab"


def test_names_are_whole_tokens():
    """Class and id words drop comment lists and site parts, never a page, an article, a heading or a paragraph."""
    for page in ("<body class='single comments-open'><article><p>x</p></article></body>", "<article class='post has-comments'><p>x</p></article>",
                 "<div class='commentary'><p>x</p></div>", "<div class='content no-sidebar'><p>x</p></div>", "<body class='comments'><p>x</p></body>",
                 "<article><h2 id='related-work'>x</h2></article>", "<article><section id='search-algorithms'><p>x</p></section></article>",
                 "<article><section id='search'><p>x</p></section></article>", "<article><p id='notice' class='notice'>x</p></article>",
                 "<p title='a hidden gem'>x</p>", "<article><p data-x=' hidden '>x</p></article>", "<article><div class='notice'>x</div></article>",
                 "<p title=\"class='comments'\">x</p>", "<div title=\"class='ad'\" hidden='until-found'>x</div>", "<main id='comments'><p>x</p></main>"):
        assert text(page) == "x", page
    for gone in ("<div class='post-foot comments'>y</div>", "<ol class='comment-list'><li><article><p>y</p></article></ol>", "<div id=disqus_thread>y</div>",
                 "<section id='comments'>y</section>", "<div hidden>y</div>", "<p hidden=''>y</p>", "<div class='x ad'>y</div>",
                 "<div style='display: none'>y</div>", "<p aria-hidden=true>y</p>", "<div title='z' HIDDEN>y</div>"):
        assert text(f"<p>x</p>{gone}") == text(f"<article><p>x</p>{gone}</article>") == "x", gone
    assert text("<div id='sidebar'>y</div><p>x</p>") == "x"


def test_known_layout(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in web.extract(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1)>|<br>", body)]
        assert got[r.page_id].text == "\n".join(p for p in parts if p)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_templates_per_host(spark):
    row = lambda i, host, extra="": (i, f"http://{host}/{i}", f"<body><div><p>Welcome to us</p></div><div><p>Story {i}</p>{extra}</div></body>", "x")
    rows = [row(i, "a.example") for i in range(6)] + [row(10, "b.example"), row(11, "b.example")]
    rows += [(20 + i, f"http://c.example/{i}", f"<article><p>Same.</p><div><p>Follow us</p></div><p>Own {i}</p></article>", "x") for i in range(5)]
    rows += [(40, None, None, "x"), (41, "http://a.example/", "", "x"), (0, *row(0, "a.example")[1:])]
    rows += [(50 + i, "http://d.example/x", "<article><div>Copied story</div></article>", "x") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    got = {}
    for r in web.extract(df).collect():
        got.setdefault(r.page_id, []).append(r.text)
    assert got[3] == ["Story 3"] and got[0] == ["Story 0"] * 2          # template of host a
    assert got[10] == ["Welcome to us\nStory 10"]                       # too few pages of host b
    assert got[22] == ["Same.\nOwn 2"]                                  # in articles only parts go, paragraphs stay
    assert got[55] == ["Copied story"]                                  # copies of one article are one
    assert got[40] == got[41] == [""]
    assert web.extract(df.limit(0)).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string").repartition(3)
    return [r.text for r in web.extract(df).orderBy("page_id").collect()]


def test_near_copies_stay_whole(spark):
    """Near copies that differ in the title keep their body, in one part or in several; a true template still goes."""
    url = "http://{}.example/{}".format
    pages, want = [], []
    for k in range(3):
        pages.append((url("one", k), f"<article><h1>Title {k}</h1><div><p>same body</p></div></article>"))
        want.append(f"Title {k}\nsame body")
        pages.append((url("parts", k), f"<article><h1>Title {k}</h1><div>{''.join(f'<section><p>part {n} of the body</p></section>' for n in range(3))}</div></article>"))
        want.append("\n".join([f"Title {k}", *(f"part {n} of the body" for n in range(3))]))
        pages.append((url("bare", k), f"<body><h1>Title {k}</h1><div><p>{'the same long body of a story ' * 4}</p></div></body>"))
        want.append(f"Title {k}\n{('the same long body of a story ' * 4).strip()}")
        pages.append((url("true", k), f"<article><h1>Title {k}</h1><p>{'own ' * 20}{k}</p><div><p>Follow us</p></div></article>"))
        want.append(f"Title {k}\n{'own ' * 20}{k}")
    assert extracted(spark, pages) == want


def test_block_of_a_section_on_a_large_host(spark):
    """A block on 20 of a host's 100 pages goes, in articles and without; a paragraph on as many stays."""
    block = "<div><p>Subscribe to the travel section</p><ul><li>Offers</ul></div>"
    pages, want = [], []
    for k in range(100):
        story = f"Story {k} " + "tells something else " * 5 + str(k)
        for host, head, tail in (("a", "<article>", "</article>"), ("b", "<body>", "</body>")):
            pages.append((f"http://{host}.example/{k}", f"{head}<p>{story}</p><p>Yes.</p>{block if k < 20 else ''}{tail}" if k < 25 else
                          f"{head}<p>{story}</p>{tail}"))
            want.append(f"{story}\nYes." if k < 25 else story)
    assert extracted(spark, pages) == want


def test_joined_templates_equal_broadcast_ones(spark):
    """The way for more templates than are sent to every task gives the same rows, copies and nulls included."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    pages = pages.union(pages.limit(20)).union(spark.createDataFrame([(-1, None, None), (-2, "http://a/", None)], pages.schema))
    sent, joined = (sorted(map(tuple, web.extract(pages, most_sent=m).collect())) for m in (web.MOST_SENT, -1))
    assert sent == joined and len(sent) == pages.count()


def test_counts_delete_what_no_mark_names(spark):
    """A plain block put on half of the test pages of one host, in the article or outside, goes by the counts alone."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(
        "page_id", F.lit("http://one.example/").alias("url"), "html").where("html like '%</article>%'")
    block = "<div><p>Read the weekly letter</p><ul><li>Offers<li>Terms</ul></div>"
    for at in ("</article>", "<article>"):
        put = pages.withColumn("html", F.when(F.col("page_id") % 2 == 0, F.replace("html", F.lit(at), F.lit(block + at))).otherwise(F.col("html")))
        want = {r.page_id: (r.text, r.n_cut) for r in web.extract(pages).collect()}
        got = {r.page_id: (r.text, r.n_cut) for r in web.extract(put).collect()}
        inside = at == "</article>"
        assert {k: t for k, (t, _) in got.items()} == {k: t for k, (t, _) in want.items()}
        assert all(n - want[k][1] == (3 if inside and k % 2 == 0 else 0) for k, (_, n) in got.items())


def test_deep_and_odd_pages_are_linear():
    start = time.perf_counter()
    assert text("<div>x" * 50000) == "\n".join("x" * 50000)
    assert text("<p>a" + "<i>" * 50000 + "</b>" * 50000 + "z</p>") == "az"
    assert text("<ul><li>a" + "<i>" * 50000 + "<div></div>" * 50000) == "a"
    assert text("<nav>" + "<div>y" * 50000 + "</div>" * 50000 + "</nav>x") == "x"
    assert time.perf_counter() - start < 20


def test_subtree_hashes():
    """Equal subtrees hash alike wherever they stand; other texts, tags or orders do not."""
    def hashes(html):
        return web.parse(html)["hashes"]
    one = "<div><p>a</p><ul><li>b<li>c</ul></div>"
    assert hashes(one) == hashes(f"<body>{one}</body>") and set(hashes(one)) < set(hashes(f"<section>{one}d</section>"))
    assert len({hashes(h)[0] for h in (one, one.replace("a", "x"), one.replace("div", "section"), "<div><ul><li>b<li>c</ul><p>a</p></div>")}) == 4
    page = web.parse("<nav><ul><li>menu</ul></nav><div class=ad>buy</div><p>x</p>")
    assert [t for t, *_ in page["blocks"]] == ["x"] and [t for t, *_ in page["marked"]] == ["menu", "buy"]
    assert all(p < k for k, p in enumerate(page["up"]))
