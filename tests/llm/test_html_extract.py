import html
import random
import re
from itertools import product

from paperloom.llm.html_extract import blocks, extract, main_text, minimum_cut
from tests.llm.helpers import crowded

SCHEMA = "page_id long, url string, html string"
PROSE = "The committee met on Tuesday, and after a long debate it agreed to publish the full report."


def article(page):
    """What stands in the article of a page of the corpus, block by block."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", inner)
    parts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", x))).strip() for x in parts]
    return "\n".join(x for x in parts if x)


def test_corpus_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    got = extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_boilerplate_of_many_kinds_goes():
    good = [PROSE, "A second paragraph follows, with more details about the vote.", "Short one."]
    page = f"""<!doctype html><html><head><title>T</title><script>var a="</p><p>x";</script></head><body class="post-page">
    <header class="site"><a href="/">Home</a> My site</header><nav><ul><li><a href="a">A</a><li><a href="b">B</a></ul></nav>
    <div id="cookie-notice">We use cookies to make this site better for everyone. Accept them, please.</div>
    <main><article><header><h1>Title &amp; more</h1></header><p>{good[0]}<p>{good[1]}
    <div class="ad-box">Buy our wonderful things today, they are cheap and good.</div><p>{good[2]}</p><form><label>Your mail</label><input></form></article>
    <section class="comments"><h2>3 comments</h2><p>I think that this is a very good article, thank you for writing it!</p></section></main>
    <aside>Related: <a href="x">{PROSE}</a></aside><footer>&copy; someone, all rights reserved.</footer></body></html>"""
    assert main_text(page).split("\n") == ["Title & more", *good]


def test_pages_without_semantic_elements():
    links = "".join(f'<div><a href="{i}">Link number {i}</a></div>' for i in range(8))
    page = f"<div>{links}</div><div><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p></div><div>{links}</div>"
    assert main_text(page).split("\n") == [PROSE, "Short.", PROSE]


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "plain words without any markup, but some."), (5, "u", "<p"), (None, "u", "<p>a &lt;b&gt; &#233; &am"), (6, "u", "<p>" + "word, " * 50000), (6, "u", '<a href="x>never closed'), (7, "u", "<nav>only menus</nav>"), (8, "u", "<article><p>a\n\t b&nbsp;c<br>d<!-- x --><b>e</b>f</article>")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.page_id or 0, r.text) for r in extract(crowded(df)).collect()), key=lambda x: (x[0], len(x[1])))
    text = [t for _, t in got]
    assert text[0] == "a <b> é &am" and text[1:4] == ["", "", ""] and text[4] == rows[3][2]
    assert text[-1] == "a b c def" and text[-2] == "" and len(text) == 10
    assert extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_minimum_cut_against_all_cuts():
    rng = random.Random(7)
    for _ in range(300):
        n = rng.randint(1, 7)
        source, sink = ([rng.randint(0, 9) for _ in range(n)] for _ in range(2))
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(1, 6)) for _ in range(rng.randint(0, 10))]
        edges = [e for e in edges if e[0] != e[1]]

        def cost(side):
            return sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])

        got = minimum_cut(source, sink, edges)
        assert cost(got) == min(map(cost, product([False, True], repeat=n)))


def test_smoothness_carries_a_short_block():
    page = f"<div><p>{PROSE}</p><p>and so</p><p>{PROSE}</p></div>"
    assert "and so" in main_text(page) and len(blocks(page)) == 3


def test_notices_and_hidden_text_inside_an_article():
    page = "<article><h1>Title of it</h1><p>A first paragraph that says something, at length.</p><p class='cookie-notice'>We use cookies on this site.</p><p class=\"advert\">Buy now, pay later.</p><p hidden>Not to be seen.</p><p>The second paragraph<span style='display: none'> secret <span>words</span></span> goes on <b class='promo'>50 % off</b>here.</p></article>"
    assert main_text(page) == "Title of it\nA first paragraph that says something, at length.\nThe second paragraph goes on here."


def test_long_pages_take_seconds():
    import time

    page = "<body>" + "".join(f"<div><p>Paragraph {i} says a good deal, and then some more.</p></div><p><a href=x>link {i}</a></p>" for i in range(25_000)) + "</body>"
    began = time.time()
    assert main_text(page).count("\n") > 20_000
    assert time.time() - began < 30
