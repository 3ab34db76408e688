import html
import re
import time

from tariffloom.llm.html_text import PLAIN, best_stretch, extract_text, learn_weights, main_text, op8_html_extraction, tokens

SF2 = "/root/testdata/sf0.01"


def article(page):
    """The pages of the fixture have one template, so a plain pattern finds the article."""
    inner = re.search(r"<article>(.*)</article>", page, re.DOTALL).group(1)
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner).replace("<br>", " "))
    return "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_against_the_marked_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF2}/pages.parquet").collect()}
    rows = op8_html_extraction(spark, SF2).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


PAGE = """<html><head><title>T</title><script>if (a < b) { x = "</p>" }</script></head><body class="home">
<header><h2>Site name</h2></header><div id="cookie-notice">We use cookies, do you mind?</div><ul class='main-menu'><li>One<li>Two</ul>
<article><header><h1>A &lt;title&gt; &amp;amp; more</h1></header><p>First&nbsp;para  with <b>bold</b>face<br>and a line.</p>
<div class="ad-box"><p>Buy now buy now</div><p>Second &eacute; para.<!-- no --></p><form><p>Name <input></form>
<ul><li>point one of the list with some words</li><li>point two</li></ul><p>End of it all.</article>
<section class="comments"><p>%s</p></section><aside>more</aside><footer>(c)</footer></body></html>""" % ("I think so too. " * 60)


def test_noise_is_left_out(spark):
    weights = learn_weights(spark.read.parquet(f"{SF2}/pages.parquet"))
    text = "A <title> &amp; more\nFirst para with boldface and a line.\nSecond é para."
    for w in (weights, PLAIN):
        assert main_text(PAGE, w) == text + "\npoint one of the list with some words\npoint two\nEnd of it all."


def test_stretch_against_brute_force():
    import random

    rng = random.Random(0)
    for _ in range(300):
        s = [rng.randint(-4, 4) for _ in range(rng.randrange(9))]
        best = max((sum(s[a:b]) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=0)
        a, b = best_stretch(s)
        assert sum(s[a:b]) == max(best, 0)


def test_odd_pages(spark):
    odd = [None, "", "   ", "plain words", "<p>", "<div><p>open", "a < b", "<script>never closed", "</p></div>x", "<p>" * 3000 + "deep", "<p a='>' b=\">\">q</p>", "&#x41;&bogus;&amp"]
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in enumerate(odd)] + [(None, None, "<p>n</p>", None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract_text(pages).collect()}
    assert [got[i] for i in range(12)] == ["", "", "", "plain words", "", "open", "a < b", "", "x", "deep", "q", "A&bogus;&"] and got[None] == "n"
    assert extract_text(pages.limit(0)).collect() == []
    assert [t.text for t in tokens("<style>p{}</style>a")[0]] == ["", "", "a"]


BODY = "<h2>On rivers</h2><p>The first paragraph says something about rivers and towns.</p><p>The second one goes on with it &amp; ends.</p>"
TEXT = "On rivers\nThe first paragraph says something about rivers and towns.\nThe second one goes on with it & ends."
MENU = "<ul class='menu'><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul>"
TEMPLATES = {
    "layout": f'<div class="layout has-sidebar"><article>{BODY}</article><div id="sidebar"><p>Most read</p></div></div>',
    "share": f'{MENU}<div class="post share-enabled">{BODY}</div><div class="share-buttons">Share this</div>',
    "form": f'<form id="aspnetForm">{MENU}<div>{BODY}</div><input name="q"></form>',
    "notice": f'<p class="notice">Site is read only today<p>{BODY}',
    "item": f'<ul><li class="share">Share it<li>{BODY}</li></ul>',
    "comments": f'<main>{BODY}</main><section id="comments"><p>{"I agree. " * 70}</p></section>',
    "table": f'<table><tr><td class="navigation">Home<td>{BODY}<tr><td class="ad">Buy<td></table>',
    "comment articles": f'<div class="post">{BODY}</div><ol class="comment-list">' + "".join(f'<li><article class="comment"><p>{"I think so too. " * 9}</p></article>' for _ in range(9)) + "</ol>",
    "comment article": f'<main>{BODY}</main><div class="comments"><article><h1>Reply</h1><p>{"No, not at all. " * 200}</p></article></div>',
    "cookie heading": f'<div class="cookie-notice"><h1>We value your privacy</h1><p>{"Accept this now. " * 9}</p></div><div>{BODY}</div>',
    "sidebar heading": f'<div>{BODY}</div><div class="sidebar"><h1>Most read</h1><p>{"A story of today. " * 9}</p></div>',
    "many comments": f'<div id="content">{BODY}</div><div id="comments"><p>{"Yes I agree with all. " * 120}</p></div>',
    "comments by": f'<article>{BODY}</article><section class="comments-by-readers"><p>{"Yes I agree with all. " * 120}</p></section>',
    "widget": f'<div class="elementor-widget"><article>{BODY}</article></div><div class="widget"><p>Tags and more</p></div>',
    "popup": f'<div class="page">{BODY}</div><div class="newsletter-popup"><article><h2>Join</h2><p>Get our letter every day of the week.</p></article></div>',
    "discussion": f'<article>{BODY}<div id="disqus_thread"><p>{"First one here. " * 40}</p></div></article>',
    "related": f'<article>{BODY}</article><section class="related-posts">' + "<article><h3>Another</h3><p>Its first words are these here.</p></article>" * 6 + "</section>",
    "promo": f'<div role="banner"><p>{"Big sale this week only. " * 30}</p></div><div role="main">{BODY}</div>',
    "sidebar layout": f'<div class="sidebar-layout"><div>{BODY}</div></div><p class="share">Share</p>',
    "only noise": f'<div class="widget">{BODY}</div>',
    "old": f'<center><font size=2><!-- x --><a name=top></a></font></center><div id=content>{BODY}</div><div class=\'footer\'>(c) us</div>',
}


def test_templates():
    for name, page in TEMPLATES.items():
        assert main_text(f"<html><head><title>t</title></head><body>{page}</body></html>", PLAIN) == TEXT, name


def test_scan_is_linear():
    start = time.process_time()
    for page in ("<a " * 350_000, "<a \"" * 250_000, "<a '\">" * 150_000, "<p>" * 300_000, "<div><p>x" * 100_000, "<b class=ad>" * 80_000 + "</i>" * 80_000, "</div>" * 150_000, "<li><ul>" * 100_000, "<!--" * 250_000, "<" * 500_000):
        main_text(page, PLAIN)
    assert time.process_time() - start < 60
