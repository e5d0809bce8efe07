import random
import re
from html import escape

import pytest

from wayfarer.llm import main_text as M

TEXT = "The road to the village is long and it was built by the people of the valley in the days of the old king."


def test_article_of_the_tables_against_a_plain_version(spark, sf):
    got = {r.page_id: r for r in M.op12_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        body = re.search(r"<article>(.*?)(</article>|\Z)", page.html, re.S)[1]
        blocks = [re.sub(r"<[^>]*>", " ", b) for b in re.split(r"</?(?:p|h1)>", body)]
        blocks = [" ".join(re.sub("&amp;?", "&", b.replace("&quot;", '"').replace("&#x27;", "'")).split()) for b in blocks]
        text = "\n".join(b for b in blocks if b)
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (text, len(text), page.url)


FRAME = """<!doctype html><html><head><title>t</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header class="site"><a href="/">Home</a> Best page</header><nav><ul><li><a href="/a">A</a><li><a href="/b">B</a></ul></nav>
<div class="cookie-notice">We use cookies and so do they, as is the custom of the house and of the web in all of the lands.</div>
%s
<aside><p>%s</p></aside><div id="sidebar"><p>%s</p></div><form><label>Name</label><input value="x"><button>Send</button></form>
<section id="comments"><article class="comment"><p>%s</p></article></section><footer>&copy; us</footer></body></html>"""


@pytest.mark.parametrize("opening, closing", [("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ('<div role="main">', "</div>"), ("<article>", "")])
def test_text_without_its_frame(opening, closing):
    body = f"""{opening}<h1><a href="/x">A   title &amp; more</a></h1><p>{TEXT * 3}<p>Short one.<!-- <p>hidden</p> --></p><p>{TEXT * 2} <b>bold</b>text <a href="/y">link</a></p>
    <div class="ad">Buy it now and be happy.</div><div class="header-image">Kept caption of the header of it all.</div><h2>Next</h2><p>{TEXT * 3}</p>{closing}"""
    lines = M.extract(FRAME % (body, TEXT * 4, TEXT * 4, TEXT * 4)).split("\n")
    kept = ["A title & more", TEXT * 3, "Short one.", f"{TEXT * 2} boldtext link", "Next", TEXT * 3]
    assert [x for x in lines if not x.startswith("Kept")] == [" ".join(x.split()) for x in kept]


def test_short_blocks_go_with_the_nearest_decided_ones():
    page = f"<body><div>Tiny one</div><div><a href='/1'>One</a> <a href='/2'>Two</a></div><h1>Title</h1><div>{TEXT * 3}</div><div>Short in between</div><div>{TEXT * 3}</div><div>Tail by far</div><div><a href='/3'>Three and four</a></div></body>"
    assert M.extract(page).split("\n") == ["Title", TEXT * 3, "Short in between", TEXT * 3, "Tail by far"]
    blocks = [M.Block(t, n, False, False, 0, 0) for t, n in [(TEXT * 3, 0), ("Short", 0), ("Link", 4)]]
    assert M.first_pass(blocks) == [M.GOOD, M.SHORT, M.BAD]
    assert M.second_pass(blocks, [M.GOOD, M.SHORT, M.BAD]) == [True, True, False]


def test_references_white_space_and_odd_markup():
    inside = lambda s: M.extract(f"<article><p>{s}</p></article>")
    assert inside("a&nbsp;&lt;b&gt; &#x41;&#66; &amp;lt; &unknown; &copy 2") == "a <b> AB &lt; &unknown; © 2"
    assert inside("one<br>two<br/><br>three\n\t four") == "one two\nthree four"
    assert inside("1 < 2 and <> 3 </ > x") == "1 < 2 and <> 3 x"
    assert inside('<span title="a > b">x</span><span class=\'ad\'>buy</span> y') == "x\ny"
    assert inside('it\'s <b class="q>odd</b> here') .startswith("it's")
    assert M.extract("<article><p>whole<p class='notice'>go<p>stay<script>x</article>") == "whole\nstay"
    assert M.extract("<article><p>cut off <a href") == "cut off"
    assert M.extract("<article><table><tr><td>a<td>b<tr><td>c</table></article>") == "a\nb\nc"
    assert M.extract("<article><p hidden>no</p><p style='display: none'>no</p><ul><li><a href=/1>only links here</a></ul><p>%s</p></article>" % TEXT) == TEXT
    assert M.extract("") == M.extract("<nav>x</nav>") == ""


def test_any_markup_ends_and_linear_time():
    rng = random.Random(3)
    pieces = ["<", ">", "</", "<p>", "</p>", "<a href='", '"', "<div class=ad>", "</div>", "<!--", "-->", "<script>", "</script>", "x y ", "&amp", "<article>", "</article>", "<br>", "<li>", "<td>"]
    for _ in range(1500):
        M.extract("".join(rng.choice(pieces) for _ in range(30)))
    for unit in ('<a "', "<!--x", "<div>", "</div>", "<p>", "<a href=x>", "&", "<", "</", "<b class='x", "<script>"):
        M.extract(unit * 60_000)


def test_odd_rows(spark):
    long = "<article>" + f"<p>{escape(TEXT)}</p>" * 20_000
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, f"<article><p>{TEXT}", "t"), (2, "u", long, "t"), (2, "u", long, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in M.main_texts(df).collect()))
    whole = "\n".join([TEXT] * 20_000)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (0, "", TEXT, len(TEXT)), (2, "u", whole, len(whole)), (2, "u", whole, len(whole))])
    assert M.main_texts(df.where("false")).count() == 0
