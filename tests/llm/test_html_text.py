"""Main text of pages: the driver's pages against their article element, and hand-made ones."""

import html
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from balanza.llm import html_text as H
from balanza.llm.queries import QUERIES


def article(page):
    body = re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n".join(b for b in blocks if b)


def test_query(spark, sf_dir):
    pages = {r["page_id"]: r for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()}
    got = QUERIES["op9_html_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.text, r.url, r.n_chars) == (article(pages[r.page_id]["html"]), pages[r.page_id]["url"], len(r.text))


LONG = "This paragraph has enough plain words in a row to count as the text of an article, more than a menu."
CASES = [
    ("", ""), ("plain words without any markup", "plain words without any markup"), ("<p>a<p>b", "a\nb"),
    (f"<div><a href=1>Home</a></div><div><a href=2>News</a></div><div><a href=3>Mail</a></div><div><a href=4>Shop</a></div><div>{LONG}</div><p>Yes.</p><p>{LONG}</p>", f"{LONG}\nYes.\n{LONG}"),
    (f"<article><header><h1>T&eacute;</h1></header><p>x &lt;b&gt;\n\t&#x41;&nbsp;y</p><form>no</form><aside>no</aside><p>z</article><footer>no</footer>", "Té\nx <b> A y\nz"),
    (f"<header>no</header><main><p>{LONG}</p><div class='comments'><p>{LONG}</p></div></main>", LONG),
    (f"<main><p class=ad>no<p>{LONG}<br>{LONG[:20]}<script>if (a < b) '</p>'</script><style>p</style></main>", f"{LONG} {LONG[:20]}"),
    (f"<body class='has-sidebar'><div id=cookieNotice>{LONG}</div><div class='post-header'>Title</div><p>{LONG}</p><div role=navigation>no</div>", f"Title\n{LONG}"),
    (f"<!-- <p>no</p> --><p title='a > b'>{LONG}</p><p hidden>no</p><![CDATA[x]]>", LONG),
    ("<article><p>a <b>bold <i>both</b></i> end</p><ul><li>1<li>2</ul><table><tr><td>c<td>d</table></article>", "a bold both end\n1\n2\nc\nd"),
    ("<nav>only</nav>", ""), ("<script>only", ""), ("a < b and <", "a < b and <"), ("<article></article>" + LONG, LONG), ("<p", ""),
]


@pytest.mark.parametrize("page,text", CASES)
def test_pages(page, text):
    assert H.main_text(page) == text


CARD = "<article><h3><a href=1>Another story</a></h3><p>In short.</p></article>"
ARTICLES = [
    (f"{CARD}{CARD}<div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div>{CARD}{CARD}", f"Head\n{LONG}\n{LONG}"),
    (f"<article><p>{LONG}</p></article><nav>no</nav><div><p>{LONG}</p><p>End.</p></div>", f"{LONG}\n{LONG}\nEnd."),
    (f"<article>{'<p>A short line of verse.</p>' * 6}</article><div>{LONG}</div>", "\n".join(["A short line of verse."] * 6 + [LONG])),
    (f"<p>By.</p><article><ul><li><a>1</a><li><a>2</a><li><a>3</a><li><a>4</a></ul><p>{LONG}</p></article><p>Menu</p>", f"1\n2\n3\n4\n{LONG}"),
    ("<article><a href=1>All of it is a link</a></article>", "All of it is a link"),
]


@pytest.mark.parametrize("page,text", ARTICLES)
def test_articles_do_not_hide_text_outside(page, text):
    assert H.main_text(page) == text


ADVERT = "<div class=ad>x</div>"
LINKS = "<ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(4)) + "</ul>"
INLINE = [
    (f"<div><p>{LONG}</p>{ADVERT}<p>Short end.</p></div>", f"{LONG}\nShort end."),
    (f"<body><p>{LONG}</p><aside>no</aside><p>Short end.</p><footer>no</footer></body>", f"{LONG}\nShort end."),
    (f"<div><div>{LONG}</div>{ADVERT}<div>Short end.</div></div>", f"{LONG}\nShort end."),
    (f"<div><p>{LONG}</p>{ADVERT}<figure><figcaption>Caption</figcaption></figure><form>no</form>{LINKS}{ADVERT}<p>End.</p></div>", f"{LONG}\nCaption\nLink 0\nLink 1\nLink 2\nLink 3\nEnd."),
    (f"<div><p>Menu</p></div><nav>no</nav><div><p>Lead.</p>{ADVERT}<p>{LONG}</p></div>{ADVERT}<div><p>Some company</p></div>", f"Lead.\n{LONG}"),
    (f"<section><p>{LONG}</p><article>Quoted.</article><p>Short end.</p></section>", f"{LONG}\nQuoted.\nShort end."),
]


@pytest.mark.parametrize("page,text", INLINE)
def test_adverts_in_a_text_end_nothing(page, text):
    assert H.main_text(page) == text


FIELDS = "<input type=hidden name=v><input type=text name=q><select></select>"
JUDGED = [
    # a head that does not say where it ends
    (f"<html><head><title>t</title><meta charset=x><body><p>{LONG}</p></body></html>", LONG),
    (f"<head><style>p</style><script>s</script><p>{LONG}</p>", LONG),
    (f"<head><noscript><p>no</p></noscript><title>t</title></head><div>{LONG}</div>", LONG),
    # forms by what they hold
    (f"<body><form method=post>{FIELDS}<div>{f'<p>{LONG}</p>' * 6}</div></form></body>", "\n".join([LONG] * 6)),
    (f"<body><form>{FIELDS}<nav>no</nav><article><p>{LONG}</p></article></form></body>", LONG),
    (f"<div>{f'<p>{LONG}</p>' * 3}</div><form><p>Write us a line and leave your name, it will not be shown to anybody at all.</p>{FIELDS}</form>", "\n".join([LONG] * 3)),
    # names of topics, of comments, of what holds the page
    (f"<article class='post category-social'><p>{LONG}</p></article><div><p>Other</p></div>", LONG),
    (f"<article class='post'><p>{LONG}</p></article><article class='post comment'><p>{LONG}</p></article>", LONG),
    (f"<div class='page widget-page'>{f'<p>{LONG}</p>' * 10}<div class=share>no</div></div><p>Foot</p>", "\n".join([LONG] * 10)),
    # nothing but a notice, an advert, a menu
    (f"<body><div class='cookie-notice'><p>{LONG}</p></div></body>", ""), (f"<div class=ad>{LONG}</div>", ""), ("<div id=menu><a href=1>Home</a><a href=2>News</a></div>", ""),
    # a headline before the article
    (f"<div><h1>Headline</h1><article><p>{LONG}</p></article></div>", f"Headline\n{LONG}"),
    (f"<main2><h2>Kicker</h2><h1>Headline</h1></main2><nav>no</nav><main><p>{LONG}</p></main>", f"Kicker\nHeadline\n{LONG}"),
]


@pytest.mark.parametrize("page,text", JUDGED)
def test_what_is_judged_by_content(page, text):
    assert H.main_text(page) == text


def test_returned_names_are_not_kept(spark):
    pages = spark.createDataFrame([(1, "x", "y")], "page_id long, html string, text string")
    with pytest.raises(ValueError):
        H.extract_main_text(pages, keep=("page_id", "text"))


def test_surges_and_dives():
    weights = np.array([5, 0, 0, 0, 3, 90, 0, 40, 2, 0, 0, 0, 8, 0, 0, 0, 95, 1], dtype=float)
    assert H.spans(weights, 86) == [(4, 9), (16, 18)]
    assert H.spans(np.zeros(4), 86) == [] and H.spans(np.zeros(0), 86) == [] and H.spans(np.array([3.0]), 86) == [(0, 1)]


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>x"), (2, "u", "<div>" * 20000 + "deep"), (3, "u", "<" * 5000), (3, "u", "<" * 5000), (4, "u", f"<p>{'w ' * 200000}</p>")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract_main_text(pages).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, 1, 4, 5000, 5000, 399999])
    assert H.extract_main_text(pages.limit(0)).count() == 0
