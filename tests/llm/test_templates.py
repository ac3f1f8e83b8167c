"""Article texts of small pages, and template removal by what recurs on a host."""

import random
from collections import Counter

import pytest

from lemmaforge.llm.templates import Page, extract_articles, template_hashes

PAGES = {
    "<p>a<p>b": "a\n\nb",
    "": "",
    "plain &amp; simple": "plain & simple",
    "<article><h1>T &lt;1&gt;</h1><p><b>one<br>two<p>three  \n four</article><footer>f": "T <1>\n\none two\n\nthree four",
    "<nav><a>menu</a></nav><article>x</article><article class='comment'>no</article><aside>s</aside>": "x",
    "<article><header><h1>Head</h1></header><header>site</header><div class='share-box'>s</div><p>y</p></article>": "Head\n\ny",
    "<article><p>a</p><script>var x='</p><p>no';</script><!-- <p>no --><style>p{}</style><form>f</form><p>b": "a\n\nb",
    "<main><p>m</p><div id=comments><p>c</p></div></main><p>out": "m",
    "<body class='no-sidebar'><div role=navigation>n</div><p hidden>h</p><p style='display: none'>h</p><p>k": "k",
    "<article><ul><li>1<li>2</ul><table><tr><td>a<td>b<tr><td>c</table></article>": "1\n\n2\n\na b\n\nc",
    "<article>a < b <i>c</i>d &copy &am; é</article>": "a < b cd © &am; é",
    "<article><p title=\"x > y\">q</p><p title='odd>r</p></article>": "q\n\nr",
    "<article><p>cut <b": "cut",
    "</p></div>t": "t",
    "<article class='comment-policy'><p>how we moderate</p></article>": "how we moderate",
    "<article class='post-comment'><p>one text</p></article>": "one text",
    "<article><div class='widget-history'><p>the long story of the widget</p></div></article>": "the long story of the widget",
    "<article><p>the text</p></article><article class='post-comment'><p>a reader</p></article>": "the text",
    "<article><p>the whole story is told here</p><div class='share-box'>share</div></article>": "the whole story is told here",
    "<article><div class='sidebar'><p>a long side text that is no story</p></div><p>story</p></article>": "story",
    "<title-bar>bar</title-bar><p>after it</p>": "bar\n\nafter it",
    "<style-guide>x</style-guide><article><p>kept</p></article>": "kept",
}


@pytest.mark.parametrize("page", PAGES)
def test_page(page):
    assert Page(page).text(frozenset()) == PAGES[page]


def plain_templates(pages, least_pages=5, least_share=0.2):
    """Hashes that recur on a host, counted page by page."""
    rows = Counter((host, html) for host, html in pages)
    hosts = Counter(host for host, _ in rows)
    seen, whole, copies = Counter(), set(), Counter()
    for (host, html), n in rows.items():
        page = Page(html)
        for h in {*page.hashes()} - {0}:
            seen[host, h] += 1
            copies[host, h] += n
            whole |= {(host, h)} if page.whole else set()
    out = {}
    for (host, h), n in seen.items():
        least = least_pages if (host, h) in whole else min(least_pages, hosts[host])
        if copies[host, h] >= least_pages and n >= least and n >= least_share * hosts[host]:
            out.setdefault(host, set()).add(h)
    return out


def test_counts_of_templates(spark):
    rng = random.Random(4)
    parts = ["<div>share this page</div>", "<nav><a>menu</a></nav>", "<ul><li><a href=/>home</a></ul>", "<div class=x><p>about us</p></div>", "<footer>(c) all</footer>"]
    pages = []
    for host in ("a", "b", "c"):
        for i in range(rng.choice([3, 30, 60])):
            held = "".join(p for p in parts if rng.random() < rng.choice([0.1, 0.5]))
            body = f"<p>own text {i % 20} of {host}</p>"
            pages.append((host, held + (f"<article>{body}</article>" if rng.random() < 0.5 else body)))
    df = spark.createDataFrame(pages, "_host string, html string").repartition(5)
    got = {r._host: set(r._template) for r in template_hashes(df).collect()}
    assert got == plain_templates(pages) and got


def test_template_of_a_host(spark):
    box, tail = "<div><span>Buy now</span> at our shop</div>", "<div>(c) all of us</div>"
    rows = [(i, f"http://a.org/{i}", f"{box}<p>own {i}</p>{tail}") for i in range(20)]
    rows += [(100 + i, "http://b.org/", f"{box}<p>other {i}</p>") for i in range(3)]
    rows += [(200 + i, "https://A.org:80/x", "<article><p>shared</p><div>share it</div></article>") for i in range(8)]
    rows += [(300, None, None), (301, None, "<p>t"), (None, "no host", ""), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as _host")
    got = sorted(((r.page_id, r.text) for r in extract_articles(df).collect()), key=repr)
    want = [(i, f"own {i}") for i in range(20)] + [(0, "own 0"), (300, ""), (301, "t"), (None, "")]
    want += [(100 + i, f"Buy now at our shop\n\nother {i}") for i in range(3)]
    want += [(200 + i, "shared") for i in range(8)]
    assert got == sorted(want, key=repr)
    assert extract_articles(df.limit(0)).count() == 0


def texts_of(spark, pages):
    df = spark.createDataFrame([(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return [r.text for r in extract_articles(df.repartition(3)).orderBy("page_id").collect()]


def test_copies_and_recurring_passages_stay(spark):
    said = "<p>a passage that many pages quote</p>"
    menu = "<ul><li><a href=/>Home</a><li><a href=/x>News</a></ul><div>(c) us</div>"
    pages = [f"<h1>t{i}</h1>{menu}<div><p>own text of page {i}</p>{said if i % 3 == 0 else ''}</div>" for i in range(20)]
    copy = f"<h1>copied</h1>{menu}<div>bare text</div><div><p>of five copies</p></div>"
    got = texts_of(spark, pages + [copy] * 5)
    want = [f"t{i}\n\nown text of page {i}" + ("\n\na passage that many pages quote" if i % 3 == 0 else "") for i in range(20)]
    assert got == want + ["copied\n\nbare text\n\nof five copies"] * 5


def test_inline_phrases_of_an_article_stay(spark):
    pages = [f"<article><p><b>As we said</b> in {i}, <a>see here</a> <em>now</em>.</p><div><span>bare</span> {i}</div><div>share it</div></article>" for i in range(10)]
    assert texts_of(spark, pages) == [f"As we said in {i}, see here now.\n\nbare {i}" for i in range(10)]
