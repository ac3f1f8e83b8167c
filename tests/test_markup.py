"""Nodes, selectors, texts, blocks, page Markdown, cascade."""

import pyarrow as pa
from pyspark.sql import functions as F

from lemmaforge.functions.markup import SLICE, register_html_nodes, slices
from lemmaforge.operators import nodes as N
from lemmaforge.operators import render as R
from lemmaforge.operators import style as S
from lemmaforge.plans import page_queries as P
from tests.conftest import rows


def nodes_of(spark, *htmls):
    df = spark.createDataFrame([(i, "d", h) for i, h in enumerate(htmls, 1)], "rec_id long, dict_id string, content string")
    return N.html_nodes(df).cache()


def test_selectors(spark):
    nodes = nodes_of(spark, '<div class="a b" id="top"><p data-k="one two"><span class="c">x</span></p></div><span class="c">y</span>')
    for raw, n in [
        ("span", 2), (".a.b", 1), ("#top", 1), ("div .c", 1), ("div p span.c", 1), ("p .a", 0), ("[data-k]", 1), ("[data-k^=one]", 1),
        ("[data-k$=two]", 1), ("[data-k*=e]", 1), ("[data-k=one]", 0), ("p, .c", 3), ("p[, .c", 2), ("", 0),
    ]:
        assert N.matching(nodes, raw).count() == n, raw
    nested = nodes_of(spark, "<div><div><div>x</div></div></div><div>y</div>")
    assert N.outermost(nested, "div").count() == 2
    assert N.visible_text(N.without(nodes, "p")).first()["text"] == "y"
    assert N.visible_text(N.scoped(nodes, "div", ".none")).first()["text"] == "x"


def test_text_joining(spark):
    cases = {
        "<i>still</i><b>water</b>": "still water",
        "<i>tarn</i><b>s</b>": "tarns",
        "<i>tarn</i><b>'s edge</b>": "tarn's edge",
        "<i>山</i><b>中</b>": "山中",
        "<i>(</i><b>deep</b><i>)</i>": "(deep)",
        "<p>one</p><p>two</p>": "one two",
        "a<span style='display: none'>hidden</span>b": "a b",
        "x<script>var p='</p>'</script>\u00a0\u200by": "x y",
    }
    nodes = nodes_of(spark, *cases)
    assert [t for _, t in rows(N.visible_text(nodes), "rec_id", "text")] == list(cases.values())


def test_blocks_and_tables(spark):
    nodes = nodes_of(spark, '<h2>Head</h2><p>text <img src="a.png"></p><img src="a.png"><ul><li>item</li></ul><table><tr><th>k<th>v<tr><td>1<td>2</table>')
    assert rows(N.rich_blocks(nodes), "ord", "kind", "text", "ref") == [
        (1, "heading", "Head", ""), (2, "text", "text", ""), (3, "image", "", "a.png"), (4, "list_item", "item", ""), (5, "table", "", ""),
    ]
    grid = N.rich_blocks(nodes).filter("kind = 'table'").first()
    assert (grid.header, grid.rows) == (["k", "v"], [["1", "2"]])
    assert rows(N.tables(nodes), "is_header", "cells") == [(False, ["1", "2"]), (True, ["k", "v"])]


def test_rich_blocks_keep_items_tables_and_images_whole(spark):
    nodes = nodes_of(
        spark,
        "<div>a<br>b<img src=' '><img data-src='x.png' title='X'>c<b>d</b></div><ul><li>one<ul><li>deep <img src='n.png'></li></ul></li></ul>",
        "<table><tr><td>1<td>2<tr><th>h</table><table></table><p hidden>z</p><script>no</script><h3> </h3>",
        "<p>漢<i>字</i></p><p style='display:none'>gone</p>",
        "",
    )
    assert rows(N.rich_blocks(nodes), "rec_id", "ord", "kind", "text", "ref", "alt", "header", "rows") == [
        (1, 1, "text", "a", "", None, None, None), (1, 2, "text", "b", "", None, None, None), (1, 3, "image", "", "x.png", "X", None, None),
        (1, 4, "text", "c d", "", None, None, None), (1, 5, "list_item", "one deep", "", None, None, None),
        (2, 1, "table", "", "", None, ["h"], [["1", "2"]]), (2, 2, "text", "z", "", None, None, None),
        (3, 1, "text", "漢字", "", None, None, None),
    ]


def test_page_markdown(spark):
    cases = {
        "<p><b>noun</b> <i>pl</i></p><h2>Head *x*</h2>text<br>more": "**noun** *pl*\n\n## Head \\*x\\*\n\ntext  \nmore",
        "<ul><li>one</li><li>two<ul><li>deep</li></ul></li></ul>": "- one\n- two\n  - deep",
        "<p><span>noun</span><span>Plural</span> tarns</p>": "noun Plural tarns",
        "<p><span>tarn</span><sup>2</sup> <span>mo</span>or</p>": "tarn2 moor",
        '<p>see <a href="https://e.invalid/x">there</a> and <a href="#top">top</a></p>': "see [there](https://e.invalid/x) and top",
        "<p>a<!-- c --></p><form>gone</form><p style='visibility:hidden'>gone</p>": "a",
    }
    got = dict(rows(R.page_markdown(nodes_of(spark, *cases)), "rec_id", "markdown"))
    assert [got[i] for i in range(1, len(cases) + 1)] == list(cases.values())


def test_cascade(spark):
    cases = [
        ("span.a{display:none} .a{display:inline}", '<p><span class="a">x</span></p>', "none"),
        (".a{display:none} .a{display:inline}", '<p><span class="a">x</span></p>', "inline"),
        (".a{display:none!important} #b.a{display:inline}", '<p><span id="b" class="a">x</span></p>', "none"),
        (".a{display:none}", '<p><span class="a" style="display:inline">x</span></p>', "inline"),
        (".n+.a{display:none}", '<p><span class="n">1</span><span class="a">x</span></p>', "none"),
        ("p>.a{display:none}", '<p><i><span class="a">x</span></i></p>', None),
        ("@media (max-width:9px){.a{display:none}} @media screen{.a{display:block}}", '<p><span class="a">x</span></p>', "block"),
        (".a:hover{display:none}", '<p><span class="a">x</span></p>', None),
        ("h1 ~ .a{display:none}", '<h1>1</h1><i>2</i><p class="a">x</p>', "none"),
        (".a ~ h1{display:none}", '<h1>1</h1><p class="a">x</p>', None),
        ("div h1 + p i + .a{display:none}", '<div><h1>1</h1><p><i>2</i><b class="a">x</b></p></div>', "none"),
        ("div > h1 + p ~ .a{display:none}", '<div><h1>1</h1><p>2</p><p>3</p><b class="a">x</b></div>', "none"),
        ("div h1 + .a{display:none}", '<div><h1>1</h1><i>2</i><p class="a">x</p></div>', None),
        ("p:first-child{display:none}", '<div><p>1</p><p class="a">x</p></div>', None),
        ("p:last-child{display:none} p:nth-child(2){display:block}", '<div><p>1</p><p class="a">x</p></div>', "block"),
        ("li:nth-child(odd) .a{display:none}", '<ul><li>1</li><li>2</li><li><b class="a">x</b></li></ul>', "none"),
        ("p:not(.b):only-child{display:none}", '<div><p class="a">x</p></div>', "none"),
        ("p:not(.a){display:none} p:first-line{display:none}", '<div><p class="a">x</p></div>', None),
        (".a::-webkit-scrollbar, .a{display:none}", '<p><span class="a">x</span></p>', "none"),
    ]
    data = [(i, f"d{i}", html) for i, (_, html, _) in enumerate(cases)]
    nodes = N.html_nodes(spark.createDataFrame(data, "rec_id long, dict_id string, content string")).cache()
    sheets = spark.createDataFrame([(f"d{i}", 0, css) for i, (css, _, _) in enumerate(cases)], "dict_id string, sheet_ord int, css string")
    won = S.cascade(nodes, S.css_rules(sheets))
    at = nodes.filter(F.array_contains("classes", "a")).select("rec_id", "pre")
    got = dict(rows(won.join(at, ["rec_id", "pre"]).filter("property = 'display'"), "rec_id", "value"))
    assert [got.get(i) for i in range(len(cases))] == [want for *_, want in cases]
    assert {s for _, s in rows(S.unread_selectors(sheets), "rule_ord", "selector")} == {".a:hover", "p:first-line", ".a::-webkit-scrollbar"}


def test_visibility_and_generated_text(spark):
    css = ".h{visibility:hidden} .v{visibility:visible} .x:before{content:\"\\2022  \"} .t:before{content:'T';float:right} .i:after{content:\"\\e900\"}"
    nodes = nodes_of(spark, '<div class="h">gone<span class="v">kept</span></div><p class="x">tie</p><p class="t">t</p><p class="i">i</p>')
    won = S.cascade(nodes, S.css_rules(spark.createDataFrame([("d", 0, css)], "dict_id string, sheet_ord int, css string")))
    hidden = S.inherited_visibility(nodes, won).filter("hidden").join(nodes, ["rec_id", "pre"])
    assert rows(hidden, "text") == [("gone",)]
    assert [t.strip() for (t,) in rows(S.generated_text(nodes, won), "text")] == ["•"]
    gone = S.display_hidden(nodes, S.cascade(nodes, S.css_rules(spark.createDataFrame([("d", 0, ".h{display:none}")], "dict_id string, sheet_ord int, css string"))))
    assert N.visible_text(gone).first()["text"] == "tie t i"


def test_nodes_are_a_table_function_of_sql(spark):
    register_html_nodes(spark)
    df = spark.createDataFrame([(1, '<div id="a" class="x y">t<br><img src=s></div>'), (2, ""), (3, None)], "rec_id long, content string")
    names = ["rec_id", "pre", "end", "depth", "parent", "sib", "tag", "id", "classes", "attrs", "text"]
    got = spark.sql("SELECT p.rec_id, n.* FROM {p} p, LATERAL html_nodes(p.content) n", p=df)
    assert rows(got, *names) == rows(N.html_nodes(df), *names) and got.count() > 6


def test_a_batch_is_read_in_slices(spark):
    texts = ["<p>" + "x" * (SLICE // 3) + f"</p><b>{i}</b>" for i in range(10)] + [None, ""]
    assert [len(s) for s in slices(pa.array(texts))] == [3, 3, 3, 3]
    nodes = nodes_of(spark, *texts)
    got = nodes.filter("tag = 'b'").join(nodes.filter("tag = '#text'").select("rec_id", F.col("parent").alias("pre"), F.col("text").alias("said")), ["rec_id", "pre"])
    assert rows(got, "rec_id", "said") == sorted([(i + 1, str(i)) for i in range(10)], key=repr)
    assert nodes.select("rec_id").distinct().count() == 12


def test_sides_as_large_as_the_nodes_are_not_broadcast(spark):
    nodes = nodes_of(spark, "<table><tr><th>a<th>b<tr><td>1<td>2</table><ul><li><a>x</a></ul>").unpersist()
    shown = [N.tables(nodes), N.link_only(nodes, nodes.filter("tag = 'li'")), N.with_texts(nodes, nodes.filter("tag = 'td'"))]
    for df in shown:
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_page_texts_keep_references_without_semicolon(spark, tmp_path):
    html = '<nav>n</nav><article><h1>a&amp;&amp</h1><p>b &copy;1&copy <a href="/x?y=1&z=2">c</a></p></article><div class="ad">d&amp, e</div>'
    spark.createDataFrame([(1, "http://h.org/a", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    asked = lambda query, *names: rows(query(spark, str(tmp_path)), *names)
    assert asked(P.visible_text, "text") == [("n a&&amp b ©1&copy c d&amp, e",)]
    assert asked(P.remove_subtrees, "text") == [("a&&amp b ©1&copy c",)]
    assert asked(P.fallback_section, "body") == [("n a&&amp b ©1&copy c d&amp, e",)]
    assert asked(P.headword, "headword") == [("a&&amp",)]
    assert asked(P.listed_items, "ord", "value") == [(1, "d&amp"), (2, "e")]
