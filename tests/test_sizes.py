"""What steps lay out and move: each text once, whatever the depth of the markup."""

from pyspark.sql import functions as F

from lemmaforge.operators import entries as X
from lemmaforge.operators import nodes as N
from lemmaforge.operators import senses as E
from lemmaforge.operators.intervals import nearest_above, stack_join
from tests.conftest import rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def deep(spark, depth=40, words=2000):
    text = " ".join(f"w{i:05d}" for i in range(words))
    html = "<div>" * depth + f"<p>{text}</p>" + "</div>" * depth
    return N.html_nodes(spark.createDataFrame([(1, html)], "rec_id long, content string")), text


def written(records):
    return records.agg(F.sum(F.length(F.array_join(F.col("_pieces.piece"), "")))).first()[0]


def test_written_elements_do_not_repeat_their_texts(spark):
    nodes, text = deep(spark)
    elements = E.annotated(nodes)
    records = E.text_records(nodes)
    assert written(records) <= len(text) + 100
    assert "own" not in records.schema.simpleString()
    assert elements.filter(F.col("own") == text).count() == 43


def test_elements_say_what_stands_under_them(spark):
    htmls = [
        '<div>a<a href="x">b</a> <a href="y">c</a></div><p><a href="z">l <i>m</i></a> </p><ul><li>one<br>two</li></ul>',
        '<p>seen<span style="display:none">not <b>seen</b></span> end</p><script>x</script><div style="display:none"><a>q</a></div><p>t</p>',
        "",
    ]
    nodes = N.html_nodes(spark.createDataFrame(list(enumerate(htmls, 1)), "rec_id long, content string"))
    nodes = nodes.filter(F.col("pre") != 4)  # a gap in the numbers
    elements = nodes.filter("tag != '#text'")
    got = {r: tuple(v) for *r, v in ((x.rec_id, x.pre, (x.own, x.link_only, x.leaf)) for x in E.annotated(nodes).collect()) for r in [tuple(r)]}
    plain = {(x.rec_id, x.pre): x.t for x in N.with_texts(nodes, elements, "t").collect()}
    linked = {(x.rec_id, x.pre): x.link_only for x in N.link_only(nodes, elements).collect()}
    blocks = [(x.rec_id, x.pre) for x in elements.filter(F.col("tag").isin(N.BLOCK_TAGS)).collect()]
    ends = {(x.rec_id, x.pre): x.end for x in elements.collect()}
    leaf = {k: not any(r == k[0] and k[1] < p <= ends[k] for r, p in blocks) for k in ends}
    assert got == {k: (plain[k], linked[k], leaf[k]) for k in ends}
    assert rows(E.entry_scripts(nodes)) == rows(N.visible_text(nodes).select("rec_id", E.T.dominant_script("text").alias("script")))


def test_sibling_runs_move_only_the_texts_they_keep(spark):
    html = "<div><p class='sense'>first one</p><p class='x'>said of one</p><p class='sense'>second one</p><p class='x'>said of two</p></div>"
    nodes = N.html_nodes(spark.createDataFrame([(1, html)], "rec_id long, content string"))
    elements = E.annotated(nodes)
    runs = E.sibling_runs(elements, E.sense_nodes(elements), E.entry_scripts(nodes))
    assert rows(runs, "sense", "text") == [(4, "said of one"), (8, "said of two")]
    moved = [line for line in plan_of(runs).splitlines() if "Exchange" in line]
    assert not any("own" in line for line in moved)
    assert "_asked" in plan_of(runs)


def test_texts_under_elements_are_not_repeated_on_the_way(spark):
    nodes, text = deep(spark)
    wanted = nodes.filter("tag = 'div'")
    got = N.with_texts(nodes, wanted, "t")
    assert got.filter(F.col("t") == text).count() == 40
    assert rows(N.with_texts(nodes, wanted.unionByName(wanted), "t").groupBy("pre").count().select("count").distinct(), "count") == [(2,)]
    assert "listagg" not in plan_of(got)  # a copy of each text for every element above it went into that


def test_empty_and_silent_elements_have_no_text(spark):
    nodes = N.html_nodes(spark.createDataFrame([(1, "<p></p><script>x</script><p> a <b>b</b>c<br>d</p>"), (2, None)], "rec_id long, content string"))
    got = N.with_texts(nodes, nodes.filter("tag != '#text'"), "t")
    assert rows(got.filter("tag in ('p', 'script', 'b')"), "tag", "t") == [("b", "b"), ("p", ""), ("p", "a b c d"), ("script", "")]
    assert rows(N.element_texts(nodes, nodes.filter("tag in ('p', 'b')"), "t"), "t") == [("a b c d",), ("b",)]


def test_records_without_profile_read_no_text_for_it(spark):
    nodes = N.html_nodes(spark.createDataFrame([(1, "<p>a</p>")], "rec_id long, content string"))
    marks = spark.createDataFrame([], "rec_id long, pre int, end int, field string")
    got = E.marked_senses(nodes, marks, nodes.select("rec_id"))
    assert got.count() == 0 and "ArrowEvalPython" not in plan_of(got)


def test_headings_are_worked_out_once(spark):
    nodes = N.html_nodes(spark.createDataFrame([(1, "<h3>Usage</h3><p>old word</p>" + "<p>" + "long text " * 20 + "</p>")], "rec_id long, content string"))
    left = E.annotated(nodes)
    keys = spark.createDataFrame([(1, "tarn")], "rec_id long, key string")
    terms, phrases, sections, taken = X.heading_terms(left, keys)
    assert rows(sections, "kind", "title") == [("usageNote", "Usage")] and taken.count() == 3
    assert "Window" not in plan_of(taken) and "_elements" not in plan_of(sections)


def test_nothing_is_written_anew_without_claims(spark):
    nodes = N.html_nodes(spark.createDataFrame([(1, "<p>a</p>")], "rec_id long, content string"))
    assert X.taken_out(nodes, nodes.filter("tag = 'table'").select("rec_id", "pre")) is nodes
    assert rows(X.taken_out(nodes, nodes.filter("tag = 'p'").select("rec_id", "pre")), "tag") == [("body",), ("head",), ("html",)]


def test_tables_read_the_markup_once(spark):
    html = "<table><tr><th>a<th>b<tr><td>1 <i>x</i><td><table><tr><td>in</table><tr><td>2</table><td>lost<table><caption>c</caption></table><tr><td>none"
    nodes = N.html_nodes(spark.createDataFrame([(1, html), (2, "<p>no"), (3, None)], "rec_id long, content string"))
    got = N.tables(nodes)
    assert plan_of(got).count("ArrowEvalPython") == 1
    want = N.table_rows(nodes, nodes.filter("tag = 'table'"))
    same = ["rec_id", "table_pre", "row_pre", "is_header", "cells"]
    assert rows(got, *same) == rows(want, *same) and got.count() == 4


def test_nearest_above_is_the_stack_join(spark):
    html = "<ul><li>a<ul><li>b<li>c</ul><li>d</ul><li>e<div><ul></ul><li><li></div>"
    nodes = N.html_nodes(spark.createDataFrame([(1, html), (2, html * 2)], "rec_id long, content string"))
    for tag in ("ul", "li", "html", "table"):
        got = nearest_above(nodes, F.col("tag") == tag, "up").filter("up is not null")
        assert rows(got, "rec_id", "pre", "tag", "up") == rows(stack_join(nodes, nodes.filter(F.col("tag") == tag), "up"), "rec_id", "pre", "tag", "up")
    assert nearest_above(nodes, F.col("tag") == "ul", "up").count() == nodes.count()


def test_marked_blocks_move_no_texts(spark):
    lines = "".join(f'<p class="n">{i}. a meaning of {i}</p>' for i in range(1, 6))
    html = lines + "<div><b>1</b> not <i>it</i></div><ul><li><b>7</b> x</li></ul>"
    nodes = N.html_nodes(spark.createDataFrame([(1, html)], "rec_id long, content string"))
    elements = E.annotated(nodes)
    candidates = E.marker_candidates(elements)
    assert "own" not in candidates.columns and "text" not in candidates.columns
    assert rows(candidates.filter("marker_pre is not null"), "tag", "marker", "size") == [("div", "1", 8)]
    blocks = E.marker_blocks(nodes, elements, candidates)
    assert rows(blocks, "marker", "size") == [(str(i), 17) for i in range(1, 6)] and "ArrowEvalPython" not in plan_of(blocks)
    assert rows(E.with_own(elements, blocks), "own") == [(f"{i}. a meaning of {i}",) for i in range(1, 6)]


def test_profiles_read_the_markup_once(spark):
    nodes = N.html_nodes(spark.createDataFrame([(1, "<div class='s'><b>1</b><i>a meaning</i></div>")], "rec_id long, content string"), placed=False)
    got = E.profile_senses(nodes, {"sense": ".s", "definition": "i", "number": "b"})
    assert rows(got, "number", "definition") == [("1", "a meaning")]
    assert "ArrowEvalPython" not in plan_of(got)


def test_blanks_of_all_kinds_become_single(spark):
    html = "<div> a \t\n<b>  </b><i>​</i> <u>　b  c </u>﻿<p>\n d\re </p></div><p> </p><p> f</p>"
    nodes = N.html_nodes(spark.createDataFrame([(1, html), (2, html * 3)], "rec_id long, content string"))
    elements = nodes.filter("tag != '#text'")
    assert rows(E.annotated(nodes), "rec_id", "pre", "own") == rows(N.with_texts(nodes, elements, "own"), "rec_id", "pre", "own")
    stored = E.text_records(nodes).select(F.explode("_pieces.piece").alias("p"))
    assert stored.filter(F.col("p").rlike(r"  |[^ -~]")).count() == 0
