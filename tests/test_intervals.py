"""Interval joins against walking up the parents."""

import json
import random

from pyspark.sql import functions as F

from lemmaforge.functions.markup import TEXT, read_nodes
from lemmaforge.operators import intervals as I
from lemmaforge.operators import nodes as N
from tests.conftest import rows


def pages(seed, count):
    rng = random.Random(seed)

    def tree(depth):
        if depth == 0 or rng.random() < 0.2:
            return rng.choice(["x", "y z", "<img src=a>", ""])
        tag = rng.choice(["div", "p", "b", "span", "ul", "i"])
        cls = rng.choice(["", " class=a", " class='a b'", " id=k"])
        return f"<{tag}{cls}>" + "".join(tree(depth - 1) for _ in range(rng.randint(0, 3))) + f"</{tag}>"

    return [(i, "".join(tree(6) for _ in range(3))) for i in range(count)] + [(900, ""), (901, None)]


def read(spark, data):
    df = spark.createDataFrame(data, "rec_id long, content string")
    plain = {i: read_nodes(html) for i, html in data}
    return N.html_nodes(df).cache(), plain


def above(nodes, node):
    by_pre = {n["pre"]: n for n in nodes}
    while node["parent"] >= 0:
        node = by_pre[node["parent"]]
        yield node


def test_stack_join_finds_nearest_and_every_owner(spark):
    nodes, plain = read(spark, pages(1, 12))
    owner = lambda n: n["tag"] in ("div", "span", "b")
    owners = nodes.filter(F.col("tag").isin("div", "span", "b"))
    inner = nodes.select("rec_id", "pre", "tag", F.lit(1).alias("up"))
    nearest, every, own = [], [], []
    for i, held in plain.items():
        for n in held:
            ups = [u["pre"] for u in above(held, n) if owner(u)]
            every += [(i, n["pre"], u) for u in ups]
            nearest += [(i, n["pre"], ups[0])] if ups else []
            at = n["pre"] if owner(n) else ups[0] if ups else None
            own += [(i, n["pre"], at)] if at is not None else []
    of = lambda df: rows(df, "rec_id", "pre", "up")
    assert of(I.stack_join(inner, owners, "up")) == sorted(nearest, key=repr)
    assert of(I.stack_join(inner, owners.union(owners), "up", every=True)) == sorted(every, key=repr)
    assert of(I.stack_join(inner, owners, "up", itself=True)) == sorted(own, key=repr)
    twice = I.stack_join(inner.union(inner), owners, "up")
    assert twice.count() == 2 * len(nearest) and twice.columns == ["rec_id", "pre", "tag", "up"]
    assert I.stack_join(inner, owners.limit(0), "up").count() == 0
    counted = [(i, n["pre"], sum(owner(u) for u in above(held, n))) for i, held in plain.items() for n in held]
    assert of(I.heights(inner, owners, "up")) == sorted(counted, key=repr)


def test_flags_and_leaves(spark):
    nodes, plain = read(spark, pages(2, 12))
    flagged = I.inside(nodes, _in=F.col("tag") == "b")
    want = sorted(((i, n["pre"], any(u["tag"] == "b" for u in above(held, n))) for i, held in plain.items() for n in held), key=repr)
    assert rows(flagged, "rec_id", "pre", "_in") == want
    bare = [
        (i, n["pre"]) for i, held in plain.items() for n in held
        if not any(m["tag"] == "b" and n["pre"] < m["pre"] <= n["end"] for m in held)
    ]
    assert rows(I.childless(nodes, F.col("tag") == "b"), "rec_id", "pre") == sorted(bare, key=repr)
    wide = I.parents(nodes.select("rec_id", "pre", "parent"), nodes, F.col("tag"), "ups", 3)
    want = sorted(((i, n["pre"], [u["tag"] for u in above(held, n)][:3]) for i, held in plain.items() for n in held), key=repr)
    assert rows(wide, "rec_id", "pre", "ups") == want


def test_selector_chains_follow_the_ancestors(spark):
    nodes, plain = read(spark, pages(3, 12))
    tests = {
        "div .a": [lambda n: n["tag"] == "div", lambda n: "a" in n["classes"]],
        "div b .a": [lambda n: n["tag"] == "div", lambda n: n["tag"] == "b", lambda n: "a" in n["classes"]],
        ".a .a .a": [lambda n: "a" in n["classes"]] * 3,
        "* #k p": [lambda n: True, lambda n: n["id"] == "k", lambda n: n["tag"] == "p"],
    }

    def met(held, node, chain):
        if node["tag"] == TEXT or not chain[-1](node):
            return False
        wanted = chain[:-1]
        for up in reversed(list(above(held, node))):
            if wanted and wanted[0](up):
                wanted = wanted[1:]
        return not wanted

    names = {f"s{k}": raw for k, raw in enumerate(tests)}
    flagged = N.marked(nodes, **names, none=None)
    for name, raw in names.items():
        want = sorted(((i, n["pre"]) for i, held in plain.items() for n in held if met(held, n, tests[raw])), key=repr)
        assert rows(flagged.filter(name), "rec_id", "pre") == want, raw
    assert flagged.filter("none").count() == 0


def test_deep_pages_stay_small(spark):
    deep = '<div class="level">word ' * 200 + "</div>" * 200
    html = deep + "<p>tail</p>" * 300
    nodes, _ = read(spark, [(1, html)])
    size = sum(len(json.dumps(r.asDict())) for r in nodes.collect())
    assert "anc" not in nodes.columns and size < 20 * len(html)
    assert N.visible_text(nodes).first()["text"].split() == ["word"] * 200 + ["tail"] * 300
