"""Lookup rules: tiers, duplicates, redirects, dedupe, prefixes, resources, ranges."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lemmaforge.functions import keys as K
from lemmaforge.operators import lookup as L
from lemmaforge.operators import ranking
from tests.conftest import rows


def records(spark, *pairs, dict_id="d"):
    data = [(dict_id, key, i, content) for i, (key, content) in enumerate(pairs)]
    return spark.createDataFrame(data, "dict_id string, key string, source_ord long, content string")


def asked(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "query string")


def test_tiers(spark):
    recs = records(spark, ("Mere", "a"), ("mere", "b"), ("Flambé", "c"), ("flambé", "d"), ("Tarn", "e"))
    got = L.match_keys(asked(spark, "MERE", "Mere", " mere ", "Flambe\u0301", "tarn", "none"), L.key_index(recs))
    assert rows(got, "query", "matched_key", "tier") == [
        (" mere ", "mere", 1), ("Flambe\u0301", "Flambé", 2), ("MERE", "mere", 3), ("Mere", "Mere", 1), ("tarn", "Tarn", 4),
    ]


def test_duplicates_and_redirects(spark):
    recs = records(
        spark,
        ("tarn", "first"), ("tarn", "second"), ("Tarn", "capital"), ("lough", "@@@LINK=tarn\r\n\x00"), ("lough", "own"),
        ("loop", "@@@LINK=pool"), ("pool", "@@@LINK=loop"), ("self", "@@@LINK=self"), ("self", "kept"), ("A", "@@@LINK=a"),
        ("two", "@@LINK=tarn"), ("two", "@@@LINK=tarn"),
    )
    got = L.lookup(asked(spark, "lough", "loop", "self", "a", "two", "TARN"), recs)
    assert rows(got, "query", "rec_ord", "matched_key", "redirected_from", "raw_ord", "content") == [
        ("TARN", 1, "tarn", None, 1, "first"), ("TARN", 2, "tarn", None, 2, "second"),
        ("lough", 1, "tarn", "lough", 1, "first"), ("lough", 2, "tarn", "lough", 2, "second"), ("lough", 3, "lough", None, 2, "own"),
        ("self", 1, "self", None, 2, "kept"),
        ("two", 1, "tarn", "two", 1, "first"), ("two", 2, "tarn", "two", 2, "second"),
    ]


def test_redirect_depth(spark):
    chain = [(f"k{i}", f"@@@LINK=k{i + 1}") for i in range(12)] + [("k12", "end")]
    got = L.lookup(asked(spark, "k3", "k4", "k5"), records(spark, *chain))
    assert rows(got, "query", "content") == [("k4", "end"), ("k5", "end")]


def test_prefix_suggestions(spark):
    recs = records(spark, ("Tarnish", "x"), ("tarn", "x"), ("tarn", "y"), ("tart", "x"))
    chosen = spark.createDataFrame([("d", 0)], "dict_id string, sel_ord long")
    got = L.prefix_suggest(asked(spark, "TARN", "zz"), recs, chosen, 2)
    assert rows(got, "query", "rank", "suggestion") == [("TARN", 1, "Tarnish"), ("TARN", 2, "tarn")]


def test_running_position_in_stretches(spark):
    data = [("hot", i, i % 3 == 0) for i in range(0, 200, 2)] + [("cold", 5, True)]
    df = spark.createDataFrame(data, "k string, o long, b boolean")
    got = ranking.running_position(df, ["k"], "o", sums={"s": F.col("b").cast("int")}, chunk=7).orderBy("k", "o").collect()
    assert [r.position for r in got] == [1] + list(range(1, 101))
    seen = 0
    for r in got[1:]:
        assert r.s == seen
        seen += r.b


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from(["x", "y", "@@@LINK=a", "@@@LINK=b", "@@@LINK=c", "@@@LINK=d"])), min_size=1, max_size=12))
def test_closure_against_plain_recursion(spark, pairs):
    by_key = {}
    for key, content in pairs:
        by_key.setdefault(key, []).append(content)

    def resolve(key, seen, depth):
        if depth > 8 or key not in by_key or key in seen:
            return []
        out = []
        for content in by_key[key]:
            out += resolve(content[8:], seen | {key}, depth + 1) if content.startswith("@@@LINK=") else [content]
        return out

    recs = records(spark, *pairs)
    index = L.key_index(recs)
    numbered = L.numbered_records(recs)
    got = L.visible_ordinals(L.resolved_records(index.select("dict_id", "key"), numbered, L.redirect_edges(numbered, index)), chunk=2)
    mine = {}
    for key, _, content in rows(got, "key", "rec_ord", "content"):
        mine.setdefault(key, []).append(content)
    assert mine == {k: v for k in by_key if (v := resolve(k, frozenset(), 0))}


def test_resources(spark):
    refs = spark.createDataFrame([("d", "sound://Uk/Tarn.MP3?x=1"), ("d", "a\\\\b.png"), ("d", "none.gif")], "dict_id string, ref string")
    stored = spark.createDataFrame([("d", "uk/tarn.mp3", 1), ("d", "uk/tarn.mp3", 0), ("d", "b.png", 2)], "dict_id string, res_key string, volume int")
    assert rows(L.resolve_resources(refs, stored), "ref", "res_key", "cand", "volume") == [
        ("a\\\\b.png", "b.png", 1, 2), ("sound://Uk/Tarn.MP3?x=1", "uk/tarn.mp3", 0, 0),
    ]
    assert rows(L.has_resource(refs, stored), "ref") == [("a\\\\b.png",), ("sound://Uk/Tarn.MP3?x=1",)]


def test_ranges_close_at_the_next_greater_start(spark):
    data = [("d", 1, 0, 0), ("d", 2, 0, 0), ("d", 3, 10, 25), ("d", 4, 3 << 30, 0), ("d", 5, (3 << 30) + 4, 0)]
    df = spark.createDataFrame(data, "dict_id string, source_ord long, start_off long, end_off long")
    assert rows(L.close_ranges(df), "source_ord", "end_off") == [(1, 10), (2, 10), (3, 25), (4, (3 << 30) + 4), (5, 0)]


def test_unknown_dictionary_is_an_error(spark):
    import pytest

    dicts = spark.createDataFrame([("a", 0, "Ay", "ok"), ("b", 1, "Bee", "unavailable")], "dict_id string, dict_ord int, title string, health string")
    assert rows(L.select_dictionaries(dicts, ["a"]), "dict_id", "sel_ord") == [("a", 0)]
    for wanted in (["b"], ["c"]):
        with pytest.raises(L.UnknownDictionary):
            L.select_dictionaries(dicts, wanted)
    with pytest.raises(L.UnknownDictionary):
        L.find_dictionary(dicts, "zzz")


def test_selectors_and_links(spark):
    base, ordinal = K.selector_base_ordinal("v")
    cases = {"tarn²": ("tarn", 2), "tarn^{12}": ("tarn", 12), "tarn^3": ("tarn", 3), "tarn": (None, None), "²": (None, None), "x^0": (None, None)}
    df = spark.createDataFrame([(c,) for c in cases], "v string").select("v", base.alias("b"), ordinal.alias("o"))
    assert {r.v: (r.b, r.o) for r in df.collect()} == cases
    links = spark.createDataFrame([("@@@LINK=Tarn!\r\n\x00",), ("@@LINK=x",), ("@@@LINK= \x00",), ("plain",)], "c string")
    assert [r[0] for r in links.select(K.link_target("c")).collect()] == ["Tarn!", "x", None, None]


def test_first_paths_against_all_paths(spark):
    """Dense redirects, spellings that bar each other, fewer hops than keys."""
    draw = random.Random(7)
    keys = ["a", "b", "c", "d", "e", " e", "b "]
    data = [
        (f"d{d}", draw.choice(keys), i, f"@@@LINK={draw.choice(keys)}" if draw.random() < 0.6 else f"text {draw.randrange(6)}")
        for d in range(60)
        for i in range(22)
    ]
    recs = spark.createDataFrame(data, "dict_id string, key string, source_ord long, content string")
    index, numbered = L.key_index(recs), L.numbered_records(recs)
    roots, edges = index.select("dict_id", "key"), L.redirect_edges(numbered, index)
    for hops in (2, 3, 8):
        every = L.redirect_closure(roots, edges, hops).groupBy("dict_id", "root", "node").agg(F.min("path").alias("path"))
        got = L.first_paths(roots, edges, hops)
        assert rows(got, "dict_id", "root", "node", "path") == rows(every, "dict_id", "root", "node", "path"), hops
    plain = L.dedupe_content(L.resolved_records(roots, numbered, edges))
    assert rows(L.first_records(roots, numbered, edges), *sorted(plain.columns)) == rows(plain, *sorted(plain.columns))


def test_first_paths_do_not_multiply(spark):
    """Thirty keys that all redirect to each other: eight hops over all paths would be 30 ** 8 rows a key."""
    data = [(f"k{a}", f"@@@LINK=k{b}") for a in range(30) for b in range(30)] + [(f"k{a}", f"text {a}") for a in range(30)]
    got = L.lookup(asked(spark, "k0", "k7"), records(spark, *data))
    assert got.groupBy("query").count().collect() and got.count() == 60
