"""Leaked windows against a plain search, on random words and on hard rows."""

import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lemmaforge.llm.decontaminate import FmIndex, find_leaks, leak_report, remove_leaks
from lemmaforge.llm.words import sha256_hex

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, width):
    out = []
    windows = {}
    for item, text in items:
        w = words(text)
        if w and item is not None:
            for i in range(max(1, len(w) - width + 1)):
                windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for window, own in windows.items():
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha256_hex(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=repr)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=2, max_size=2), max_size=5))
def test_index_finds_every_place(symbols, patterns):
    text = np.array([*symbols, 0], np.int64)
    index = FmIndex(text, 3, 4)
    for p in patterns:
        low, high = index.search(np.array([p]))
        places = sorted(index.locate(np.arange(low[0], high[0])).tolist())
        assert places == [i for i in range(len(text) - 1) if list(text[i : i + 2]) == p]


def test_leaks_equal_a_plain_search(spark):
    rng = random.Random(3)
    vocabulary = ["Ab", "c9", "été", "x", "Yy", "zé"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 4, 6, 9])))) for i in range(12)]
    items += [(12, None), (13, "--"), (3, items[3][1]), (None, "ab ab"), (14, items[5][1])]
    docs = [(i, " ".join(rng.choices([*vocabulary, "other", "más"], k=rng.choice([0, 2, 30, 300])))) for i in range(60)]
    docs += [(60, None), (61, ""), (None, items[7][1]), (5, docs[5][1]), (62, ("q " * 50_000) + items[9][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'n' as n_words", "1 as leak_spans")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted((tuple(r) for r in leak_report(d, b).collect()), key=repr)
    assert got == plain(docs, items, 10)
    narrow = find_leaks(d, b, width=3, block_windows=4)
    got = {(r.doc_id, sum(s.end - s.start for s in r.leak_spans), len(r.leak_items)) for r in narrow.collect()}
    assert got == {(p[0], p[2], p[3]) for p in plain(docs, items, 3)}


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert leak_report(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert [tuple(r)[:4] for r in leak_report(one, b).collect()] == [(1, 2, 0, 0)]


def test_removal_keeps_the_rest(spark):
    item = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"
    rows = [(1, f"Before, {item.upper()}! After.", "en", 7), (2, "clean", "en", 5), (3, None, None, None), (4, item, "fr", 1)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_chars bigint")
    b = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    got = {r.doc_id: (r.text, r.lang, r.n_chars) for r in remove_leaks(d, b).collect()}
    assert got == {1: ("Before, ! After.", "en", 16), 2: ("clean", "en", 5), 3: (None, None, None), 4: ("", "fr", 0)}


def test_removal_leaves_no_window_with_any_blocks(spark):
    items = [(1, "a b c d e"), (2, "d e f g h"), (3, "p q r s"), (4, "x y")]
    texts = ["n a b c d e f g h m", "k p q a b c d e r s l", "p p x y q r s q r s", "clean text", None, "x p q x y r s y"]
    rng = random.Random(5)
    texts += [" ".join(rng.choices("abcdepqrsxyz", k=rng.randint(1, 200))) for _ in range(60)]
    d = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id bigint, text string, n_chars bigint").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    whole = {r.doc_id: (r.text, r.n_chars) for r in remove_leaks(d, b, width=3).collect()}
    small = {r.doc_id: (r.text, r.n_chars) for r in remove_leaks(d, b, width=3, block_windows=2).collect()}
    assert whole == small and len(small) == len(texts)
    assert words(small[0][0]) == ["n", "m"] and words(small[1][0]) == ["k", "l"]
    assert small[3] == ("clean text", -1) and small[4] == (None, -1)
    assert not any(p[5] for p in plain([(i, t) for i, (t, _) in small.items()], items, 3))
