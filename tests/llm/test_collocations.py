"""Collocations against plain counting."""

import random
from collections import Counter

import numpy as np
import pytest

from lemmaforge.llm import gather
from lemmaforge.llm.collocations import collocations, count_tree, cut_score, differs, in_order
from pyspark.sql import functions as F


def plain(rows, least, top, covered=100):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        raw = (text or "").encode().translate(lower)
        for sign in b".,;:!?\n\x0b\x0c\r":
            raw = raw.replace(bytes([sign]), b".")
        for piece in raw.replace(b"\t", b" ").split(b"."):
            words = [w.decode() for w in piece.split(b" ") if w]
            totals[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i : i + k]] = max(most[p[i : i + k]], a)
        for p, a in candidates.items():
            if most[p] and 100 * most[p] >= covered * a:
                continue
            cuts = [(1000 * a * totals[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, totals[lang], -score))
    return sorted(out)


def texts(seed, count):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "in", "é", "a-b", "\x00", "city", "hall", "x9"]
    glue = [" "] * 12 + ["\t", ", ", ".", "\n", "; ", "  ", "\r"]
    rows = []
    for i in range(count):
        text = "".join(rng.choice(words[: rng.randint(2, 11)]) + rng.choice(glue) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "de", None, "und", "x y"]), text))
    return [*rows, *[("en", "in the New York city hall of x9")] * 30, (None, None), ("en", ""), ("de", " .,\t")]


def compare(spark, rows, least, top, **more):
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as chunk", "2 as phrase", "3 as id")
    got = collocations(df.repartition(3), least, top, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_counts_and_scores(spark):
    compare(spark, texts(1, 150), 8, 2000)


def test_tiny_groups_extend_prefixes(spark, monkeypatch):
    """A budget of few suffixes makes nearly every prefix heavy; chunks are small and merged in steps."""
    monkeypatch.setattr(gather, "MERGED", 2)
    monkeypatch.setattr(gather, "ASKED", 1)
    monkeypatch.setattr("lemmaforge.llm.collocations.CHUNK_BYTES", 700)
    monkeypatch.setattr("lemmaforge.llm.collocations.GROUPS", 10**9)
    compare(spark, texts(2, 120), 5, 7, group_rows=3)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert collocations(df).collect() == []


def test_subtree_counts_are_leaf_totals():
    rng = np.random.default_rng(5)
    suffixes = rng.integers(1, 4, (5, 400)).astype(np.int32)
    ends = rng.integers(2, 6, 400)
    suffixes[np.arange(5)[:, None] >= ends[None, :]] = 0
    suffixes = suffixes[:, in_order(suffixes)]
    counts = rng.integers(1, 5, 400)
    want = Counter()
    for column, n in zip(suffixes.T.tolist(), counts.tolist()):
        for k in range(2, 6):
            if column[k - 1]:
                want[tuple(column[:k])] += n
    got = {tuple(p): n for phrases, f in count_tree(suffixes, counts, 10, []) for p, n in zip(phrases.T.tolist(), f.tolist())}
    assert got == {p: n for p, n in want.items() if n >= 10}
    assert len(differs(suffixes, 5)) == len(set(map(tuple, suffixes.T.tolist())))


@pytest.mark.parametrize("values", [(10**13, 10**14, 10**13, 10**13 + 7), (100, 12345, 1000, 999), (1, 1, 7, 11)])
def test_products_past_64_bits(spark, values):
    a, n, left, right = values
    row = spark.range(1).select(cut_score(*(F.lit(v).cast("bigint") for v in values)).alias("s")).first()
    assert row.s == 1000 * a * n // (left * right)
