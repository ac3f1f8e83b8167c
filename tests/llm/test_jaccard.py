"""Components of near-equal documents against brute force."""

import random
import re

import pytest

from lemmaforge.llm import jaccard
from lemmaforge.llm.components import Forest


def plain(rows, width=5, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(width, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    forest = Forest()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                forest.link(i, j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            r = forest.root(i)
            least[r] = min(doc, least.get(r, doc))
    return sorted(((doc, len(sets[i]), least.get(forest.root(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def corpus(seed=1, groups=25, most=12, hot=150):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(400)]
    passage = rng.choices(words, k=30)
    texts = []
    for g in range(groups):
        base = rng.choices(words, k=rng.choice([3, 6, 40, 120]))
        for _ in range(rng.randint(1, most) if g else hot):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                own[rng.randrange(len(own))] = rng.choice(words).upper()
            texts.append(" ".join(own) if rng.random() < 0.8 else "  ".join(own[: len(own) * 9 // 10] + ["\n"]))
    texts += [" ".join(passage + rng.choices(words, k=k)) for k in (0, 2, 5, 8, 60, 80)] * 2
    texts += ["", None, " \t\n", "one", "ONE", "a b c", "x " * 20_000, "x " * 30_000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return [*rows, rows[3], (None, texts[3]), (None, "alone")]


@pytest.mark.parametrize("chunk", [8, 512])
def test_components_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as c", "2 as size", "'x' as component_id").repartition(3)
    assert sorted(map(tuple, jaccard.near_documents(df).collect()), key=repr) == plain(rows)


def test_other_parameters_and_empty(spark):
    rows = corpus(2, 12, 5, 20)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, jaccard.near_documents(df, 3, 60).collect()), key=repr) == plain(rows, 3, 60)
    assert jaccard.near_documents(df.limit(0)).count() == 0
    assert [tuple(r) for r in jaccard.near_documents(df.limit(0).union(spark.createDataFrame([(4, None)], df.schema))).collect()] == [(4, 0, 4)]
