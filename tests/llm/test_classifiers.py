"""Quality and toxicity: held-out accuracy, shrinkage, and hard rows."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from lemmaforge.llm import quality, toxicity
from lemmaforge.llm.labelled import fold, labelled_sample

FOLDER = "/root/testdata/sf0.01"
WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor".split()


def corpus(spark, n=400):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        own = rng.choices(WORDS, k=rng.randint(20, 60))
        if toxic:
            own[5:5] = ["you", rng.choice(["grobbler", "grobblest", "zwick"])] * 2
        text = " ".join(w + ("$$$" if bad else "") for w in own) + "."
        docs.append((i, text, "en", f"s{i % 3}"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", "en", "s0"), (None, "lorem ipsum", "en", "s1"), docs[0], (n + 2, "lorem " * 50_000, "en", "s2")]
    labels += [(n, None, None), (None, 1, 1), (0, 0, 0), (10**6, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").selectExpr("*", "1 as label", "2 as features", "'x' as good", "0 as score"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


def test_quality_of_a_corpus(spark):
    docs, labels = corpus(spark)
    rows = quality.classify_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.where("doc_id > 0").collect()}
    judged = [(r.good, truth[r.doc_id]) for r in rows if truth.get(r.doc_id) is not None]
    assert sum(g == bool(t) for g, t in judged) >= 0.98 * len(judged)
    assert all(0 <= r.posterior <= 1 and 0 <= r.section_prior <= 1 for r in rows)


def test_sparse_sites_say_what_the_prior_says(spark):
    # ten large sites that differ, and one with a single document
    rows = [(float(0.2 + 0.06 * i) * 500, 500.0, 0.5) for i in range(10)]
    groups = spark.createDataFrame(rows, "s double, n double, p double")
    weight = quality.strength(groups, F.col("s"), F.col("n"), F.col("p"))
    shares = [0.2 + 0.06 * i for i in range(10)]
    between = sum((x - 0.5) ** 2 for x in shares) / 10 / 0.25 - 1 / 500
    assert math.isclose(weight, max(1.0, 1 / between - 1), rel_tol=1e-6)
    same = spark.createDataFrame([(250.0, 500.0, 0.5)] * 5, "s double, n double, p double")
    assert quality.strength(same, F.col("s"), F.col("n"), F.col("p")) == quality.MOST_STRENGTH


def test_toxicity_of_a_corpus(spark):
    docs, labels = corpus(spark)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    truth = {r.doc_id: r.toxic for r in labels.where("doc_id > 0").collect()}
    judged = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    assert judged and sum(p == t for p, t in judged) >= 0.95 * len(judged)


@pytest.mark.parametrize("rows", [[], [(1, "a b", "en", "s")]])
def test_without_labels(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.good for r in quality.classify_quality(docs, labels).collect()] == [True] * len(rows)
    assert [r.score for r in toxicity.score_toxicity(docs, labels).collect()] == [0.0] * len(rows)


def test_sample_is_bounded_and_leaves_fold_zero_out(spark):
    docs, labels = corpus(spark)
    sample = labelled_sample(docs, labels, "toxic", 100)
    assert 50 < sample.count() < 160 and sample.where("fold = 0").count() == 0
    assert {(r.doc_id, r.label) for r in labelled_sample(docs, labels, "quality").where("doc_id = 0").collect()} <= {(0, 1.0), (0, 0.0)}
    assert docs.where(fold(F.col("doc_id")).isNull()).count() == 1


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    held = labels.where(fold(F.col("doc_id")) == 0)
    good = quality.classify_quality(docs, labels).join(held, "doc_id").select(F.col("good").cast("int"), "quality").collect()
    assert sum(a == b for a, b in good) >= 0.95 * len(good)
    toxic = toxicity.score_toxicity(docs, labels).join(held, "doc_id").select("predicted", "toxic").collect()
    assert sum(a == b for a, b in toxic) >= 0.9 * len(toxic)
