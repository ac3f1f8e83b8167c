"""Every stage of the pipeline against a plain version of it."""

import os

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lemmaforge.llm import quality
from lemmaforge.llm.queries import tokenizer_path
from lemmaforge.session import cut_lineage
from tests.llm.test_decontaminate import plain as plain_leaks
from tests.llm.test_jaccard import plain as plain_groups
from tests.llm.test_private import plain as plain_private

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "one lone text of its own words", None, "s", 5), docs.first()]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = cut_lineage(stage(spark, docs, FOLDER))
        before, after = docs.collect(), out.collect()
        texts = lambda rows: sorted(((r.doc_id, r.text) for r in rows), key=repr)
        if name != "bpe":
            assert out.columns == docs.columns
        if name == "quality":
            good = quality.classify_quality(docs, labels).where("good")
            assert sorted((r.doc_id for r in after), key=repr) == sorted((r.doc_id for r in good.collect()), key=repr)
            assert len(after) < len(before)
        elif name == "jaccard_join":
            groups = plain_groups([(r.doc_id, r.text) for r in before])
            first = {g[2] for g in groups if g[1]}
            assert {r.doc_id for r in after if (r.text or "").strip()} == first
            empty = sum(not g[1] for g in groups)
            assert len(after) == len(first) + empty
        elif name == "decontamination":
            hit = {r[0] for r in plain_leaks([(r.doc_id, r.text) for r in before], items, 10) if r[5]}
            changed = {a[0] for a, b in zip(texts(before), texts(after)) if a != b}
            assert hit and {d for d, _ in set(texts(before)) - set(texts(after))} == hit and changed
            left = plain_leaks([(r.doc_id, r.text) for r in after], items, 10)
            assert len(after) == len(before) and sum(r[5] for r in left) == 0
        elif name == "private_data":
            assert len(after) == len(before)
            clean = {(r.doc_id, r.text) for r in before if not plain_private(r.text)}
            assert clean <= {(r.doc_id, r.text) for r in after}
            assert not any("@" in (r.text or "") and "email" in str(plain_private(r.text)) for r in after)
        else:
            theirs = Tokenizer.from_file(tokenizer_path())
            want = [(r.doc_id, theirs.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in before]
            assert sorted(((r.doc_id, r.ids, r.text) for r in after), key=repr) == sorted(want, key=repr)
        docs = out


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "text"]
    assert out.where(F.col("n_tokens") != F.size("ids")).count() == 0 and out.count() > 50


def test_stages_take_any_columns(spark):
    """Names that the stages use themselves come through all of them but the last."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["features", "evidence", "scaled", "email", "terms", "_own", "_spans", "_again", "_site", "_doc", "prediction", "probability"]
    wide = docs.selectExpr("*", *(f"cast(doc_id as string) as {n}" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        wide = cut_lineage(stage(spark, wide, FOLDER))
        assert wide.columns == [*docs.columns, *names]
    assert wide.where(" or ".join(f"{n} <> cast(doc_id as string)" for n in names)).count() == 0 and wide.count() > 50
