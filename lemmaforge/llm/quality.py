"""Quality: the evidence of a document, and what its site and section are known for.

A logistic model over features of the text gives every document a chance of being good. Chances are summed per
site and per section of a site (grouped sums, partial first). The share of good documents of a site is shrunk
towards the global share, that of a section towards its site's, by a strength estimated from how much the groups
differ: a sparse group says what its parent says. A document's own chance is taken out of its groups' sums, and
its posterior is its own odds moved by the odds of its section over the global odds.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.feature import StandardScaler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaforge.llm.labelled import FIT_ROWS, labelled_sample
from lemmaforge.llm.words import blank_words
from lemmaforge.session import cut_lineage

ACCEPT = 0.5
MOST_STRENGTH = 1e6
FEATURES = [
    "words, log", "signs of junk", "words that end in junk", "exclamation marks", "bars", "capitals", "different words, log share",
    "largest share of a word", "repeated pairs", "repeated lines", "digits", "length of words", "full stops",
]
_SIGNS = b"#$%&*~^=_<>{}[]"


def features_of(text: str | None) -> list[float]:
    """Features of a text, all between 0 and some ten; zero where there are no words."""
    words = blank_words(text)
    if not words:
        return [0.0] * len(FEATURES)
    raw, count = text.encode(), len(words)
    size = len(raw)
    without = lambda signs: size - len(raw.translate(None, signs))
    signs, stops = without(_SIGNS), raw.count(b".")
    ends = sum(w[-1:] in b"#$%&*!" for w in words) if signs or b"!" in raw else 0
    different = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    rate = lambda n, of: math.log1p(100 * n / of)
    return [
        math.log1p(count), rate(signs, size), rate(ends, count), rate(raw.count(b"!"), size), rate(raw.count(b"|"), count),
        rate(without(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size), -math.log(len(different) / count), rate(max(different.values()), count),
        rate(max(0, count - 1 - pairs), count), rate(len(lines) - len(set(lines)), len(lines)), rate(without(b"0123456789"), size),
        min(20.0, size / count) / 5, rate(stops, count),
    ]


def with_features(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """`docs` with `features`, which take the place of the text unless it is kept."""
    at = docs.columns.index("text")
    names = [c for c in docs.columns if keep_text or c != "text"] + ["features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features_of(t.as_py()) for t in batch.column(at)]
            others = [c for i, c in enumerate(batch.columns) if keep_text or i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(rows, pa.list_(pa.float64()))], names=names)

    schema = (docs if keep_text else docs.drop("text")).withColumn("features", F.expr("cast(array() as array<double>)")).schema
    return docs.mapInArrow(run, schema).withColumn("features", array_to_vector("features"))


def odds(chance: Column) -> Column:
    kept = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), chance))
    return F.log(kept / (1 - kept))


def strength(groups: DataFrame, total: Column, size: Column, prior: Column) -> float:
    """How many documents the parent counts for: the moment estimate of a beta prior over the groups' shares."""
    share = total / size
    spread = size * F.pow(share - prior, 2)
    row = groups.where(size > 0).agg(
        F.sum(spread).alias("spread"), F.sum(size * prior * (1 - prior)).alias("chance"), F.sum(size).alias("n"),
        F.sum(size * size).alias("squares"), F.count("*").alias("k"), F.sum(prior * (1 - prior)).alias("noise"),
    ).first()
    if not row.k or row.k < 2 or not row.chance:
        return MOST_STRENGTH
    # spread = noise of k groups + between-group variance times the documents
    between = (row.spread - row.noise) / row.chance
    if between <= 1 / MOST_STRENGTH:
        return MOST_STRENGTH
    return min(MOST_STRENGTH, max(1.0, 1 / between - 1))


class QualityModel:
    """The fitted scale and weights; None where the sample lacks one of the two labels."""

    def __init__(self, docs: DataFrame, labels: DataFrame, fit_rows: int) -> None:
        sample = labelled_sample(docs, labels, "quality", fit_rows)
        self.model = None
        if len({r.label for r in sample.select("label").distinct().collect()}) == 2:
            known = with_features(sample.select("label", "text"))
            self.scale = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(known)
            self.model = LogisticRegression(featuresCol="scaled", labelCol="label", regParam=0.001).fit(self.scale.transform(known))

    def evidence(self, docs: DataFrame, keep_text: bool = False) -> DataFrame:
        """`docs` with `evidence`, their own chance of being good."""
        kept = [c for c in docs.columns if keep_text or c != "text"]
        judged = self.model.transform(self.scale.transform(with_features(docs, keep_text)))
        return judged.select(*kept, vector_to_array("probability")[1].alias("evidence"))


def section_sums(judged: DataFrame) -> tuple[DataFrame, Column]:
    """Sums of sections and their sites with the strengths of the priors, and the global share of good documents.

    Reads `_site`, `_section` and `evidence`. The result is written; the planner knows if it is small.
    """
    sums = [F.sum("evidence").alias("_s"), F.count("*").cast("double").alias("_n")]
    sections = cut_lineage(judged.groupBy("_site", "_section").agg(*sums))
    whole = sections.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n")).first()
    prior = F.lit((whole.s + 1) / (whole.n + 2) if whole.n else 0.5)
    sites = sections.groupBy("_site").agg(F.sum("_s").alias("_site_s"), F.sum("_n").alias("_site_n"))
    outer = strength(sites, F.col("_site_s"), F.col("_site_n"), prior)
    both = sections.join(sites.withColumnRenamed("_site", "_of"), F.col("_site").eqNullSafe(F.col("_of"))).drop("_of")
    mean = (F.col("_site_s") + outer * prior) / (F.col("_site_n") + outer)
    inner = strength(both.withColumn("_mean", mean), F.col("_s"), F.col("_n"), F.col("_mean"))
    both = both.withColumnsRenamed({"_site": "_of", "_section": "_part"}).withColumns({"_outer": F.lit(outer), "_inner": F.lit(inner)})
    return cut_lineage(both), prior


def with_posterior(judged: DataFrame, sections: DataFrame, prior: Column, accept: float) -> DataFrame:
    """`judged` with `site_prior`, `section_prior`, `posterior` and `good`."""
    out = judged.join(sections, F.col("_site").eqNullSafe(F.col("_of")) & F.col("_section").eqNullSafe(F.col("_part")))
    own = F.col("evidence")
    site_prior = (F.col("_site_s") - own + F.col("_outer") * prior) / (F.col("_site_n") - 1 + F.col("_outer"))
    section_prior = (F.col("_s") - own + F.col("_inner") * F.col("site_prior")) / (F.col("_n") - 1 + F.col("_inner"))
    out = out.withColumn("site_prior", site_prior).withColumn("section_prior", section_prior)
    posterior = 1 / (1 + F.exp(-(odds(own) - odds(prior) + odds(F.col("section_prior")))))
    return out.withColumn("posterior", posterior).withColumn("good", F.col("posterior") >= accept)


def classify_quality(
    docs: DataFrame, labels: DataFrame, site: str = "source", section: str = "lang", fit_rows: int = FIT_ROWS, accept: float = ACCEPT
) -> DataFrame:
    """One row per document: `doc_id`, `evidence` (its own chance), `site_prior`, `section_prior`, `posterior`, `good`.

    Null and empty texts have features of zero and are judged as such. Null sites and sections are groups of their
    own; repeated rows each count and get their row. Without both labels in the sample every document is good.
    """
    names = ("evidence", "site_prior", "section_prior", "posterior")
    own = docs.select("doc_id", F.col(site).alias("_site"), F.col(section).alias("_section"), "text")
    model = QualityModel(docs, labels, fit_rows)
    if model.model is None:
        return own.select("doc_id", *(F.lit(1.0).alias(c) for c in names), F.lit(True).alias("good"))
    # ids and chances only: every step from here on is small beside the texts
    judged = cut_lineage(model.evidence(own))
    sections, prior = section_sums(judged)
    return with_posterior(judged, sections, prior, accept).select("doc_id", *names, "good")


def keep_good(
    docs: DataFrame, labels: DataFrame, site: str = "source", section: str = "lang", fit_rows: int = FIT_ROWS, accept: float = ACCEPT
) -> DataFrame:
    """The rows of `docs` that `classify_quality` calls good, with all their columns, whatever these are called.

    Null and empty texts are judged by features of zero, null sites and sections are groups of their own, and repeated
    rows stay or go together. Texts are read twice and not moved.
    """
    model = QualityModel(docs, labels, fit_rows)
    if model.model is None:
        return docs
    others = F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("_doc")
    marked = docs.select(F.col(site).alias("_site"), F.col(section).alias("_section"), "text", others)
    sections, prior = section_sums(model.evidence(marked.select("_site", "_section", "text")))
    judged = with_posterior(model.evidence(marked, keep_text=True), sections, prior, accept)
    return judged.where("good").select(*[(F.col("text") if c == "text" else F.col("_doc")[c]).alias(c) for c in docs.columns])
