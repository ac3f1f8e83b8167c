"""Toxicity: boosted trees over dense features of a text, calibrated by isotonic regression.

The lexicon holds the words, and beginnings of words, that toxic documents of the labelled sample hold far more
often. The features of a fold are taken with a lexicon learnt without it; on folds 1 to 3 the trees are fitted, on
fold 4 the scores are calibrated. Scoring is one narrow pass with the lexicon of all folds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaforge.llm.labelled import FIT_ROWS, fold, labelled_sample
from lemmaforge.llm.words import alnum_words

LEXICON_WORDS = 5000  # kept at most, by their log odds
LEAST_LOG_ODDS = 2.5
STRONG_LOG_ODDS = 4.0
NEAR = 6  # words between a term and a second person
SECOND_PERSON = frozenset(
    w.encode()
    for w in "you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos tú usted ustedes vosotros tus".split()
)
# Digits and signs that stand for letters.
_PLAIN = str.maketrans("013457@$!|+€", "oieastasiite")
_DISGUISED = re.compile(r"(?<![^\s])(?=[^\s]*[A-Za-z])(?=[^\s]*[0-9@$!|+€*])[A-Za-z0-9@$!|+€*]{3,30}(?![^\s])")
STEMS = (4, 5, 6)  # beginnings of longer words that stand in the lexicon as terms of their own
FEATURES = [
    "strong hits, log", "strong hits a word", "weighted hits a word", "different hits", "mild hits a word", "hits near a second person",
    "second persons a word", "capitals", "words in capitals", "exclamation and question marks", "other punctuation", "disguised words",
    "disguised hits", "words, log",
]


def terms(word: str) -> list[str]:
    """A word and its beginnings, which carry a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Lexicon(dict):
    """The log odds of the best term of a word, 0 where none is known; a memo that empties itself when full."""

    def __init__(self, odds: dict[str, float], most: int = 200_000) -> None:
        super().__init__()
        self.odds, self.most = odds, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        found = max((self.odds.get(t, 0.0) for t in terms(word.decode("utf-8", "replace"))), default=0.0)
        self[word] = found
        return found


def learn_lexicons(sample: DataFrame, most: int = LEXICON_WORDS) -> dict[int, dict[str, float]]:
    """Terms and their log odds, at most `most`: learnt without fold k for each fold k, and from all folds (0).

    A term counts if its log odds are large and lie three standard errors above zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = ({w.decode("utf-8", "replace") for w in alnum_words(t.as_py()) if len(w) <= 40} for t in batch.column(0))
            found = [sorted({term for w in own for term in terms(w)}) for own in words]
            sizes = [len(f) for f in found]
            marks = [pa.array(np.repeat(batch.column(i).to_numpy(), sizes)) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array([w for f in found for w in f], pa.string()), *marks], names=["term", "label", "fold"])

    sizes = {(r.fold, r.label): r["count"] for r in sample.groupBy("fold", "label").count().collect()}
    size = lambda label, without: sum(n for (f, x), n in sizes.items() if x == label and f != without)
    own = sample.select("text", "label", F.col("fold").cast("bigint").alias("fold"))
    marked = own.mapInArrow(run, "term string, label double, fold bigint")
    by_fold = lambda label: [F.sum(((F.col("label") == label) & (F.col("fold") == k)).cast("int")).alias(f"{'ct'[label]}{k}") for k in (1, 2, 3, 4)]
    counts = marked.groupBy("term").agg(*by_fold(1), *by_fold(0)).where("t1 + t2 + t3 + t4 >= 3")
    odds, error = _odds(*(F.expr(f"{x}1 + {x}2 + {x}3 + {x}4") for x in "tc"), size(1, 0), size(0, 0), F.log, F.sqrt)
    # somewhat below the bound, so that what passes it without one fold is here as well
    top = counts.where((odds >= LEAST_LOG_ODDS - 0.5) & (odds >= 2.5 * error)).orderBy(odds.desc(), "term").limit(most).collect()
    out = {}
    for without in range(5):
        out[without] = {}
        for r in top:
            t, c = (sum(r[f"{x}{k}"] for k in (1, 2, 3, 4) if k != without) for x in "tc")
            own_odds, own_error = _odds(t, c, size(1, without), size(0, without), math.log, math.sqrt)
            if own_odds >= LEAST_LOG_ODDS and own_odds >= 3 * own_error:
                out[without][r.term] = own_odds
    return out


def _odds(t, c, toxic: int, clean: int, log, sqrt):
    """Log odds of a term in toxic against clean documents, and their standard error."""
    return log((t + 0.5) / (toxic + 1.0)) - log((c + 0.5) / (clean + 1.0)), sqrt(1.0 / (t + 0.5) + 1.0 / (c + 0.5))


def features_of(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of a text; all zero where there are no words."""
    words = alnum_words(text)
    if not words:
        return [0.0] * len(FEATURES)
    count, letters = len(words), max(1, len(text))
    known = list(map(lexicon.__getitem__, words))
    at = [i for i, o in enumerate(known) if o]
    odds = [known[i] for i in at]
    strong = sum(o >= STRONG_LOG_ODDS for o in odds)
    persons = sum(map(SECOND_PERSON.__contains__, words))
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in at) if persons else 0
    raw = text.encode()
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    loud = sum(map(str.isupper, text.split())) if capitals > letters // 10 else 0
    marks = raw.count(b"!") + raw.count(b"?")
    other = len(raw) - len(raw.translate(None, b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"))
    disguised = _DISGUISED.findall(text)
    unmasked = sum(lexicon[d.lower().translate(_PLAIN).encode()] > 0 for d in disguised)
    return [
        math.log1p(strong + unmasked), strong / count, sum(odds) / count, float(len({words[i] for i in at})), (len(at) - strong) / count,
        near / count, persons / count, capitals / letters, loud / count, marks / letters, other / letters, len(disguised) / count,
        unmasked / count, math.log1p(count),
    ]


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """`docs` with the text replaced by `features`."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    at = docs.columns.index("text")
    names = [c for c in docs.columns if c != "text"] + ["features"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Lexicon(shared.value)
        for batch in batches:
            rows = [features_of(t.as_py(), held) for t in batch.column(at)]
            others = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(rows, pa.list_(pa.float64()))], names=names)

    schema = docs.drop("text").withColumn("features", F.expr("cast(array() as array<double>)")).schema
    return docs.mapInArrow(run, schema).withColumn("features", array_to_vector("features"))


def score_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document: `doc_id`, `held_out`, `score` from 0 to 1 and `predicted`.

    Null and empty texts have features of zero and are scored as such. Repeated rows each get their row; null ids
    are not held out. Where the sample lacks one of the two labels in a fold that needs both, every score is the
    share of toxic documents in the sample. Only `doc_id` and `text` are read.
    """
    sample = labelled_sample(docs, labels, "toxic", fit_rows)
    seen = {(r.fold, r.label) for r in sample.groupBy("fold", "label").count().collect()}
    out = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    fitted = {label for k, label in seen if k != 4}, {label for k, label in seen if k == 4}
    if fitted != ({0.0, 1.0}, {0.0, 1.0}):
        share = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
        scored = out.select("doc_id", "held_out", F.lit(float(share)).alias("score"))
    else:
        lexicons = learn_lexicons(sample)
        folds = [with_features(sample.where(F.col("fold") == k).select("label", "fold", "text"), lexicons[k]) for k in (1, 2, 3, 4)]
        known = folds[0].union(folds[1]).union(folds[2])
        lexicon = lexicons[0]
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.2, seed=7)
        model = trees.fit(known)
        chance = vector_to_array("probability")[1]
        judged = model.transform(folds[3]).select("label", chance.alias("chance"))
        curve = IsotonicRegression(featuresCol="chance", labelCol="label", predictionCol="level").fit(judged)
        scored = curve.transform(model.transform(with_features(out, lexicon)).withColumn("chance", chance))
        # steps of the curve are ties; a hundredth of the uncalibrated chance keeps their order
        scored = scored.select("doc_id", "held_out", (0.99 * F.col("level") + 0.01 * F.col("chance")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
