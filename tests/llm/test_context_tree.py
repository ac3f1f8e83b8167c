"""Context-tree scores against a plain recursion, base scores against counting."""

import math
import random
import zlib
from collections import Counter

import pytest

from lemmaforge.llm import gather
from lemmaforge.llm.context_tree import DEPTH, score_texts


class Plain:
    """Weighted context trees by their definition, one for each node of the byte tree."""

    def __init__(self, streams):
        self.counts = {}
        for stream in streams:
            for context, node, bit in choices(stream):
                for depth in range(DEPTH + 1):
                    self.counts.setdefault((node, context[:depth]), [0, 0])[bit] += 1
        self.below = {}
        for node, context in self.counts:
            if context:
                self.below.setdefault((node, context[:-1]), []).append((node, context))
        self.held = {}

    def estimate(self, key):
        z, o = self.counts[key]
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def weight(self, key):
        if key not in self.held:
            own = self.estimate(key)
            if len(key[1]) < DEPTH:
                deep = sum(map(self.weight, self.below[key]))
                top = max(own, deep)
                own = top + math.log(math.exp(own - top) + math.exp(deep - top)) - math.log(2)
            self.held[key] = own
        return self.held[key]

    def chance(self, node, context, depth=0):
        key = (node, context[:depth])
        if key not in self.counts:
            return 0.5
        z, o = self.counts[key]
        own = (o + 0.5) / (z + o + 1)
        if depth == DEPTH or (node, context[: depth + 1]) not in self.counts:
            return own
        ratio = self.estimate(key) - sum(map(self.weight, self.below[key]))
        share = 1 / (1 + math.exp(-ratio)) if ratio > -700 else 0.0
        return share * own + (1 - share) * self.chance(node, context, depth + 1)

    def score(self, stream):
        out = 0.0
        for context, node, bit in choices(stream):
            p = self.chance(node, context)
            out += math.log10(p if bit else 1 - p)
        return out


def choices(stream):
    padded = b"\n" * DEPTH + stream
    for at in range(DEPTH, len(padded)):
        node = 1
        for j in range(7, -1, -1):
            bit = padded[at] >> j & 1
            yield padded[at - DEPTH : at][::-1], node, bit
            node = node * 2 + bit


def tokens(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return (text or "").encode().translate(lower).split()


def expected(rows):
    known = [tokens(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for ws in known for w in [*ws, b"\n"])
    total, different = sum(counts.values()), len(counts)
    model = Plain(b" ".join(ws) + b"\n" for ws in known)
    out = []
    for i, text in rows:
        own = [*tokens(text), b"\n"]
        base = sum(math.log10((counts[w] + 1) / (total + different + 1)) for w in own)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        out.append((i, held, len(own), sum(counts[w] > 0 for w in own), total, base, model.score(b" ".join(own[:-1]) + b"\n")))
    return sorted(out, key=repr)


def compare(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' as key", "1 as chunk", "2 as slice")
    got = score_texts(df.repartition(parts)).collect()
    found = sorted(
        [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=repr
    )
    want = expected(rows)
    assert [f[:5] for f in found] == [w[:5] for w in want]
    for f, w in zip(found, want):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9)
    assert all(r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes) for r in got)


def documents(seed, count):
    rng = random.Random(seed)
    parts = ["the ", "An", "é ", "\t", "\x00", "漢字 ", "of\n", "tion ", " ", "x" * 40]
    return [(i, "".join(rng.choices(parts, k=rng.randint(0, 30)))) for i in range(count)]


def test_scores_follow_the_definition(spark):
    rows = documents(3, 40)
    rows += [(100, None), (101, ""), (102, "  \n"), (None, "the the"), (5, rows[5][1]), (5, rows[5][1]), (103, "zq" * 900)]
    compare(spark, rows)


def test_small_chunks_and_merges(spark, monkeypatch):
    """Many chunks, several merges of a slice and several parts that ask it give the same rows."""
    monkeypatch.setattr(gather, "MERGED", 2)
    monkeypatch.setattr(gather, "ASKED", 1)
    monkeypatch.setattr("lemmaforge.llm.context_tree.CHUNK_BYTES", 100)
    monkeypatch.setattr("lemmaforge.llm.context_tree.BLOCK", 37)
    monkeypatch.setattr("lemmaforge.llm.context_tree.SENT", 2)
    compare(spark, documents(4, 30), 2)


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    df = spark.createDataFrame([(i, "ab") for i in held], "doc_id bigint, text string")
    got = score_texts(df).collect()
    assert [r.score for r in got] == pytest.approx([24 * math.log10(0.5)] * 3)
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(2, 0, 0, 0.0)] * 3
    assert score_texts(df.limit(0)).collect() == []
