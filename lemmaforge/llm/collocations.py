"""Collocations: phrases of two to five words that occur together more often than their parts let expect.

Counts come from truncated suffix trees, partitioned vertically by the prefixes of suffixes. A chunk of documents
(`gather`) numbers its words; the merged counts tell which are frequent, and a phrase with a rare word is rare itself.
A suffix is a place in a text and up to five frequent words from there. Suffixes are dealt by their first word, packed
into groups within a budget. Prefixes over the budget are extended by a word until their suffixes fit, or the suffix is
spent. A group builds its subtree by itself: suffixes in order, and the count of a node is the sum of its leaves.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaforge.llm.gather import ENTRY, SLICES, WORDS, answer_entries, merge_entries, pack, run_starts, unpack, unpack_words
from lemmaforge.llm.words import mix
from lemmaforge.session import cut_lineage

CHUNK_BYTES = 6 << 20  # text of a chunk, which is passed only by a single longer document
MOST_WORDS = 5
LEAST = 100  # occurrences of a candidate
TOP = 2000  # collocations of a language
GROUP_ROWS = 2_000_000  # suffixes of a group, about
GROUPS = 1 << 15  # of which there are about so many at most; a larger corpus has larger groups
COVERED = 100  # per cent of a phrase's occurrences that a longer one must hold to replace it
WORD_BITS = 21  # of a word's number within its slice

_BREAK = b"."
# A-Z is lower-cased, the signs that end a piece become full stops, tabs become spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def piece_words(text: str | None) -> list[bytes]:
    """Words of a text with a full stop at each end of a piece. Null and empty texts have none."""
    return text.encode().translate(_PLAIN).replace(_BREAK, b" . ").split() if text else []


class _Numbers(dict):
    """Numbers of a language's words within a chunk, from 1 on; 0 parts pieces."""

    def __init__(self, lang: str, keys: list[bytes]) -> None:
        super().__init__({_BREAK: 0})
        self.lang, self.keys = b" " + quote(lang, safe="").encode(), keys

    def __missing__(self, word: bytes) -> int:
        self.keys.append(word + self.lang)
        self[word] = number = len(self.keys)
        return number


def _word_of(key: bytes) -> tuple[str, str]:
    word, lang = key.rsplit(b" ", 1)
    return word.decode(), unquote(lang.decode())


def chunk_tokens(docs: DataFrame) -> DataFrame:
    """Rows of two sorts, written once: `tokens` of a chunk (numbers of its words) and its entries of words and counts.

    The words of a chunk are numbered in the order of their entries' slices. Reads `lang` and `text` of `docs`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        keys: list[bytes] = []
        langs: dict[str, _Numbers] = {}
        held: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            slices = np.fromiter((zlib.crc32(k) % SLICES for k in keys), np.int64, len(keys))
            order = np.argsort(slices, kind="stable")
            numbers = np.zeros(len(keys) + 1, np.int32)
            numbers[order + 1] = np.arange(1, len(keys) + 1)
            tokens = numbers[np.concatenate(held)]
            counts = np.bincount(tokens, minlength=len(keys) + 1)[1:]
            starts = run_starts(slices[order])
            parts = np.split(order, starts[1:]) if len(order) else []
            ends = [*starts[1:].tolist(), len(order)]
            columns = [
                pa.array([chunk] * (1 + len(parts)), pa.int64()),
                pa.array([None, *(int(slices[p[0]]) for p in parts)], pa.int32()),
                pa.array([None, *map(len, parts)], pa.int64()),
                pa.array([None, *(WORDS.pack([keys[i] for i in p.tolist()]) for p in parts)], pa.binary()),
                pa.array([None, *(pack(counts[a:b]) for a, b in zip(starts.tolist(), ends))], pa.binary()),
                pa.array([pack(tokens), *[None] * len(parts)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "slice", "size", "keys", "counts", "tokens"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = text.as_py()
                words = piece_words(value)
                if lang not in langs:
                    langs[lang] = _Numbers(lang, keys)
                found = np.fromiter(map(langs[lang].__getitem__, words), np.int32, len(words))
                held += [found, np.zeros(1, np.int32)]
                size += len(value or "") + 1
                if size >= CHUNK_BYTES:
                    yield closed()
                    chunk, size = chunk + 1, 0
                    keys, langs, held = [], {}, []
        if held:
            yield closed()

    return cut_lineage(docs.select("lang", "text").mapInArrow(run, f"{ENTRY}, tokens binary"))


def _frequent(counts: np.ndarray, number: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a slice are frequent, and the number of each (0 for the others)."""
    kept = counts >= least
    if kept.sum() >= 1 << WORD_BITS:
        raise OverflowError("a slice holds too many frequent words: raise SLICES")
    return kept, np.where(kept, (number << WORD_BITS) + np.cumsum(kept), 0).astype(np.int32)


def _vocabulary(known: DataFrame, least: int) -> DataFrame:
    """`lang`, `word`, `id` and `f` of the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                counts = unpack(counts, np.int64)
                kept, ids = _frequent(counts, number, least)
                rows = [(*_word_of(k), i, n) for k, i, n in zip(unpack_words(keys), ids.tolist(), counts.tolist()) if i]
                word, lang, own, f = zip(*rows) if rows else ((),) * 4
                fields = [pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(own, pa.int32()), pa.array(f, pa.int64())]
                yield pa.RecordBatch.from_arrays(fields, names=["lang", "word", "id", "f"])

    return known.select("slice", "keys", "counts").mapInArrow(run, "lang string, word string, id int, f bigint")


def _totals(known: DataFrame) -> DataFrame:
    """`lang` and `n`, all its word occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(c.to_pylist() for c in batch.columns)):
                table = pa.table({"lang": [k.rsplit(b" ", 1)[1] for k in unpack_words(keys)], "n": unpack(counts, np.int64)})
                table = table.group_by("lang").aggregate([("n", "sum")])
                langs = [unquote(x.decode()) for x in table["lang"].to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), table["n_sum"].combine_chunks()], names=["lang", "n"])

    return known.select("keys", "counts").mapInArrow(run, "lang string, n bigint").groupBy("lang").agg(F.sum("n").alias("n"))


def _numbered(least: int, budget: int) -> Callable[[dict], Callable[[list[bytes]], tuple[bytes, bytes]]]:
    """What a slice tells of words: their numbers and their groups. Rare words have number 0, words over the budget group -1."""

    def answer(row: dict) -> Callable[[list[bytes]], tuple[bytes, bytes]]:
        counts = unpack(row["counts"], np.int64)
        kept, ids = _frequent(counts, row["slice"], least)
        light = np.where(kept & (counts <= budget), counts, 0)
        groups = np.where(light > 0, (row["slice"] << 32) + (np.cumsum(light) - light) // budget, -1)
        at = {k: i for i, k in enumerate(unpack_words(row["keys"]))}

        def told(keys: list[bytes]) -> tuple[bytes, bytes]:
            places = np.fromiter(map(at.__getitem__, keys), np.int64, len(keys))
            return pack(ids[places]), pack(groups[places])

        return told

    return answer


def in_order(suffixes: np.ndarray) -> np.ndarray:
    """The order of suffixes (five rows of word numbers, 0 behind the end) by their words."""
    pair = lambda a, b: (suffixes[a].astype(np.int64) << 32) | suffixes[b]
    return np.lexsort([suffixes[4], pair(2, 3), pair(0, 1)])


def prefix_hash(suffixes: np.ndarray, size: int) -> np.ndarray:
    out = mix(suffixes[0].astype(np.uint64))
    for words in suffixes[1:size]:
        out = mix(out + words.astype(np.uint64))
    return out


def differs(suffixes: np.ndarray, size: int) -> np.ndarray:
    """Where, among suffixes in order, the prefix of `size` words is another than before."""
    new = np.any(suffixes[:size, 1:] != suffixes[:size, :-1], axis=0)
    return np.flatnonzero(np.concatenate([[True], new])) if suffixes.shape[1] else np.zeros(0, int)


def text_suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of at least two words, and their places."""
    padded = np.concatenate([words, np.zeros(MOST_WORDS, words.dtype)])
    at = np.flatnonzero((words > 0) & (padded[1 : len(words) + 1] > 0))
    out = [padded[at], padded[at + 1]]
    for k in range(2, MOST_WORDS):
        out.append(np.where(out[-1] > 0, padded[at + k], 0))
    return np.stack(out), at


def _pack_groups(groups: np.ndarray, suffixes: np.ndarray, counts: np.ndarray) -> pa.Table:
    order = np.argsort(groups, kind="stable")
    parts = np.split(order, run_starts(groups[order])[1:]) if len(order) else []
    columns = {
        "group": pa.array([int(groups[p[0]]) for p in parts], pa.int64()),
        "suffixes": pa.array([pack(suffixes[:, p]) for p in parts], pa.binary()),
        "counts": pa.array([pack(counts[p]) for p in parts], pa.binary()),
    }
    return pa.table(columns)


SUFFIX = "group bigint, suffixes binary, counts binary"


def _chunk_suffixes(left: pa.Table, right: pa.Table) -> pa.Table:
    """Distinct suffixes of a chunk, by group."""
    rows = sorted(zip(*(right[c].to_pylist() for c in ("slice", "ids", "groups"))))
    ids = np.concatenate([np.zeros(1, np.int32), *(unpack(r[1], np.int32) for r in rows)])
    groups = np.concatenate([np.zeros(1, np.int64), *(unpack(r[2], np.int64) for r in rows)])
    tokens = unpack(left["tokens"][0].as_py(), np.int32)
    suffixes, at = text_suffixes(ids[tokens])
    order = in_order(suffixes)
    suffixes, at = suffixes[:, order], at[order]
    starts = differs(suffixes, MOST_WORDS)
    counts = np.diff(starts, append=len(at))
    return _pack_groups(groups[tokens[at[starts]]], suffixes[:, starts], counts)


def _read(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for suffixes, counts in zip(table["suffixes"].to_pylist(), table["counts"].to_pylist()):
        yield unpack(suffixes, np.int32).reshape(MOST_WORDS, -1), unpack(counts, np.int64)


def over_budget(heavy: DataFrame, budget: int) -> list[np.ndarray]:
    """Hashes of the prefixes of 2, 3 and 4 words that have more suffixes than the budget, or more than half of it.

    Of each chunk only prefixes with a fair share count: what the others could add up to is below half the budget. So
    the list has at most 2 x suffixes / budget members, and `budget` bounds that.
    """
    chunks = heavy.count()
    fair = max(1, budget // (2 * max(1, chunks)))
    over: list[np.ndarray] = []
    for size in range(2, MOST_WORDS):

        def run(batches: Iterator[pa.RecordBatch], size: int = size) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for suffixes, _ in _read(batch):
                    if size > 2:
                        suffixes = suffixes[:, np.isin(prefix_hash(suffixes, size - 1), over[-1])]
                    suffixes = suffixes[:, suffixes[size - 1] > 0]
                    starts = differs(suffixes, size)
                    counts = np.diff(starts, append=suffixes.shape[1])
                    large = counts >= fair
                    hashes = prefix_hash(suffixes[:, starts[large]], size).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(counts[large], pa.int64())], names=["h", "n"])

        sums = heavy.select("suffixes", "counts").mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
        rows = sums.where(F.col("n") >= budget // 2).collect()
        over.append(np.array([r.h for r in rows], np.int64).astype(np.uint64))
        if not rows:
            break
    return over


def _is_over(suffixes: np.ndarray, size: int, over: list[np.ndarray]) -> np.ndarray:
    if size - 2 >= len(over) or not len(over[size - 2]):
        return np.zeros(suffixes.shape[1], bool)
    return np.isin(prefix_hash(suffixes, size), over[size - 2])


def _extend(heavy: DataFrame, over: list[np.ndarray], groups: int) -> DataFrame:
    """Suffixes of words over the budget, dealt by the shortest prefix of two or more words that is not over it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for suffixes, counts in _read(batch):
                route = prefix_hash(suffixes, 2)
                open_ = _is_over(suffixes, 2, over)
                for size in range(3, MOST_WORDS + 1):
                    route = np.where(open_, prefix_hash(suffixes, size), route)
                    open_ &= _is_over(suffixes, size, over)
                dealt = -1 - (route % np.uint64(groups)).astype(np.int64)
                yield from _pack_groups(dealt, suffixes, counts).to_batches()

    return heavy.mapInArrow(run, SUFFIX)


def count_tree(suffixes: np.ndarray, counts: np.ndarray, least: int, over: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Prefixes of 2 to 5 words with at least `least` occurrences, and those over the budget, with their leaf totals."""
    order = np.argsort((suffixes[0].astype(np.int64) << 32) | suffixes[1], kind="stable")
    for size in range(2, MOST_WORDS + 1):
        suffixes, counts = suffixes[:, order], counts[order]
        starts = differs(suffixes, size)
        total = np.add.reduceat(counts, starts) if len(starts) else counts
        kept = (suffixes[size - 1, starts] > 0) & ((total >= least) | _is_over(suffixes[:, starts], size, over))
        yield suffixes[:size, starts[kept]], total[kept]
        # what is too rare here cannot be part of a frequent longer prefix
        left = np.repeat(kept, np.diff(starts, append=len(counts)))
        suffixes, counts = suffixes[:, left], counts[left]
        order = in_order(suffixes) if size == 2 else np.arange(len(counts))


def phrase_counts(suffixes: DataFrame, least: int, over: list[np.ndarray]) -> DataFrame:
    """`phrase` (word numbers) and `f` of the phrases with at least `least` occurrences."""

    def run(table: pa.Table) -> pa.Table:
        held, counts = zip(*_read(table))
        tables = []
        for phrases, f in count_tree(np.concatenate(held, axis=1), np.concatenate(counts), least, over):
            size, rows = phrases.shape
            offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * size)
            tables.append(pa.table({"phrase": pa.ListArray.from_arrays(offsets, pa.array(phrases.T.ravel(), pa.int32())), "f": pa.array(f, pa.int64())}))
        return pa.concat_tables(tables)

    counted = suffixes.groupBy("group").applyInArrow(run, "phrase array<int>, f bigint")
    return counted.groupBy("phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def frequent_phrases(docs: DataFrame, least: int = LEAST, group_rows: int = GROUP_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (`phrase`, `f`), frequent words (`lang`, `word`, `id`, `f`), and `lang`, `n`. Each is written once."""
    rows = chunk_tokens(docs)
    entries = rows.where("slice is not null").select("chunk", "slice", "size", "keys", "counts")
    known = cut_lineage(merge_entries(entries, WORDS))
    totals, vocabulary = cut_lineage(_totals(known)), cut_lineage(_vocabulary(known, least))
    occurrences = totals.agg(F.sum("n")).first()[0] or 0
    budget = max(group_rows, math.ceil(occurrences / GROUPS))
    told = answer_entries(entries, known, WORDS, "ids binary, groups binary", _numbered(least, budget))
    tokens = rows.where("slice is null").select("chunk", "tokens")
    answers = told.select("chunk", "slice", "ids", "groups")
    suffixes = cut_lineage(tokens.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_chunk_suffixes, SUFFIX))
    light, heavy = suffixes.where("group >= 0"), suffixes.where("group < 0")
    over = over_budget(heavy, budget)
    dealt = light.union(_extend(heavy, over, max(1, math.ceil(occurrences / budget))))
    return cut_lineage(phrase_counts(dealt, least, over)), vocabulary, totals


def cut_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)), exact beyond 64 bits (to 38 digits)."""
    big = lambda c: c.cast("decimal(19,0)")
    over, under = F.lit(1000).cast("decimal(4,0)") * big(a) * big(n), big(left) * big(right)
    return F.call_function("div", over, under)


def parts_of(phrase: str) -> Column:
    """All contiguous parts of a phrase of two words or more, itself not among them."""
    size = F.size(phrase)
    one = lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.slice(F.col(phrase), i, k))
    return F.flatten(F.transform(F.sequence(F.lit(2), size - 1), one))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The first `top` collocations of each language: `lang`, `rank`, `phrase`, `a`, `l`, `r`, `n`, `score`.

    Null languages are `und`, null texts empty. Repeated rows count each. Ties go by `a`, then by the phrase's bytes.
    An empty table has none. Columns other than `lang` and `text` are not read.
    """
    picked = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    phrases, words, totals = frequent_phrases(picked, least, group_rows)
    longer = phrases.where(F.size("phrase") > 2).select(F.explode(parts_of("phrase")).alias("part"), "f")
    longer = longer.groupBy("part").agg(F.max("f").alias("most"))
    kept = phrases.join(longer, F.col("phrase") == F.col("part"), "left")
    kept = kept.where(F.col("most").isNull() | (100 * F.col("most") < covered * F.col("f"))).select("phrase", F.col("f").alias("a"))
    held = words.select(F.col("id").alias("_id"), "lang").join(totals, "lang")
    kept = kept.join(held, F.col("phrase")[0] == F.col("_id")).drop("_id")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)))
    cuts = cuts.withColumn("_left", F.expr("slice(phrase, 1, k)")).withColumn("_right", F.expr("slice(phrase, k + 1, size(phrase) - k)"))
    counted = phrases.union(words.select(F.array("id"), "f"))
    cuts = cuts.join(counted.toDF("_left", "l"), "_left").join(counted.toDF("_right", "r"), "_right")
    cuts = cuts.withColumn("score", cut_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    best = cuts.groupBy("phrase", "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spelt = best.select("*", F.posexplode("phrase").alias("_at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("phrase", "lang", "a", "n", "cut").agg(F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_words"))
    spelt = spelt.select("lang", F.array_join("_words.word", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
