"""Personal data, and the terms that reveal it.

Addresses, numbers and the like are found by patterns. In their documents stand words; how much a word tells of the
entity is their pointwise mutual information over the corpus, as a share of the information of the entity itself.
Counts are smoothed by a confidence bound, so that rare entities are judged too, and a word must be associated with the
entity beyond what chance gives among all pairs that are judged (a log-likelihood ratio against a bound that grows with
their number). Equal texts count once. A word that tells more than the threshold is generalised or removed in the
documents that hold the entity. Only DataFrame expressions are used: counts are grouped sums, and texts move only where
a document holds a revealing term.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaforge.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# Possessive repeats and the look-behind change no match: they keep long runs from being tried at every place.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
WORD = r"[\p{L}\p{N}]++"
SURE = 1.645  # standard deviations: what a term tells is so surely at least that much (95 %)
CHANCE = 0.05  # how likely one innocent pair of all may pass the test of association
DISCLOSURE = 0.8  # share of the entity's information a term may tell
REMOVE = 0.95  # beyond it a term goes, below it is generalised
BLOCK = 256
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "name": "[NAME]", "acronym": "[ACRONYM]", "gone": ""}


def places(text: Column, pattern: str | Column) -> Column:
    """Leftmost non-overlapping matches: `start`, `end` (code points, end exclusive) and `value`.

    Starts are sums of what stands before, block after block, so that many matches cost no square.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))
    empty = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")

    def go_on(held: Column, step: Column) -> Column:
        start = held["at"] + step["gap"]
        end = start + F.length(step["value"])
        own = F.struct(start.alias("start"), end.alias("end"), step["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(own)).alias("out"))

    def block(held: Column, i: Column) -> Column:
        part = F.slice(steps, i * BLOCK + 1, F.lit(BLOCK))
        done = F.aggregate(part, F.struct(held["at"].alias("at"), empty.alias("out")), go_on)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(held["out"], F.array(d["out"])).alias("out")))[0]

    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    nothing = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start: int, end: int, value: string>>>)").alias("out"))
    return F.when(F.size(found) == 0, empty).otherwise(F.flatten(F.aggregate(blocks, nothing, block)["out"]))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Digits from the right, every second doubled and its digits summed, are a multiple of ten."""
    turned = F.reverse(number)
    each = lambda i: F.substr(turned, i, F.lit(1)).cast("int")
    twice = lambda i: 2 * each(i) - F.when(each(i) > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, each(i)).otherwise(twice(i)))
    return total % 10 == 0


def base_places(text: Column, kind: str) -> Column:
    """Places of a kind that also pass its test; a match that fails is dropped and not tried again."""
    may = {
        "email": F.contains(text, F.lit("@")), "ip": F.rlike(text, F.lit(r"[0-9]\.[0-9]")),
        "card": F.rlike(text, F.lit("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]")), "phone": F.contains(text, F.lit("+")),
    }[kind]
    size = lambda p: F.length(digits(p["value"]))
    fits = {
        "email": lambda p: F.lit(True),
        "ip": lambda p: F.rlike(p["value"], F.lit(rf"^{_PART}(\.{_PART}){{3}}$")),
        "card": lambda p: F.when((size(p) >= 13) & (size(p) <= 19), passes_luhn(digits(p["value"]))).otherwise(False),
        "phone": lambda p: (size(p) >= 9) & (size(p) <= 15),
    }[kind]
    found = places(text, PATTERNS[kind])
    return F.when(may, F.filter(found, fits) if kind != "email" else found).otherwise(F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)"))


def with_base(docs: DataFrame) -> DataFrame:
    """`docs` with `text` never null, `_key` of the text, and an array of places for each kind."""
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumns({"_key": F.xxhash64("text"), **{f"_{k}": base_places(F.col("text"), k) for k in KINDS}})


def text_terms(text: Column) -> Column:
    """The distinct words of a text that may be terms, outside addresses; other entities hold no letters."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~F.rlike(w, F.lit("[0-9]")))


def word_frequencies(based: DataFrame, copied: DataFrame) -> DataFrame:
    """`term` and in how many distinct texts it stands; `copied` has `_key` and `_rows` of the texts of several rows.

    Each of n equal rows counts one n-th, so that texts need not meet to count once.
    """
    weighed = based.select("_key", "text").join(copied, "_key", "left")
    each = weighed.select(F.explode(text_terms(F.col("text"))).alias("term"), F.coalesce(1 / F.col("_rows"), F.lit(1.0)).alias("_part"))
    return each.groupBy("term").agg(F.round(F.sum("_part")).cast("bigint").alias("c_t"))


def surely(hits: Column, of: Column) -> Column:
    """Lower end of the confidence interval of a share (Wilson): few cases prove little, however pure they are."""
    share, square = hits / of, SURE * SURE
    spread = SURE * F.sqrt(share * (1 - share) / of + square / (4 * of * of))
    return (share + square / (2 * of) - spread) / (1 + square / of)


def association(c_et: Column, c_e: Column, c_t: Column, n: Column) -> Column:
    """Log-likelihood ratio of the two by two table of entity and term; 0 where they meet less often than by chance."""
    cell = lambda seen, row, column: F.when(seen > 0, seen * F.log(seen * n / (row * column))).otherwise(0.0)
    both = cell(c_et, c_e, c_t) + cell(c_e - c_et, c_e, n - c_t) + cell(c_t - c_et, n - c_e, c_t)
    both = both + cell(n - c_e - c_t + c_et, n - c_e, n - c_t)
    return F.when(c_et * n > c_e * c_t, 2 * both).otherwise(0.0)


def least_association(pairs: float, chance: float = CHANCE) -> float:
    """The ratio that none of so many innocent pairs passes but with the given chance (chi-square tail, one degree)."""
    wanted = 2 * math.log(max(1.0, pairs) / chance) + math.log(2 / math.pi)
    ratio = max(1.0, wanted)
    for _ in range(50):
        ratio = max(1.0, wanted - math.log(ratio))
    return ratio


def entity_texts(based: DataFrame) -> DataFrame:
    """`doc_id`, `_key`, the distinct `entities` and the distinct `words` of every document that holds an entity."""
    def entities(kind: str) -> Column:
        value = lambda p: F.lower(p["value"]) if kind == "email" else digits(p["value"]) if kind in ("card", "phone") else p["value"]
        return F.transform(f"_{kind}", lambda p: F.concat(F.lit(f"{kind}:"), value(p)))

    some = based.where(" + ".join(f"size(_{k})" for k in KINDS) + " > 0")
    return some.select("doc_id", "_key", F.array_distinct(F.concat(*map(entities, KINDS))).alias("entities"), text_terms(F.col("text")).alias("words"))


def revealing_terms(seen: DataFrame, frequencies: DataFrame, n_texts: int, disclosure: float = DISCLOSURE) -> DataFrame:
    """`_key`, `term` and `told`: the terms that reveal an entity of the text, with the most they tell of one.

    Every entity and every term of its texts is judged. All four counts are of distinct texts, so copies change nothing. Entities
    that stand in the same texts are told by the same terms and are scored once, so that lists of them cost no square.
    """
    texts = cut_lineage(seen.select("_key", "entities", "words").dropDuplicates(["_key"]))
    judged = texts.agg(F.sum(F.size("entities").cast("double") * F.size("words"))).first()[0] or 0.0
    n = F.lit(float(max(2, n_texts)))
    # more frequent terms cannot tell enough of an entity in c_e texts, even if they stand in all of these
    most = lambda c_e: F.pow(c_e, F.lit(disclosure)) * F.pow(n, F.lit(1 - disclosure)) * 1.0001
    each = texts.select("_key", F.explode("entities").alias("entity"))
    same = F.xxhash64(F.count("*"), F.bit_xor(F.xxhash64("_key")), F.bit_xor(F.xxhash64("_key", F.lit(1)))).alias("same")
    of = cut_lineage(each.groupBy("entity").agg(F.count("*").alias("c_e"), same))
    held = cut_lineage(each.join(of, "entity").select("_key", "same", "c_e").distinct())
    top = held.agg(F.max("c_e")).first()[0] or 1
    reach = held.groupBy("_key").agg(F.max("c_e").alias("_top"))
    rare = texts.select("_key", F.explode("words").alias("term")).join(frequencies.where(F.col("c_t") <= most(F.lit(top))), "term")
    rare = cut_lineage(rare.join(reach, "_key").where(F.col("c_t") <= most(F.col("_top"))).select("_key", "term", "c_t"))
    pairs = held.join(rare, "_key").where(F.col("c_t") <= most(F.col("c_e")))
    pairs = pairs.groupBy("same", "c_e", "term", "c_t").agg(F.count("*").alias("c_et"))
    c_e, c_t = F.least(F.col("c_e"), n - 1), F.greatest("c_t", "c_et")
    share = F.log(surely(F.col("c_et"), c_t) * n / c_e) / F.log(n / c_e)
    real = association(F.col("c_et"), c_e, F.least(c_t, n - 1), n) >= least_association(judged)
    told = cut_lineage(pairs.where(real).select("same", "term", share.alias("told")).where(F.col("told") >= disclosure))
    # only the texts that hold the term, which an entity of several texts need not do in each
    return held.join(told, "same").join(rare.select("_key", "term"), ["_key", "term"]).groupBy("_key", "term").agg(F.max("told").alias("told"))


def term_places(based: DataFrame) -> DataFrame:
    """`doc_id`, `_key` and `terms` (places with `told`) of the documents that hold revealing terms."""
    seen = cut_lineage(entity_texts(based))
    rows = cut_lineage(based.groupBy("_key").agg(F.count("*").alias("_rows")))
    by_term = revealing_terms(seen, cut_lineage(word_frequencies(based, rows.where("_rows > 1"))), rows.count())
    by_text = cut_lineage(by_term.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("term", "told"))).alias("_told")))
    listed = cut_lineage(seen.select("doc_id", "_key").distinct().join(by_text, "_key"))
    # only documents with an entity are listed, so no other text moves
    some = based.where(" + ".join(f"size(_{k})" for k in KINDS) + " > 0")
    held = some.join(listed.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), "_told"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")))
    held = held.select("doc_id", "_key", "text", "_told", F.concat(*(f"_{k}" for k in KINDS)).alias("_base"), F.lower("text").alias("_low"))
    own = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.map_keys("_told"), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    # places in the lower text are those in the text, unless a letter became two
    slow = F.filter(places(F.col("text"), WORD), lambda w: F.map_contains_key("_told", F.lower(w["value"])))
    words = F.when(F.length("_low") == F.length("text"), places(F.col("_low"), own)).otherwise(slow)
    free = F.filter(words, lambda w: ~F.exists("_base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    marked = F.transform(free, lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.col("_told")[F.lower(w["value"])].alias("told")))
    return held.select("doc_id", "_key", marked.alias("terms")).where("size(terms) > 0").dropDuplicates(["doc_id", "_key"])


def find_private(docs: DataFrame) -> DataFrame:
    """`docs` with `text` never null, places of `email`, `ip`, `card` and `phone`, and `terms` that reveal them.

    Null texts are empty and hold nothing. Repeated rows each get their row; null ids are an id of their own. Columns
    of `docs` with these names are replaced.
    """
    based = with_base(docs.drop(*KINDS, "terms", "_key", "_terms"))
    terms = cut_lineage(term_places(based.select("doc_id", "_key", "text", *(f"_{k}" for k in KINDS))))
    named = terms.select(F.col("doc_id").alias("_d"), F.col("_key").alias("_k"), F.col("terms").alias("_terms"))
    out = based.join(named, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left").drop("_d", "_k", "_key")
    none = F.expr("cast(array() as array<struct<start: int, end: int, told: double>>)")
    return out.withColumn("terms", F.coalesce("_terms", none)).drop("_terms").withColumnsRenamed({f"_{k}": k for k in KINDS})


def listed(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all places, by kind and start."""
    text = lambda k: F.transform("terms" if k == "term" else k, lambda p: F.concat_ws(":", F.lit(k), p["start"].cast("string"), p["end"].cast("string")))
    return F.array_join(F.concat(*(text(k) for k in kinds)), ",")


def private_report(docs: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    found = find_private(docs.select("doc_id", "text"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(KINDS), 256).alias("base_sha256"), listed((*KINDS, "term")).alias("spans"))


def sanitise(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """`docs` with entities and revealing terms replaced in `text`, and `n_chars` counted anew where that changed it.

    Of places that overlap, the first (the longer, if they start together) stands for all. Null texts stay null.
    """
    names = docs.columns
    # the columns of `docs` travel in one, so that none clashes with those made here
    others = F.struct(*[F.col(c) for c in names if c != "text"]).alias("_doc")
    found = find_private(docs.select("doc_id", "text", F.col("text").isNull().alias("_null"), others))
    mark = lambda p, label: F.struct(p["start"].alias("start"), (-p["end"]).alias("back"), label.alias("label"))
    marked = lambda kind: F.transform(kind, lambda p: mark(p, F.lit(LABELS[kind])))
    said = lambda p: F.substr("text", p["start"] + 1, p["end"] - p["start"])
    kind = lambda w: (
        F.when(F.rlike(w, F.lit(r"^\p{Lu}{2,}$")), LABELS["acronym"]).when(F.rlike(w, F.lit(r"^\p{Lu}")), LABELS["name"]).otherwise(LABELS["general"])
    )
    terms = F.transform("terms", lambda p: mark(p, F.when(p["told"] >= remove, LABELS["gone"]).otherwise(kind(said(p)))))
    spans = [*map(marked, KINDS), terms]
    found = found.withColumn("_spans", F.array_sort(F.concat(*spans))).drop(*KINDS, "terms")

    def go_on(held: Column, p: Column) -> Column:
        own = F.concat(F.substr("text", held["at"] + 1, p["start"] - held["at"]), p["label"])
        on = F.struct((-p["back"]).alias("at"), F.concat(held["out"], F.array(own)).alias("out"))
        wider = F.struct(F.greatest(held["at"], -p["back"]).alias("at"), held["out"].alias("out"))
        return F.when(p["start"] >= held["at"], on).otherwise(wider)

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    found = found.withColumn("_done", F.aggregate("_spans", start, go_on))
    rest = F.concat(F.array_join("_done.out", ""), F.substr("text", F.col("_done.at") + 1, F.length("text")))
    text = F.when(F.col("_null"), None).when(F.size("_spans") == 0, F.col("text")).otherwise(rest)
    out = found.withColumn("_new", text)
    changed = lambda c: F.when(F.size("_spans") == 0, F.col("_doc")[c]).otherwise(F.length("_new").cast(docs.schema[c].dataType))
    given = {"text": F.col("_new")} | ({"n_chars": changed("n_chars")} if "n_chars" in names else {})
    return out.select(*[given.get(c, F.col("_doc")[c]).alias(c) for c in names])
