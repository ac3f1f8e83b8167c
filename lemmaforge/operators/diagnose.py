"""Corpus diagnostics: samples, markup histograms, coverage, votes, families."""

from __future__ import annotations

import math

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaforge.functions import keys as K
from lemmaforge.functions import text as T
from lemmaforge.functions import vocab as V
from lemmaforge.functions.markup import TEXT
from lemmaforge.operators import nodes as N
from lemmaforge.operators import ranking
from lemmaforge.session import cut_lineage

MIN_RECORD_BYTES = 120
FAMILY_OVERLAP = 0.7


def stride_sample(records: DataFrame, limit: int) -> DataFrame:
    """A1: every n div limit-th key of each dictionary, blanks and repeats out."""
    placed = ranking.running_position(records.select("dict_id", "key", "source_ord"), ["dict_id"], "source_ord")
    sizes = records.groupBy("dict_id").agg(F.count(F.lit(1)).alias("_n"))
    stride = F.greatest(F.floor(F.col("_n") / F.lit(limit)), F.lit(1))
    struck = (
        placed.join(sizes, "dict_id")
        .filter(F.pmod(F.col("position") - 1, stride) == 0)
        .withColumn("key", K.trim_space("key"))
        .filter(F.col("key") != "")
    )
    first = ranking.first_seen(struck, ["dict_id"], "key", "position")
    return ranking.top_k(first, ["dict_id"], [F.col("position")], limit, "sample_ord")


# Pieces of text that point at a recording.
AUDIO_HINTS = ["sound://", "snd://", ".mp3", ".spx", ".wav", ".ogg"]


def record_score(content: Column | str, limit: int | None = None) -> Column:
    """A2: how much of a template the markup of a record shows. A `limit` reads only so many tags and class attributes."""
    raw = K.col(content)
    low = F.lower(raw)
    some = lambda found: found if limit is None else F.slice(found, 1, limit)
    tags = F.array_distinct(some(T.find_all(low, "<([a-z][a-z0-9]*)", 1)))
    quoted = some(T.find_all(low, r"class\s*=\s*(?:\"[^\"]*\"|'[^']*')"))
    values = F.transform(quoted, lambda q: F.regexp_replace(q, r"^class\s*=\s*[\"']|[\"']$", ""))
    names = F.filter(F.split(F.array_join(values, " "), r"\s+"), lambda c: c != "")
    distinct = F.array_distinct(names)
    # names in order: one stands three times if it equals the second after it and not the one before
    line = F.array_sort(names)
    triples = F.arrays_zip(line.alias("a"), F.slice(line, F.lit(3), F.size(line)).alias("b"), F.concat(F.array(F.lit("")), line).alias("c"))
    repeated = F.filter(triples, lambda t: (t["a"] == t["b"]) & (t["a"] != t["c"]))
    audio = low.rlike("(" + "|".join(h.replace(".", r"\.") for h in AUDIO_HINTS) + ")")
    link = F.contains(low, F.lit("entry://")) | F.contains(low, F.lit("<a "))
    return (
        F.least(F.size(tags), F.lit(12))
        + F.least(F.size(distinct), F.lit(20))
        + F.least(F.floor(F.octet_length(raw) / 512), F.lit(10))
        + F.least(F.size(repeated), F.lit(6))
        + F.when(audio, 3).otherwise(0)
        + F.when(link, 2).otherwise(0)
    ).cast("bigint")


def representative_samples(records: DataFrame, pool: int, keep: int) -> DataFrame:
    """A3: best-scored records of a strided pool, repeats of one content out.

    `records` has dict_id, key, source_ord, content with one record per key
    and source_ord unique per dictionary.
    """
    # sampled keys come first; only their contents are read
    chosen = stride_sample(records, pool * 3).select("dict_id", "key", "sample_ord")
    first = ranking.first_by(
        records.select("dict_id", K.trim_space("key").alias("key"), "source_ord", "content").join(
            chosen, ["dict_id", "key"]
        ),
        ["dict_id", "key", "sample_ord"],
        ["source_ord"],
    )
    large = first.filter(F.octet_length("content") >= MIN_RECORD_BYTES).withColumn("_hash", F.sha2("content", 256))
    distinct = ranking.first_by(large, ["dict_id", "_hash"], ["sample_ord"])
    pooled = ranking.top_k(distinct, ["dict_id"], [F.col("sample_ord")], pool, "_p").drop("_p", "_hash")
    scored = pooled.withColumn("score", record_score("content"))
    return ranking.top_k(scored, ["dict_id"], [F.col("score").desc(), F.col("sample_ord")], keep, "rank")


def markup_counts(nodes: DataFrame) -> DataFrame:
    """A4: (dict_id, kind, name, n) of tags, classes, attributes, signatures, schemes.

    All five histograms come from one pass over the nodes; each task adds up
    its own names before anything is sent.
    """
    elements = nodes.filter(F.col("tag") != TEXT)
    pair = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
    refs = F.array_compact(F.array(*[F.col("attrs")[a] for a in ("href", "src", "addr", "data-src", "data-src-mp3")]))
    names = F.concat(
        F.array(pair("tag", F.col("tag"))),
        F.transform("classes", lambda c: pair("class", c)),
        F.transform("classes", lambda c: pair("signature", F.concat("tag", F.lit("."), c))),
        F.transform(F.map_keys("attrs"), lambda a: pair("attribute", a)),
        F.transform(refs, lambda r: pair("scheme", K.reference_scheme(r))),
    )
    return (
        elements.select("dict_id", F.explode(names).alias("x"))
        .filter(F.trim("x.name") != "")
        .groupBy("dict_id", "x.kind", "x.name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# How many names of each kind a summary keeps.
SUMMARY_SIZES = {"tag": 15, "class": 25, "attribute": 12, "scheme": 8, "signature": 10}


def markup_summary(nodes: DataFrame) -> DataFrame:
    """A4: the commonest names of each kind per dictionary."""
    sizes = F.create_map(*[F.lit(x) for pair in SUMMARY_SIZES.items() for x in pair])
    ranked = ranking.top_k(
        markup_counts(nodes), ["dict_id", "kind"], [F.col("n").desc(), F.col("name")], max(SUMMARY_SIZES.values())
    )
    return ranked.filter(F.col("rank") <= F.element_at(sizes, F.col("kind")))


def depth_and_size(nodes: DataFrame, records: DataFrame) -> DataFrame:
    """A4: deepest nesting and upper median of record bytes per dictionary."""
    deepest = nodes.groupBy("dict_id").agg((F.max("depth") + 1).cast("bigint").alias("max_depth"))
    sizes = ranking.upper_median(
        records.select("dict_id", F.octet_length("content").cast("bigint").alias("bytes")), ["dict_id"], "bytes", "median_bytes"
    )
    return deepest.join(sizes, "dict_id")


def vocabularies(counts: DataFrame, size: int = 12) -> DataFrame:
    """A5: the commonest names per dictionary, sorted, and the key of their template.

    `counts` has (dict_id, name, n).
    """
    best = ranking.top_k(counts, ["dict_id"], [F.col("n").desc(), F.col("name")], size)
    # at most `size` names per dictionary are collected
    listed = best.groupBy("dict_id").agg(F.sort_array(F.collect_list("name")).alias("vocabulary"))
    key = F.left(F.sha2(F.array_join("vocabulary", "\0"), 256), F.lit(12))
    return listed.withColumn("family_key", F.when(F.size("vocabulary") >= 4, key))


def template_families(vocab: DataFrame, overlap: float = FAMILY_OVERLAP, least: int = 6) -> DataFrame:
    """Dictionaries whose vocabularies coincide, by single linkage.

    Dictionaries with the same vocabulary are one point, so a template copied
    a million times is compared once. Two that overlap enough share some of
    the few rarest names of each (prefix filter); points meet in up to three
    of those together, as many as the overlap and the least size warrant.
    Points are then linked by passing on the least label until none changes.
    """
    together = max(1, min(3, math.ceil(overlap * least)))
    enough = cut_lineage(vocab.filter(F.size("vocabulary") >= least).select("dict_id", "vocabulary"))
    points = enough.groupBy("vocabulary").agg(F.min("dict_id").alias("point"))
    points = cut_lineage(points)
    names = points.select("point", F.explode("vocabulary").alias("name"))
    rarity = names.groupBy("name").agg(F.count(F.lit(1)).alias("df"))
    # sets of size s and overlap t share l names among the s - ceil(t*s) + l rarest of each
    size = F.size("vocabulary")
    rarest = (
        names.join(rarity, "name")
        .groupBy("point")
        .agg(F.sort_array(F.collect_list(F.struct("df", "name"))).alias("_names"))
        .join(points, "point")
        .withColumn("_p", F.transform(F.slice("_names", F.lit(1), (size - F.ceil(size * overlap) + together).cast("int")), lambda x: x["name"]))
    )
    # each round puts one later name behind every group so far
    groups = F.transform("_p", lambda x, i: F.struct(i.alias("at"), F.array(x).alias("names")))
    for _ in range(together - 1):
        more = lambda g: F.transform(
            F.filter(F.transform("_p", lambda x, i: F.struct(i.alias("at"), x.alias("name"))), lambda y: y["at"] > g["at"]),
            lambda y: F.struct(y["at"].alias("at"), F.array_append(g["names"], y["name"]).alias("names")),
        )
        groups = F.flatten(F.transform(groups, more))
    groups = F.transform(groups, lambda g: F.array_join(g["names"], "\0"))
    rare = rarest.select("point", "vocabulary", F.explode(groups).alias("shared_names"))
    other = rare.select("shared_names", F.col("point").alias("point_b"), F.col("vocabulary").alias("vocabulary_b"))
    shared = F.size(F.array_intersect("vocabulary", "vocabulary_b"))
    union = F.size("vocabulary") + F.size("vocabulary_b") - shared
    pairs = (
        rare.join(other, "shared_names")
        .filter((F.col("point") < F.col("point_b")) & (shared / union >= overlap))
        .select("point", "point_b")
        .distinct()
    )
    labels = linked_components(points.select("point"), pairs)
    members = enough.join(points.select("vocabulary", "point"), "vocabulary").join(labels, "point")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    return members.join(sizes.filter(F.col("size") >= 2), "label").select(
        F.col("label").alias("family"), "dict_id", "size", "vocabulary"
    )


def linked_components(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """Least label per connected component: (point, label).

    Each round takes the least label among neighbours and then the label of
    that label, so chains shorten by half or better.
    """
    both = cut_lineage(
        pairs.select(F.col("point").alias("a"), F.col("point_b").alias("b")).unionByName(
            pairs.select(F.col("point_b").alias("a"), F.col("point").alias("b"))
        )
    )
    labels = cut_lineage(points.select("point", F.col("point").alias("label")))
    while True:
        near = (
            both.join(labels.select(F.col("point").alias("b"), F.col("label").alias("near")), "b")
            .groupBy(F.col("a").alias("point"))
            .agg(F.min("near").alias("near"))
        )
        step = labels.join(near, "point", "left").select(
            "point", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        jump = step.select(F.col("point").alias("label"), F.col("label").alias("next"))
        step = cut_lineage(
            step.join(jump, "label", "left").select("point", "old", F.least("label", F.coalesce("next", "label")).alias("label"))
        )
        changed = not step.filter(F.col("old") != F.col("label")).isEmpty()
        labels = step.select("point", "label")
        if not changed:
            return labels


def family_report(members: DataFrame) -> DataFrame:
    """Size and shared names of each family, larger first.

    A name is shared when as many members have it as there are members.
    """
    names = members.select("family", "size", F.explode("vocabulary").alias("name"))
    shared = names.groupBy("family", "size", "name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.col("size"))
    listed = shared.groupBy("family").agg(F.sort_array(F.collect_list("name")).alias("shared"))
    sizes = members.groupBy("family").agg(F.max("size").alias("size"), F.min("dict_id").alias("first_member"))
    return sizes.join(listed, "family", "left").select(
        "family", "size", "first_member", F.array_join(F.coalesce("shared", F.array()), ",").alias("shared")
    )


def coverage(entries: DataFrame) -> DataFrame:
    """Per dictionary, samples that yielded each kind, rates, median senses.

    `entries` has one row per record with counts: n_headwords, n_pos,
    n_definitions, n_translations, n_examples, n_ipa, n_forms, n_phrases,
    n_cross, n_sections, n_fallback, n_senses, n_items.
    """
    some = lambda c: F.count_if(F.col(c) > 0)
    fallback = (F.col("n_fallback") > 0) & (F.col("n_senses") == 0)
    base = entries.groupBy("dict_id").agg(
        F.count(F.lit(1)).alias("samples"),
        some("n_headwords").alias("headword"),
        some("n_pos").alias("part_of_speech"),
        some("n_definitions").alias("definitions"),
        some("n_translations").alias("translations"),
        some("n_examples").alias("examples"),
        some("n_ipa").alias("ipa"),
        some("n_forms").alias("forms"),
        some("n_phrases").alias("phrases"),
        some("n_cross").alias("cross_references"),
        some("n_sections").alias("sections"),
        F.count_if(fallback).alias("fallback"),
        some("n_senses").alias("structured"),
        F.count_if(F.col("n_items") == 0).alias("empty"),
    )
    rated = base.withColumn("structured_rate", F.col("structured") / F.col("samples")).withColumn(
        "fallback_rate", F.col("fallback") / F.col("samples")
    )
    return rated.join(ranking.upper_median(entries, ["dict_id"], "n_senses", "median_senses"), "dict_id")


def warnings(covered: DataFrame) -> DataFrame:
    """Names of the rules a dictionary trips.

    `covered` is A7's output with median_bytes, max_senses, max_definition,
    duplicate_samples, mixed_definitions, translated, headwords, mismatches.
    """
    c = F.col
    rules = [
        ("no-samples", c("samples") == 0),
        ("rich-html-no-definitions", (c("definitions") == 0) & (c("median_bytes") >= 1500)),
        ("high-fallback-rate", (c("samples") >= 3) & (c("fallback_rate") >= 0.5)),
        ("examples-without-definitions", (c("examples") > 0) & (c("definitions") == 0)),
        (
            "content-only-in-untyped-sections",
            (c("structured") == 0) & (c("sections") > 0) & (c("fallback") == 0),
        ),
        ("implausible-sense-count", c("max_senses") > 40),
        ("oversized-definition", c("max_definition") > 800),
        ("duplicate-definitions", c("duplicate_samples") > 0),
        ("bilingual-without-translations", (c("mixed_definitions") > 0) & (c("translated") == 0)),
        (
            "headword-unlike-lookup-key",
            (c("headwords") >= 3) & (c("mismatches") >= F.lit(0.6) * c("headwords")),
        ),
    ]
    sampled = c("samples") > 0
    listed = [F.when(hit if name == "no-samples" else sampled & hit, name) for name, hit in rules]
    return covered.withColumn("warnings", F.array_compact(F.array(*listed)))


def profile_scores(nodes: DataFrame, profiles: Sequence[dict], titles: DataFrame | None = None) -> DataFrame:
    """A10: (dict_id, rec_id, profile, score) of the profiles whose every selector matches.

    A profile is a dict with id, selectors, and optionally title patterns and
    require_title. All selectors are tried on a node in one pass.
    """
    tried = [(p["id"], i, s) for p in profiles for i, s in enumerate(p["selectors"])]
    nodes = N.marked(nodes, **{f"_hit_{n}": s for n, (_, _, s) in enumerate(tried)})
    flags = [
        F.struct(F.lit(name).alias("profile"), F.lit(i).alias("sel"), F.col(f"_hit_{n}").alias("hit"))
        for n, (name, i, _) in enumerate(tried)
    ]
    met = (
        nodes.select("dict_id", "rec_id", F.explode(F.filter(F.array(*flags), lambda x: x["hit"])).alias("x"))
        .groupBy("dict_id", "rec_id", "x.profile")
        .agg(F.count_distinct("x.sel").alias("met"))
    )
    wanted = F.create_map(*[F.lit(x) for p in profiles for x in (p["id"], len(p["selectors"]))])
    full = met.filter(F.col("met") == F.element_at(wanted, F.col("profile")))
    if titles is None:
        return full.select("dict_id", "rec_id", "profile", (F.col("met") * 5).alias("score"))
    hits = F.lit(0)
    barred = F.lit(False)
    for p in profiles:
        own = F.col("profile") == p["id"]
        matched = sum([F.col("title").rlike(t).cast("int") for t in p.get("titles", [])], F.lit(0))
        hits = hits + F.when(own, matched).otherwise(0)
        if p.get("require_title"):
            barred = barred | (own & (matched == 0))
    return full.join(titles, "dict_id").filter(~barred).select(
        "dict_id", "rec_id", "profile", (F.col("met") * 5 + hits * 2).alias("score")
    )


def profile_vote(scores: DataFrame, samples: DataFrame) -> DataFrame:
    """The profile most samples of a dictionary agree on, and how strongly.

    `samples` has (dict_id, n): samples seen per dictionary.
    """
    tally = scores.filter(F.col("score") > 0).groupBy("dict_id", "profile").agg(
        F.count(F.lit(1)).alias("matched"), F.sum("score").alias("score")
    )
    order = Window.partitionBy("dict_id").orderBy(F.col("matched").desc(), F.col("score").desc(), F.col("profile"))
    tied = (F.lead("matched").over(order) == F.col("matched")) & (F.lead("score").over(order) == F.col("score"))
    best = (
        tally.withColumn("_tied", F.coalesce(tied, F.lit(False)))
        .withColumn("_r", F.row_number().over(order))
        .filter(F.col("_r") == 1)
    )
    few = (F.col("matched") * 2 < F.col("n")) | ((F.col("n") > 1) & (F.col("matched") < 2))
    strength = F.when(F.col("matched").isNull(), "absent").when(few, "weak").when(F.col("_tied"), "conflicting").otherwise("strong")
    return (
        samples.join(best, "dict_id", "left")
        .withColumn("strength", strength)
        .select("dict_id", "strength", F.when(F.col("strength") == "strong", F.col("profile")).otherwise("generic").alias("selected"))
    )


def pronunciation_evidence(nodes: DataFrame, resources: DataFrame) -> DataFrame:
    """Samples with transcription, with recordings named, references resolved.

    `nodes` carries dict_id; `resources` has (dict_id, res_key).
    """
    elements = nodes.filter(F.col("tag") != TEXT)
    texts = N.with_texts(nodes, elements.select("rec_id", "pre", "end", "dict_id"), "own")
    ipa = texts.groupBy("dict_id", "rec_id").agg(F.bool_or(V.looks_like_ipa("own")).alias("has_ipa"))
    refs = N.references(nodes).join(nodes.select("rec_id", "dict_id").distinct(), "rec_id")
    cut = F.regexp_replace(F.lower("ref"), "(?s)[?#].*$", "")
    audio = refs.filter((F.col("scheme") != "") & (cut.rlike(r"\.(mp3|spx|wav|ogg|m4a)$") | F.lower("ref").rlike("^(sound|snd)://")))
    found = (
        audio.select("dict_id", "rec_id", "pre", "ref", F.explode(K.resource_candidates("ref")).alias("res_key"))
        .join(resources.select("dict_id", "res_key").distinct(), ["dict_id", "res_key"], "left_semi")
        .select("dict_id", "rec_id", "pre", "ref")
        .distinct()
        .groupBy("dict_id")
        .agg(F.count(F.lit(1)).alias("audio_resolved"))
    )
    described = N.descriptor_text(nodes, elements.join(audio.select("rec_id", "pre").distinct(), ["rec_id", "pre"], "left_semi"))
    regions = (
        described.select("dict_id", "rec_id", V.region_of("descriptor").alias("region"))
        .groupBy("dict_id")
        .agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("region") == "other", "unmarked").otherwise(F.col("region")))), ",").alias("regions"))
    )
    with_audio = audio.groupBy("dict_id").agg(F.count_distinct("rec_id").alias("audio_samples"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return (
        ipa.groupBy("dict_id")
        .agg(F.count_if("has_ipa").alias("ipa_samples"))
        .join(with_audio, "dict_id", "left")
        .join(found, "dict_id", "left")
        .join(regions, "dict_id", "left")
        .select("dict_id", "ipa_samples", zero("audio_samples"), zero("audio_resolved"), F.coalesce("regions", F.lit("")).alias("regions"))
    )


def corpus_totals(covered: DataFrame) -> DataFrame:
    """Dictionaries with each kind, classes of structure, plain means of rates."""
    some = lambda c: F.count_if(F.col(c) > 0)
    return covered.filter(F.col("samples") > 0).agg(
        F.count(F.lit(1)).alias("sampled"),
        some("definitions").alias("with_definitions"),
        some("examples").alias("with_examples"),
        some("translations").alias("with_translations"),
        some("ipa").alias("with_ipa"),
        F.count_if(F.col("structured_rate") >= 0.8).alias("strong_structure"),
        F.count_if(F.col("fallback_rate") >= 0.5).alias("heavy_fallback"),
        F.count_if(F.col("fallback_rate") == 1).alias("fully_unparsed"),
        F.round(F.avg("structured_rate"), 9).alias("mean_structured_rate"),
        F.round(F.avg("fallback_rate"), 9).alias("mean_fallback_rate"),
    )


def resource_kinds(resources: DataFrame) -> DataFrame:
    """Distinct resources by extension."""
    ext = F.lower(K.extension("res_key"))
    return ranking.counted(
        resources.select("dict_id", "res_key").distinct().select("dict_id", F.when(ext == "", "(none)").otherwise(ext).alias("ext")),
        ["dict_id"],
        "ext",
    )


def compatibility(covered: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Dictionary by capability; the known kinds are columns, so no distinct pass is needed."""
    long = covered.select(
        "dict_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds])).alias("x")
    )
    return long.groupBy("dict_id").pivot("x.kind", list(kinds)).agg(F.max(F.col("x.n") > 0))
