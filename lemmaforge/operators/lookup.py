"""Batch lookup: key match, duplicates, redirects, dedupe, suggestions, resources.

Redirect targets and closures depend on (dictionary, key) alone, so they are
worked out once per distinct key and joined to the queries at the end.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmaforge.functions import keys as K
from lemmaforge.operators import ranking
from lemmaforge.session import cut_lineage

MAX_HOPS = 8
SUGGESTIONS = 8


class UnknownDictionary(ValueError):
    """An explicitly selected dictionary is absent or not healthy."""


def key_index(records: DataFrame) -> DataFrame:
    """Distinct keys of each dictionary with the place they first occur."""
    first = records.groupBy("dict_id", "key").agg(F.min("source_ord").alias("first_ord"))
    return (
        first.withColumn("norm_key", K.norm_key("key"))
        .withColumn("fold_key", K.lower_simple("norm_key"))
        .withColumn("join_key", K.join_key("fold_key"))
        .filter(F.col("fold_key") != "")
    )


def with_query_keys(queries: DataFrame, text: str = "query") -> DataFrame:
    return (
        queries.withColumn("q_trim", K.trim_space(text))
        .withColumn("q_norm", K.nfc("q_trim"))
        .withColumn("q_fold", K.lower_simple("q_norm"))
        .withColumn("join_key", K.join_key("q_fold"))
        .filter(F.col("q_trim") != "")
    )


def match_keys(queries: DataFrame, index: DataFrame, within: str | None = None) -> DataFrame:
    """The one key per (query, dictionary), by the best of four tiers.

    Every tier implies equal join keys, so a single equi-join finds all
    candidates. Queries are reduced to distinct texts first: a text asked a
    billion times is resolved once. With `within`, a query names the
    dictionary it belongs to.
    """
    asked = ["query"] + ([within] if within else [])
    texts = with_query_keys(queries.select(*asked).distinct())
    on = ["join_key"]
    if within:
        texts = texts.withColumnRenamed(within, "dict_id")
        on.append("dict_id")
    found = texts.join(index.select("dict_id", "key", "fold_key", "join_key", "first_ord"), on)
    tier = (
        F.when(F.col("key") == F.col("q_trim"), 1)
        .when(F.col("key") == F.col("q_norm"), 2)
        .when(F.col("key") == F.col("q_fold"), 3)
        .when((F.col("fold_key") == F.col("q_fold")) & (F.col("fold_key") != F.col("key")), 4)
    )
    return (
        found.withColumn("tier", tier.cast("bigint"))
        .filter(F.col("tier").isNotNull())
        .groupBy("query", "dict_id")
        .agg(F.min(F.struct("tier", "first_ord", "key")).alias("best"))
        .select("query", "dict_id", F.col("best.key").alias("matched_key"), F.col("best.tier").alias("tier"))
    )


def numbered_records(records: DataFrame) -> DataFrame:
    """Position among records of the same key, redirect target, branch number.

    `branch` counts the redirects of the key that come before the record.
    Depth-first order of resolved records is the order of
    [2*branch+1 per hop ..., 2*branch, raw_ord], which needs no whole key
    group in one task.
    """
    targeted = records.withColumn("link", K.link_target("content"))
    return ranking.running_position(
        targeted,
        ["dict_id", "key"],
        "source_ord",
        name="raw_ord",
        sums={"branch": F.col("link").isNotNull().cast("int")},
    )


def expand_duplicates(matches: DataFrame, numbered: DataFrame) -> DataFrame:
    """All records under the matched key, both keys kept."""
    return matches.join(
        numbered.withColumnRenamed("key", "matched_key"), ["dict_id", "matched_key"]
    )


def redirect_edges(numbered: DataFrame, index: DataFrame) -> DataFrame:
    """Resolved redirects: (dict_id, from_key, branch, to_key)."""
    links = numbered.filter(F.col("link").isNotNull()).select(
        "dict_id", F.col("key").alias("from_key"), "branch", F.col("link").alias("query")
    )
    targets = match_keys(links, index, within="dict_id").select(
        "dict_id", "query", F.col("matched_key").alias("to_key")
    )
    return links.join(targets, ["dict_id", "query"]).select(
        "dict_id", "from_key", "branch", "to_key", K.norm_key("to_key").alias("to_norm")
    )


def redirect_closure(roots: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Every key reached from each root, with the branch path that leads there.

    `roots` holds (dict_id, key). A branch ends on a key already on its path;
    siblings go on. Each round reads the last frontier from a checkpoint, and
    the loop stops with the last frontier that has rows.
    """
    frontier = roots.select(
        "dict_id",
        F.col("key").alias("root"),
        F.col("key").alias("node"),
        F.array().cast("array<bigint>").alias("path"),
        F.array(K.norm_key("key")).alias("seen"),
        F.lit(0).cast("bigint").alias("depth"),
    )
    edges = cut_lineage(edges)
    levels = [frontier]
    for depth in range(1, max_hops + 1):
        step = (
            levels[-1]
            .join(edges, (F.col("node") == F.col("from_key")) & (levels[-1]["dict_id"] == edges["dict_id"]))
            .filter(~F.array_contains("seen", F.col("to_norm")))
            .select(
                levels[-1]["dict_id"],
                "root",
                F.col("to_key").alias("node"),
                F.array_append("path", F.col("branch") * 2 + 1).alias("path"),
                F.array_append("seen", F.col("to_norm")).alias("seen"),
                F.lit(depth).cast("bigint").alias("depth"),
            )
        )
        step = cut_lineage(step)
        if step.isEmpty():
            break
        levels.append(step)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("dict_id", "root", "node", "path", "depth")


def resolved_records(roots: DataFrame, numbered: DataFrame, edges: DataFrame) -> DataFrame:
    """Resolved records of each root key, with `order_path` for source order."""
    reached = redirect_closure(roots, edges)
    leaves = numbered.filter(F.col("link").isNull()).select(
        "dict_id", F.col("key").alias("node"), "raw_ord", "branch", "source_ord", "content"
    )
    return reached.join(leaves, ["dict_id", "node"]).select(
        "dict_id",
        F.col("root").alias("key"),
        F.col("node").alias("matched_key"),
        F.when(F.col("depth") > 0, F.col("root")).alias("redirected_from"),
        "raw_ord",
        "source_ord",
        "depth",
        F.concat("path", F.array(F.col("branch") * 2, F.col("raw_ord"))).alias("order_path"),
        "content",
    )


def first_paths(roots: DataFrame, edges: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """Every key reached from each root, once, by the first path in depth-first order.

    Of the paths to a key at one depth only the first goes on, and only if no shallower one comes before it: whatever
    a later path finds from there with as few hops left, the earlier one has found, or keys on its way have. So a
    round holds at most one row for each root and key, where all paths would multiply with each hop. The argument
    needs that a key on the path bars that key alone; where spellings share a normal form and bar each other
    (`twins`), paths are compared only with those that bar the same.
    """
    edges = edges.groupBy("dict_id", "from_key", "to_key", "to_norm").agg(F.min("branch").alias("branch"))
    met = edges.select("dict_id", F.col("to_key").alias("key"), F.col("to_norm").alias("norm")).union(
        roots.select("dict_id", "key", K.norm_key("key"))
    )
    shared = met.distinct().groupBy("dict_id", "norm").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = shared.select("dict_id", "norm", F.lit(True).alias("shared"))
    edges = cut_lineage(edges.join(shared.withColumnRenamed("norm", "to_norm"), ["dict_id", "to_norm"], "left"))
    none = F.array().cast("array<string>")
    start = roots.select("dict_id", "key", K.norm_key("key").alias("norm")).distinct().join(shared, ["dict_id", "norm"], "left")
    level = cut_lineage(
        start.select(
            "dict_id",
            F.col("key").alias("root"),
            F.col("key").alias("node"),
            F.when(F.col("shared"), F.array("norm")).otherwise(none).alias("twins"),
            F.array().cast("array<bigint>").alias("path"),
            F.array("norm").alias("seen"),
        )
    )
    place = ["dict_id", "root", "node", "twins"]
    kept = level
    for _ in range(max_hops):
        step = (
            level.join(edges.withColumnRenamed("from_key", "node"), ["dict_id", "node"])
            .filter(~F.array_contains("seen", F.col("to_norm")))
            .select(
                "dict_id",
                "root",
                F.col("to_key").alias("node"),
                F.when(F.col("shared"), F.array_sort(F.array_append("twins", F.col("to_norm")))).otherwise(F.col("twins")).alias("twins"),
                F.array_append("path", F.col("branch") * 2 + 1).alias("path"),
                F.array_append("seen", F.col("to_norm")).alias("seen"),
            )
            .groupBy(*place)
            .agg(F.min(F.struct("path", "seen")).alias("_first"))
            .select(*place, "_first.*")
        )
        before = kept.groupBy(*place).agg(F.min("path").alias("_before"))
        level = cut_lineage(
            step.join(before, place, "left")
            .filter(F.col("_before").isNull() | (F.col("path") < F.col("_before")))
            .drop("_before")
        )
        if level.isEmpty():
            break
        kept = kept.unionByName(level)
    first = kept.groupBy("dict_id", "root", "node").agg(F.min("path").alias("path"))
    return first.withColumn("depth", F.size("path").cast("bigint"))


def first_records(roots: DataFrame, numbered: DataFrame, edges: DataFrame) -> DataFrame:
    """The same rows as `dedupe_content(resolved_records(...))`, without laying out every path."""
    leaves = numbered.filter(F.col("link").isNull()).select(
        "dict_id", F.col("key").alias("node"), "raw_ord", "branch", "source_ord", "content", F.sha2("content", 256).alias("content_hash")
    )
    leaves = ranking.first_by(leaves, ["dict_id", "node", "content_hash"], ["raw_ord"])
    rows = first_paths(roots, edges).join(leaves, ["dict_id", "node"]).select(
        "dict_id",
        F.col("root").alias("key"),
        F.col("node").alias("matched_key"),
        F.when(F.col("depth") > 0, F.col("root")).alias("redirected_from"),
        "raw_ord",
        "source_ord",
        "depth",
        F.concat("path", F.array(F.col("branch") * 2, F.col("raw_ord"))).alias("order_path"),
        "content",
        "content_hash",
    )
    return ranking.first_by(rows, ["dict_id", "key", "content_hash"], ["order_path"])


def dedupe_content(resolved: DataFrame, keys: Sequence[str] = ("dict_id", "key")) -> DataFrame:
    """First record of each identical content, as a mergeable aggregate."""
    hashed = resolved.withColumn("content_hash", F.sha2("content", 256))
    return ranking.first_by(hashed, [*keys, "content_hash"], ["order_path"])


def visible_ordinals(
    records: DataFrame, keys: Sequence[str] = ("dict_id", "key"), chunk: int = ranking.CHUNK_ROWS
) -> DataFrame:
    """Consecutive ordinals 1..n in source order.

    The stretch of a row is its order path with the last number cut down to a
    multiple of `chunk`; whole stretches keep the order of the rows in them.
    """
    last = F.element_at("order_path", -1)
    cut = records.withColumn(
        "_stretch",
        F.concat(
            F.slice("order_path", 1, F.size("order_path") - 1),
            F.array(F.floor(last / F.lit(chunk)).cast("bigint")),
        ),
    )
    part = [*keys, "_stretch"]
    counts = cut.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_n0", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*part).orderBy("order_path")
    return (
        cut.join(offsets, part)
        .withColumn("rec_ord", (F.col("_n0") + F.row_number().over(inside)).cast("bigint"))
        .drop("_stretch", "_n0")
    )


def lookup(queries: DataFrame, records: DataFrame) -> DataFrame:
    """Whole lookup of (query) texts: one row per visible record of each answer."""
    index = key_index(records)
    matches = match_keys(queries, index)
    numbered = numbered_records(records)
    roots = matches.select("dict_id", F.col("matched_key").alias("key")).distinct()
    answers = visible_ordinals(first_records(roots, numbered, redirect_edges(numbered, index)))
    return matches.withColumnRenamed("matched_key", "lookup_key").join(
        answers.withColumnRenamed("key", "lookup_key"), ["dict_id", "lookup_key"]
    )


def select_dictionaries(dictionaries: DataFrame, ids: Sequence[str] | None = None) -> DataFrame:
    """P10: the caller's order, or all healthy ones in registry order."""
    healthy = dictionaries.filter(F.col("health") == "ok")
    if not ids:
        return healthy.withColumn("sel_ord", F.col("dict_ord").cast("bigint"))
    wanted = list(dict.fromkeys(ids))
    spark = dictionaries.sparkSession
    picked = spark.createDataFrame([(x, i) for i, x in enumerate(wanted)], "dict_id string, sel_ord bigint")
    out = healthy.join(picked, "dict_id")
    found = {r[0] for r in out.select("dict_id").distinct().limit(len(wanted)).collect()}
    missing = [x for x in wanted if x not in found]
    if missing:
        raise UnknownDictionary(", ".join(missing))
    return out


def find_dictionary(dictionaries: DataFrame, text: str) -> DataFrame:
    """By id, else by a case-insensitive piece of the title; one hit wanted."""
    exact = dictionaries.filter(F.col("dict_id") == text)
    if not exact.isEmpty():
        return exact
    hits = dictionaries.filter(F.contains(F.lower("title"), F.lit(text.lower())))
    found = hits.limit(2).count()
    if found != 1:
        raise UnknownDictionary(f"{text}: {'ambiguous' if found else 'not found'}")
    return hits


def first_answering(answers: DataFrame, selection: DataFrame, limit: int) -> DataFrame:
    """The first `limit` dictionaries that answer each query, in selection order."""
    pairs = answers.select("query", "dict_id").distinct().join(selection.select("dict_id", "sel_ord"), "dict_id")
    return ranking.top_k(pairs, ["query"], [F.col("sel_ord").asc()], limit, "dict_rank")


def pick_ordinal(answers: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The asked record of each answer, and errors carrying the number available."""
    sizes = answers.groupBy("query", "dict_id").agg(F.max("rec_ord").alias("available"))
    picked = answers.join(wanted, "query").filter(F.col("rec_ord") == F.col("ordinal"))
    errors = sizes.join(wanted, "query").filter(F.col("ordinal") > F.col("available"))
    return picked, errors


def prefix_suggest(
    queries: DataFrame, records: DataFrame, selection: DataFrame, limit: int = SUGGESTIONS
) -> DataFrame:
    """Keys that start with the folded query, for queries nothing answered.

    Only prefixes as long as some query are laid out, so the prefix condition
    is an equi-join. Per dictionary the first `limit` records in source order
    count (a key can use up several); spellings equal under normalisation are
    given once, dictionaries in selection order, spellings sorted in each.
    """
    texts = with_query_keys(queries.select("query").distinct()).select("query", "q_fold")
    folds = texts.select("q_fold").distinct()
    lengths = folds.select(F.length("q_fold").alias("len")).distinct()
    few = ranking.top_k(
        records.select("dict_id", "key", "source_ord"), ["dict_id", "key"], [F.col("source_ord")], limit, "_n"
    )
    heads = (
        few.withColumn("norm_key", K.norm_key("key"))
        .withColumn("fold_key", K.lower_simple("norm_key"))
        .filter(F.col("fold_key") != "")
        .withColumn("len", F.explode(F.sequence(F.lit(1), F.length("fold_key"))))
        .join(lengths, "len")
        .select("dict_id", "key", "norm_key", "source_ord", F.expr("left(fold_key, len)").alias("q_fold"))
    )
    hits = heads.join(folds, "q_fold")
    per_dict = ranking.top_k(hits, ["q_fold", "dict_id"], [F.col("source_ord").asc()], limit, "_r")
    ordered = per_dict.join(selection.select("dict_id", "sel_ord"), "dict_id")
    distinct = ranking.first_by(
        ordered.select("q_fold", "norm_key", "key", "sel_ord"), ["q_fold", "norm_key"], ["sel_ord", "key"]
    )
    best = ranking.top_k(distinct, ["q_fold"], [F.col("sel_ord"), F.col("key")], limit, "rank")
    return texts.join(best, "q_fold").select("query", "rank", F.col("key").alias("suggestion"))


def resolve_resources(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """The resource of each reference: best candidate, then first volume.

    `refs` has (dict_id, ref); `resources` has (dict_id, res_key, volume).
    """
    candidates = (
        refs.select("dict_id", "ref")
        .distinct()
        .select("dict_id", "ref", F.posexplode(K.resource_candidates("ref")).alias("cand", "res_key"))
    )
    first = resources.groupBy("dict_id", "res_key").agg(F.min("volume").alias("volume"))
    return ranking.first_by(
        candidates.join(first, ["dict_id", "res_key"]), ["dict_id", "ref"], ["cand", "volume"]
    )


def has_resource(refs: DataFrame, resources: DataFrame) -> DataFrame:
    """References of which some candidate exists."""
    candidates = refs.withColumn("res_key", F.explode(K.resource_candidates("ref")))
    hit = candidates.join(resources.select("dict_id", "res_key"), ["dict_id", "res_key"], "left_semi")
    return hit.drop("res_key").distinct()


def missing_stylesheets(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Local style sheets in no folder or index, in first-seen order.

    `links` has (dict_id, href, position).
    """
    local = (
        links.withColumn("sheet", K.stylesheet_path("href"))
        .filter(F.col("sheet").isNotNull())
        .withColumn("sheet_key", F.lower("sheet"))
    )
    first = ranking.first_by(local.select("dict_id", "sheet_key", "sheet", "position"), ["dict_id", "sheet_key"], ["position"])
    present = has_resource(
        first.select("dict_id", F.col("sheet").alias("ref")), resources
    ).select("dict_id", F.col("ref").alias("sheet"))
    return first.join(present, ["dict_id", "sheet"], "left_anti").select("dict_id", "sheet", "position")


def pair_raw_semantic(raw: DataFrame, semantic: DataFrame) -> DataFrame:
    """Raw records joined to structured ones by matched key and raw ordinal."""
    return raw.join(semantic, ["dict_id", "matched_key", "raw_ord"])


def close_ranges(entries: DataFrame, order: str = "source_ord") -> DataFrame:
    """An open end (0) becomes the next strictly greater start; the last stays 0.

    Starts ascend with the order, so the next greater start is the next
    distinct start of the dictionary: the window runs over distinct starts.
    """
    starts = entries.select("dict_id", "start_off").distinct()
    # consecutive starts meet inside stretches; the first of a later stretch closes the last of an earlier one
    cut = starts.withColumn("_chunk", F.floor(F.col("start_off") / F.lit(1 << 30)))
    heads = cut.groupBy("dict_id", "_chunk").agg(F.min("start_off").alias("_head"))
    following = Window.partitionBy("dict_id").orderBy("_chunk")
    heads = heads.withColumn("_next_head", F.lead("_head").over(following)).drop("_head")
    inside = Window.partitionBy("dict_id", "_chunk").orderBy("start_off")
    nexts = cut.join(heads, ["dict_id", "_chunk"]).select(
        "dict_id", "start_off", F.coalesce(F.lead("start_off").over(inside), F.col("_next_head")).alias("_next")
    )
    return entries.join(nexts, ["dict_id", "start_off"]).withColumn(
        "end_off", F.when(F.col("end_off") == 0, F.coalesce("_next", F.lit(0))).otherwise(F.col("end_off"))
    ).drop("_next")


def sibling_selectors(answers: DataFrame, selected: int = 1) -> DataFrame:
    """Key plus superscript ordinal, for the records beside the selected one."""
    label = F.concat(
        "lookup_key", F.translate(F.col("rec_ord").cast("string"), "0123456789", K.SUPERSCRIPTS)
    )
    return answers.filter(F.col("rec_ord") != selected).select(
        "query", "dict_id", "rec_ord", label.alias("selector")
    )
