"""Markup as a node table: selectors, visible text, scopes, blocks, tables.

A document is read to an array of nodes and placed by record as one row; the
rows are opened after that. Every window and aggregate over `rec_id` then works
where the nodes already are: one shuffle serves all steps, and none is needed
where a step only counts nodes.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaforge.functions import keys as K
from lemmaforge.functions import text as T
from lemmaforge.functions.markup import TEXT, node_structs
from lemmaforge.functions.vocab import has_region_marker
from lemmaforge.operators.intervals import below, inside, nearest_above, parents, stack_join

# Elements that stand apart from the text around them.
BLOCK_TAGS = [
    "div", "p", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "ul", "ol", "table",
]
SILENT_TAGS = ["script", "style", "head"]


def html_nodes(records: DataFrame, content: str = "content", placed: bool = True) -> DataFrame:
    """One row per element or text. `records` has rec_id and the content.

    With `placed`, the nodes of a record stand in one partition, known to the
    planner. The outer form of the explode keeps the planner from adding a
    filter that would read every document twice; there is always a node.
    """
    read = records.withColumn("_nodes", node_structs(F.col(content))).drop(content)
    if placed:
        read = read.repartition("rec_id")
    return read.select(*[c for c in records.columns if c != content], F.inline_outer("_nodes"))


def by_merge(rows: DataFrame) -> DataFrame:
    """A join's side as large as the nodes: never broadcast.

    The planner takes its size from the packed files, though reading markup makes many times as much of it.
    """
    return rows.hint("merge")


def in_order(*more: str) -> Window:
    return Window.partitionBy("rec_id", *more).orderBy("pre")


def hides(attrs: Column) -> Column:
    """An inline style takes the element out of view."""
    style = F.lower(F.replace(F.coalesce(attrs["style"], F.lit("")), F.lit(" "), F.lit("")))
    return F.contains(style, F.lit("display:none")) | F.contains(style, F.lit("visibility:hidden"))


COMPOUND = re.compile(r"^([a-zA-Z][\w-]*|\*)?((?:\.[\w-]+|#[\w-]+|\[[^\]]+\])*)$")
PIECE = re.compile(r"\.([\w-]+)|#([\w-]+)|\[([^\]]+)\]")
ATTRIBUTE = re.compile(r"""^([\w-]+)(?:([\^$*]?=)["']?([^"']*)["']?)?$""")


def compound_test(part: str):
    """A function from a node-like struct accessor to a condition, or None."""
    found = COMPOUND.match(part)
    if not found or not part:
        return None
    tag, rest = found.group(1), found.group(2)
    tests = []
    if tag and tag != "*":
        tests.append(lambda n, t=tag.lower(): n("tag") == t)
    for cls, ident, attr in PIECE.findall(rest):
        if cls:
            tests.append(lambda n, c=cls: F.array_contains(n("classes"), c))
        elif ident:
            tests.append(lambda n, i=ident: n("id") == i)
        else:
            parsed = ATTRIBUTE.match(attr.strip())
            if not parsed:
                return None
            name, op, value = parsed.group(1).lower(), parsed.group(2), parsed.group(3)
            compare = {
                None: lambda v, x: v.isNotNull(),
                "=": lambda v, x: v == x,
                "^=": lambda v, x: F.startswith(v, F.lit(x)),
                "$=": lambda v, x: F.endswith(v, F.lit(x)),
                "*=": lambda v, x: F.contains(v, F.lit(x)),
            }[op]
            tests.append(lambda n, a=name, v=value, c=compare: F.coalesce(c(n("attrs")[a], v), F.lit(False)))
    return lambda n: functools.reduce(lambda a, b: a & b, [t(n) for t in tests], n("tag") != TEXT)


def chains_of(raw: str | Sequence[str]) -> list[list]:
    """Alternatives of a selector as chains of compound tests. Those with a malformed part are left out, as if not written."""
    alternatives = ",".join([raw] if isinstance(raw, str) else list(raw)).split(",")
    chains = [[compound_test(p) for p in alternative.split()] for alternative in alternatives]
    return [c for c in chains if c and all(test is not None for test in c)]


def marked(nodes: DataFrame, **selectors: str | Sequence[str] | None) -> DataFrame:
    """`nodes` with a flag for each selector. All nodes of a record are there.

    A chain is walked compound by compound: a node meets the next one if it stands below a node that has met those
    before. All selectors walk together, in windows of one order.
    """
    own = lambda name: F.col(name)
    walks = {name: chains_of(raw) if raw else [] for name, raw in selectors.items()}
    met = {(name, i): chain[0](own) for name, chains in walks.items() for i, chain in enumerate(chains)}
    helpers: list[str] = []
    for step in range(1, max([len(c) for chains in walks.values() for c in chains], default=0)):
        reached = {}
        for (name, i), hit in met.items():
            if len(walks[name][i]) > step:
                reached[f"_below_{name}_{i}_{step}"] = below(hit)
                met[name, i] = walks[name][i][step](own) & F.col(f"_below_{name}_{i}_{step}")
        nodes = nodes.withColumns(reached)
        helpers += reached
    flags = {name: functools.reduce(lambda a, b: a | b, [met[name, i] for i in range(len(chains))], F.lit(False)) for name, chains in walks.items()}
    return nodes.withColumns(flags).drop(*helpers)


def matching(nodes: DataFrame, raw: str | Sequence[str]) -> DataFrame:
    return marked(nodes, _hit=raw).filter("_hit").drop("_hit")


def outermost(nodes: DataFrame, hit: Column | str | Sequence[str] | None = None) -> DataFrame:
    """Rows (or hits among rows) not inside an earlier one."""
    if hit is None or isinstance(hit, Column):
        rows = nodes if hit is None else nodes.filter(hit)
    else:
        rows = matching(nodes, hit)
    return rows.withColumn("_held", below(F.lit(True))).filter(~F.col("_held")).drop("_held")


def without(nodes: DataFrame, hit: Column | str | Sequence[str]) -> DataFrame:
    """Nodes left after the subtrees of all hits are taken out."""
    flagged = nodes.withColumn("_out", hit) if isinstance(hit, Column) else marked(nodes, _out=hit)
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    return (
        flagged.withColumn("_cut", F.max(F.when(F.col("_out"), F.col("end"))).over(upto))
        .filter(F.col("_cut").isNull() | (F.col("_cut") < F.col("pre")))
        .drop("_cut", "_out")
    )


def scoped(nodes: DataFrame, root: str | None = None, ignore: str | None = None) -> DataFrame:
    """Subtree of the first root match (all nodes without one), less `ignore`."""
    out = nodes
    if root:
        whole = Window.partitionBy("rec_id")
        out = (
            marked(out, _hit=root)
            .withColumn("_root", F.min(F.when(F.col("_hit"), F.struct("pre", "end"))).over(whole))
            .filter(
                F.col("_root").isNull()
                | ((F.col("pre") >= F.col("_root.pre")) & (F.col("pre") <= F.col("_root.end")))
            )
            .drop("_root", "_hit")
        )
    return without(out, ignore) if ignore else out


def visible(nodes: DataFrame) -> DataFrame:
    """Nodes outside scripts, styles, head and inline-hidden subtrees."""
    return without(nodes, F.col("tag").isin(SILENT_TAGS) | hides(F.col("attrs")))


LETTER = r"[\p{L}\p{Nd}]"


def needs_gap(left: Column, right: Column) -> Column:
    """D3: two texts that would run together as one word; CJK letters may."""
    last, first = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    cjk = f"[{T.CJK}]"
    suffix = F.regexp_replace(right, r"^\s+|\s+$", "").rlike(r"(?s)^(s|s[ .].*|['’]s|['’]s .*)$")
    return last.rlike(LETTER) & first.rlike(LETTER) & ~(last.rlike(cjk) & first.rlike(cjk)) & ~suffix


def text_pieces(nodes: DataFrame) -> DataFrame:
    """Visible texts with the separator that stands before each.

    A separator is due where a block begins or ends between two texts, and
    where two words would merge.
    """
    line = with_boundaries(visible(nodes), F.col("tag").isin(BLOCK_TAGS)).filter(F.col("tag") == TEXT)
    order = Window.partitionBy("rec_id").orderBy("_at", "_turn")
    prior = F.lag("text").over(order)
    gap = (F.lag("_block").over(order) != F.col("_block")) | needs_gap(prior, F.col("text"))
    return line.withColumn("piece", F.concat(F.when(gap, " ").otherwise(""), "text")).drop("_block", "_at", "_turn")


def with_boundaries(nodes: DataFrame, block: Column) -> DataFrame:
    """Nodes with `_block`, the numbers of blocks opened and closed before them, in the order of `_at`, `_turn`.

    Two nodes with the same numbers stand in one stretch of one block.
    """
    turns = F.explode(F.when(block, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    line = nodes.withColumn("_b", block).withColumn("_turn", turns)
    line = line.withColumn("_at", F.when(F.col("_turn") == 0, F.col("pre")).otherwise(F.col("end")))
    upto = Window.partitionBy("rec_id").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.sum((F.col("_b") & (F.col("_turn") == 0)).cast("int")).over(upto)
    counted = line.withColumns({"_opened": opened, "_closed": F.sum("_turn").over(upto)}).filter("_turn = 0")
    return counted.withColumn("_block", F.struct("_opened", "_closed")).drop("_b", "_opened", "_closed")


def walked(nodes: DataFrame) -> DataFrame:
    """Nodes with `piece` (as in `text_pieces`; null for all but visible texts) and, of elements, what stands under them.

    One walk in document order that meets each element twice, where it opens and where it closes: what is counted
    between the two is under it. `_from` and `_n` place an element's pieces among those of its record; `link_only` and
    `leaf` tell whether all its visible words are in links, and whether no block is in it. No text is laid out twice.
    """
    upto = in_order().rowsBetween(Window.unboundedPreceding, 0)
    shown = F.coalesce(F.max(F.when(F.col("tag").isin(SILENT_TAGS) | hides(F.col("attrs")), F.col("end"))).over(upto) < F.col("pre"), F.lit(True))
    text = (F.col("tag") == TEXT) & F.col("text").isNotNull() & F.col("_shown")
    said = text & (F.trim("text") != "")
    block = F.col("tag").isin(BLOCK_TAGS)
    flags = {"_t": text, "_w": said, "_u": said & ~F.col("_linked"), "_b": block & F.col("_shown"), "_any": block}
    line = nodes.withColumns({"_shown": shown, "_linked": below(F.col("tag") == "a")}).withColumns(flags).drop("_shown", "_linked")
    turns = F.explode(F.when(F.col("tag") != TEXT, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    opens = F.col("_turn") == 0
    rest = [c for c in nodes.columns if c not in ("rec_id", "pre", "end")]
    line = line.withColumn("_turn", turns).withColumns(
        {"_at": F.when(opens, F.col("pre")).otherwise(F.col("end")), **{c: F.when(opens, F.col(c)) for c in rest}}
    )
    order = Window.partitionBy("rec_id").orderBy("_at", "_turn")
    far = order.rowsBetween(Window.unboundedPreceding, 0)
    count = lambda hit: F.sum(hit.cast("int")).over(far)
    line = line.withColumns(
        {
            **{f"_n{c}": count(F.col(c) & opens) for c in ("_t", "_w", "_u", "_any")},
            "_block": F.struct(count(F.col("_b") & opens).alias("o"), count(F.col("_b") & ~opens).alias("c")),
        }
    )
    is_text = F.col("_t") & opens
    prior = F.last(F.when(is_text, F.struct("text", "_block")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = (F.col("_prior._block") != F.col("_block")) | needs_gap(F.col("_prior.text"), F.col("text"))
    line = line.withColumn("_prior", prior)
    line = line.withColumn("piece", F.when(is_text, F.concat(F.when(gap, " ").otherwise(""), "text"))).drop("_prior", "_block")
    both = Window.partitionBy("rec_id", "pre")
    under = {c: F.max(f"_n{c}").over(both) - F.col(f"_n{c}") for c in ("_t", "_w", "_u", "_any")}
    line = line.withColumns({f"_under{c}": v for c, v in under.items()}).filter(opens)
    return line.select(
        *nodes.columns, "piece", F.col("_n_t").cast("int").alias("_from"), F.col("_under_t").cast("int").alias("_n"),
        ((F.col("_under_w") > 0) & (F.col("_under_u") == 0)).alias("link_only"), (F.col("_under_any") == 0).alias("leaf"),
    )


def joined_text(pieces: DataFrame, keys: Sequence[str], name: str = "text") -> DataFrame:
    return pieces.groupBy(*keys).agg(
        T.collapse_space(F.expr("listagg(piece) within group (order by pre)")).alias(name)
    )


def visible_text(nodes: DataFrame, name: str = "text") -> DataFrame:
    """Normalized visible text of each record."""
    return joined_text(text_pieces(nodes), ["rec_id"], name)


def texts_under(pieces: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """`wanted` (rec_id, pre, end, ...; repeats count each) with the text of the pieces under each, null if there are none.

    Counting pieces up to where an element opens and to where it closes places its text among those of the record; the
    texts are met record by record, so they are neither repeated for each element above them nor moved again.
    """
    wanted = wanted.drop(name)
    row = F.struct(*[c for c in wanted.columns if c != "rec_id"])
    turns = F.explode(F.array(F.struct(F.col("pre").alias("_at"), F.lit(1).alias("_turn")), F.struct(F.col("end").alias("_at"), F.lit(2).alias("_turn"))))
    asks = wanted.select("rec_id", "pre", "end", turns.alias("_t"), row.alias("_row")).select(
        "rec_id", "pre", "end", "_t.*", F.when(F.col("_t._turn") == 1, F.col("_row")).alias("_row")
    )
    none = lambda kind: F.lit(None).cast(kind)
    kinds = {f.name: f.dataType for f in asks.schema}
    at = F.col("pre").cast(kinds["_at"]).alias("_at")
    marks = pieces.select("rec_id", at, F.lit(0).alias("_turn"), *[none(kinds[c]).alias(c) for c in ("pre", "end", "_row")])
    upto = Window.partitionBy("rec_id").orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    line = asks.unionByName(marks).withColumn("_from", F.sum((F.col("_turn") == 0).cast("int")).over(upto).cast("int")).filter("_turn > 0")
    line = line.withColumn("_n", F.max("_from").over(Window.partitionBy("rec_id", "pre", "end")) - F.col("_from")).filter("_turn = 1")
    asked = line.groupBy("rec_id").agg(F.collect_list(F.struct("_row", "_from", "_n")).alias("_asked"))
    held = pieces.groupBy("rec_id").agg(F.sort_array(F.collect_list(F.struct("pre", "piece"))).alias("_pieces"))
    met = asked.join(by_merge(held), "rec_id", "left")
    said = lambda e: T.collapse_space(F.array_join(F.slice("_pieces", e["_from"] + 1, e["_n"])["piece"], ""))
    fields = [c for c in wanted.columns if c != "rec_id"]
    out = lambda e: F.struct(*[e["_row"][c].alias(c) for c in fields], F.when(e["_n"] > 0, said(e)).alias(name))
    return met.select("rec_id", F.inline(F.transform("_asked", out))).select(*wanted.columns, name)


def element_texts(nodes: DataFrame, wanted: DataFrame, name: str = "own_text", pieces: DataFrame | None = None) -> DataFrame:
    """Visible text under each wanted element (with `end`): (rec_id, e_pre, text)."""
    under = (text_pieces(nodes) if pieces is None else pieces).select("rec_id", "pre", "piece")
    each = wanted.select("rec_id", "pre", "end").dropDuplicates(["rec_id", "pre"])
    return texts_under(under, each, name).filter(F.col(name).isNotNull()).select("rec_id", F.col("pre").alias("e_pre"), name)


def with_texts(nodes: DataFrame, wanted: DataFrame, name: str = "own_text") -> DataFrame:
    under = text_pieces(nodes).select("rec_id", "pre", "piece")
    return texts_under(under, wanted, name).withColumn(name, F.coalesce(F.col(name), F.lit("")))


# Attributes that describe a node to the region rule.
DESCRIBING = ["class", "id", "title", "href", "src", "addr", "name", "data-src-mp3", "alt"]


def attribute_words(attrs: Column) -> Column:
    return F.concat_ws(" ", *[attrs[a] for a in DESCRIBING])


def descriptor_text(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a node, its children, three ancestors and neighbours say of it.

    A neighbour's text counts only where nothing else names a region.
    """
    described = nodes.filter(F.col("tag") != TEXT).select(
        "rec_id", F.col("pre").alias("_p"), "parent", "sib", attribute_words(F.col("attrs")).alias("_w")
    )
    kids = (
        described.join(by_merge(wanted.select("rec_id", F.col("pre").alias("parent"))), ["rec_id", "parent"], "left_semi")
        .groupBy("rec_id", F.col("parent").alias("pre"))
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_w"))), lambda x: x["_w"]), " ").alias("_kids"))
    )
    beside = nodes.select(
        "rec_id", "parent", "sib", F.col("pre").alias("_np"), F.col("end").alias("_ne"), F.col("text").alias("_nt"),
        F.when(F.col("tag") != TEXT, attribute_words(F.col("attrs"))).alias("_nw"),
    )
    left = beside.select("rec_id", "parent", (F.col("sib") + 1).alias("sib"), F.col("_np").alias("_lp"), F.col("_ne").alias("_le"), F.col("_nt").alias("_lt"), F.col("_nw").alias("_lw"))
    right = beside.select("rec_id", "parent", (F.col("sib") - 1).alias("sib"), F.col("_nw").alias("_rw"))
    pieces = text_pieces(nodes)
    at = ["rec_id", "parent", "sib"]
    base = (
        wanted.join(by_merge(kids), ["rec_id", "pre"], "left")
        .join(by_merge(left), at, "left")
        .join(by_merge(right), at, "left")
        .join(by_merge(element_texts(nodes, wanted, "_own", pieces).withColumnRenamed("e_pre", "pre")), ["rec_id", "pre"], "left")
    )
    lefts = base.filter(F.col("_lp").isNotNull()).select("rec_id", F.col("_lp").alias("pre"), F.col("_le").alias("end"))
    base = base.join(
        by_merge(element_texts(nodes, lefts, "_lown", pieces).withColumnRenamed("e_pre", "_lp")), ["rec_id", "_lp"], "left"
    )
    base = parents(base, nodes, attribute_words(F.col("attrs")), "_uppers", 3)
    own = F.when(F.length(F.coalesce("_own", F.lit(""))) <= 120, F.col("_own"))
    said = F.lower(
        F.concat_ws(" ", attribute_words(F.col("attrs")), "_kids", F.array_join("_uppers", " "), own, "_lw", "_rw")
    )
    neighbour = F.lower(T.collapse_space(F.coalesce("_lown", "_lt", F.lit(""))))
    return base.withColumn("_said", said).withColumn(
        "descriptor",
        F.when(has_region_marker("_said"), F.col("_said")).otherwise(F.concat_ws(" ", "_said", neighbour)),
    ).select(*wanted.columns, "descriptor")


def rich_blocks(nodes: DataFrame) -> DataFrame:
    """Headings, list items, tables, images and paragraphs of each record, in order.

    The outermost headings, items and tables are blocks of their own, with all the text in them; outside of these a
    paragraph is a stretch of text between block boundaries, line breaks and images. An image needs a reference, and a
    repeat of the image right before it falls away. A table's header is its first row of header cells only. Rows:
    (rec_id, ord, kind, text, ref, alt, header, rows).
    """
    shown = visible(nodes)
    whole = F.col("tag").rlike("^(h[1-6]|li|table)$")
    reference = F.coalesce(*[F.when(F.trim(F.col("attrs")[a]) != "", F.trim(F.col("attrs")[a])) for a in ("src", "data-src")])
    outside = inside(shown, _in=whole).filter(~F.col("_in")).drop("_in").withColumn("ref", F.when(F.col("tag") == "img", reference))
    cut = with_boundaries(outside, F.col("tag").isin(BLOCK_TAGS) | whole | F.col("ref").isNotNull())
    order = Window.partitionBy("rec_id", "_block").orderBy("pre")
    gap = F.coalesce(needs_gap(F.lag("text").over(order), F.col("text")), F.lit(False))
    pieces = cut.filter(F.col("tag") == TEXT).withColumn("piece", F.concat(F.when(gap, " ").otherwise(""), "text"))
    texts = pieces.groupBy("rec_id", "_block").agg(
        F.min("pre").alias("pre"), T.collapse_space(F.expr("listagg(piece) within group (order by pre)")).alias("text")
    )
    none = lambda kind: F.lit(None).cast(kind)
    wide = ("rec_id", "pre", "kind", "text", "ref", "alt", "header", "rows")
    as_rows = lambda df, **given: df.select(
        *[
            (given[c] if c in given else none({"header": "array<string>", "rows": "array<array<string>>"}.get(c, "string")) if c not in ("rec_id", "pre") else F.col(c)).alias(c)
            for c in wide
        ]
    )
    paragraphs = as_rows(texts.filter(F.col("text") != ""), kind=F.lit("text"), text=F.col("text"))
    alt = F.coalesce(F.when(F.col("attrs")["alt"] != "", F.col("attrs")["alt"]), F.col("attrs")["title"], F.lit(""))
    images = as_rows(outside.filter(F.col("ref").isNotNull()), kind=F.lit("image"), ref=F.col("ref"), alt=alt)
    said = with_texts(nodes, outside.filter(whole & (F.col("tag") != "table")).select("rec_id", "pre", "end", "tag"), "said")
    kind = F.when(F.col("tag") == "li", "list_item").otherwise("heading")
    titles = as_rows(said.filter(F.col("said") != ""), kind=kind, text=F.col("said"))
    grids = table_rows(shown, outside.filter(F.col("tag") == "table"))
    body = F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_header"), F.struct("row_pre", "cells")))), lambda x: x["cells"])
    grids = grids.groupBy("rec_id", F.col("table_pre").alias("pre")).agg(
        F.max(F.when(F.col("is_header"), F.col("cells"))).alias("_head"), body.alias("_body")
    )
    framed = as_rows(grids, kind=F.lit("table"), header=F.col("_head"), rows=F.col("_body"))
    every = paragraphs.unionByName(images).unionByName(titles).unionByName(framed)
    line = Window.partitionBy("rec_id").orderBy("pre")
    again = (F.col("kind") == "image") & (F.lag("kind").over(line) == "image") & (F.lag("ref").over(line) == F.col("ref"))
    kept = every.withColumn("_again", F.coalesce(again, F.lit(False))).filter(~F.col("_again"))
    kept = kept.withColumn("ord", F.row_number().over(line).cast("bigint"))
    return kept.select("rec_id", "ord", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("ref", F.lit("")).alias("ref"), "alt", "header", "rows")


def table_rows(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """Rows under the nearest of the given tables, cells being the children of a row: (rec_id, table_pre, row_pre, is_header, cells)."""
    lines = stack_join(nodes.filter(F.col("tag") == "tr").select("rec_id", "pre"), owners, "table_pre")
    cells = nodes.filter(F.col("tag").isin("td", "th")).select("rec_id", "pre", "end", "tag", F.col("parent").alias("row_pre"))
    texts = with_texts(nodes, cells, "cell").join(by_merge(lines.withColumnRenamed("pre", "row_pre")), ["rec_id", "row_pre"])
    rows = texts.groupBy("rec_id", "table_pre", "row_pre").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pre", "cell"))), lambda x: x["cell"]).alias("cells"),
        F.bool_and(F.col("tag") == "th").alias("all_header"),
    )
    head = F.min(F.when(F.col("all_header"), F.col("row_pre"))).over(Window.partitionBy("rec_id", "table_pre"))
    return rows.withColumn("is_header", F.coalesce(head == F.col("row_pre"), F.lit(False))).drop("all_header")


def tables(nodes: DataFrame) -> DataFrame:
    """Cells of each table as rows; header = first row of header cells only.

    Texts, rows and tables are told from one reading of the nodes, so the markup is read once.
    """
    is_cell = F.col("tag").isin("td", "th")
    line = walked(nodes).filter(is_cell | F.col("tag").isin("tr", "table") | F.col("piece").isNotNull())
    line = line.select("rec_id", "pre", "end", "tag", "piece", "_from", "_n")
    line = nearest_above(nearest_above(line, F.col("tag") == "tr", "row_pre"), F.col("tag") == "table", "table_pre")
    owned = is_cell & F.col("row_pre").isNotNull() & F.col("table_pre").isNotNull()
    fields = ["table_pre", "row_pre", "pre", "tag"]
    records = line.groupBy("rec_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pre", "piece")))).alias("_pieces"),
        F.collect_list(F.when(owned, F.struct(*fields, "_from", "_n"))).alias("_cells"),
    )
    said = lambda e: T.collapse_space(F.array_join(F.slice("_pieces", e["_from"] + 1, e["_n"])["piece"], ""))
    cells = records.select("rec_id", F.inline(F.transform("_cells", lambda e: F.struct(*[e[c].alias(c) for c in fields], said(e).alias("cell")))))
    rows = cells.groupBy("rec_id", "table_pre", "row_pre").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pre", "cell"))), lambda x: x["cell"]).alias("cells"),
        F.bool_and(F.col("tag") == "th").alias("all_header"),
    )
    head = F.min(F.when(F.col("all_header"), F.col("row_pre"))).over(Window.partitionBy("rec_id", "table_pre"))
    return rows.withColumn("is_header", F.coalesce(head == F.col("row_pre"), F.lit(False))).select(
        "rec_id", "table_pre", "row_pre", "is_header", "cells"
    )


def link_only(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Elements all of whose visible words are inside links."""
    said = (F.col("tag") == TEXT) & (F.trim("text") != "")
    slim = nodes.select("rec_id", "pre", "end", "tag", "attrs", F.coalesce(said, F.lit(False)).alias("_said"))
    words = inside(visible(slim), linked=F.col("tag") == "a").filter("_said")
    under = stack_join(words.select("rec_id", "pre", "linked"), wanted, "e_pre", every=True)
    flags = under.groupBy("rec_id", F.col("e_pre").alias("pre")).agg(F.bool_and("linked").alias("link_only"))
    return wanted.join(by_merge(flags), ["rec_id", "pre"], "left").withColumn(
        "link_only", F.coalesce("link_only", F.lit(False))
    )


def class_hint(words: Sequence[str]) -> Column:
    """A word is part of a class name or the id."""
    both = F.lower(F.concat_ws(" ", F.array_join("classes", " "), "id"))
    return both.rlike("(" + "|".join(re.escape(w) for w in words) + ")")


def class_token(words: Sequence[str]) -> Column:
    """A whole class name, case ignored, is one of the words."""
    return F.exists("classes", lambda c: F.lower(c).isin(list(words)))


def references(nodes: DataFrame) -> DataFrame:
    """Values of the attributes that point at something, with their scheme."""
    named = ["href", "src", "addr", "data-src", "data-src-mp3"]
    values = F.explode(F.array_compact(F.array(*[F.col("attrs")[n] for n in named]))).alias("ref")
    return nodes.filter(F.col("tag") != TEXT).select("rec_id", "pre", values).withColumn(
        "scheme", K.reference_scheme("ref")
    )
