"""Rendering as ordered aggregation: entry tables to Markdown, text and cards; pages to Markdown.

Each child table becomes lines with an order key; lines are joined per block,
blocks per record, records per set. All grouping is by record (bounded by one
record's size) and then by set.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmaforge.functions import keys as K
from lemmaforge.functions import text as T
from lemmaforge.functions.markup import TEXT
from lemmaforge.operators import nodes as N
from lemmaforge.operators.intervals import heights, inside, stack_join

SENSES = (
    "rec_id long, part_ord int, path array<int>, number string, definition string, translation string, "
    "labels array<string>, grammar string, topic string, patterns array<string>, synonyms array<string>, "
    "antonyms array<string>, examples array<struct<text:string,translation:string>>"
)
PARTS = "rec_id long, part_ord int, pos string, grammar string"
PRONUNCIATIONS = "rec_id long, ord int, ipa_region string, ipa string, audio_region string, audio string, label string"
FORMS = "rec_id long, ord int, name string, words array<string>"
PHRASES = "rec_id long, kind string, ord int, phrase string, definition string"
TERMS = "rec_id long, kind string, ord int, value string"
SECTIONS = "rec_id long, kind string, ord int, title string, body string"
RECORDS = "rec_id long, set_id string, rec_ord long, lookup_key string, headword string"


@dataclass
class Entries:
    """Entry tables; an absent table is None."""

    records: DataFrame
    parts: DataFrame | None = None
    senses: DataFrame | None = None
    pronunciations: DataFrame | None = None
    forms: DataFrame | None = None
    phrases: DataFrame | None = None
    terms: DataFrame | None = None
    sections: DataFrame | None = None


def escape(value: Column | str) -> Column:
    """Markdown syntax made inert, line breaks to blanks, trimmed."""
    marked = F.regexp_replace(K.col(value), r"([\\`*_\[\]<>])", r"\\$1")
    return F.trim(F.regexp_replace(marked, "[\n\r]", " "))


def code_span(value: Column | str) -> Column:
    """Inert code span; the fence is longer than any run of ticks inside."""
    text = F.trim(F.regexp_replace(K.col(value), r"\s+", " "))
    longest = F.coalesce(F.array_max(F.transform(T.find_all(text, "`+"), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), longest + 1)
    pad = F.when(text.rlike("^`|`$"), " ").otherwise("")
    return F.when(text == "", "").otherwise(F.concat(fence, pad, text, pad, fence))


def table_lines(rows: Column) -> Column:
    """Markdown table of an array of rows, the first being the header; short rows padded."""
    width = F.array_max(F.transform(rows, F.size))
    cell = lambda c: F.replace(escape(c), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda r: F.transform(
        F.sequence(F.lit(1), width), lambda i: F.coalesce(cell(F.try_element_at(r, i)), F.lit(""))
    )
    rule = line(F.transform(F.sequence(F.lit(1), width), lambda i: F.lit("---")))
    body = F.transform(rows, lambda r: line(padded(r)))
    return F.when(
        width > 0, F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, F.lit(2), F.greatest(F.size(body), F.lit(1)))), "\n")
    ).otherwise("")


def region_label(region: Column) -> Column:
    return F.when(region == "uk", "UK").when(region == "us", "US").when(region == "neutral", "shared").otherwise("unmarked")


def numbered_senses(senses: DataFrame) -> DataFrame:
    """Printed number of each sense at any depth: its own, else its place under the nearest numbered one above it."""
    keys = ["rec_id", "part_ord"]
    own = senses.withColumn("_own", F.when(F.trim(F.coalesce("number", F.lit(""))) != "", F.trim("number")))
    numbers = own.filter(F.col("_own").isNotNull()).groupBy(*keys, F.col("path").alias("_up")).agg(F.min("_own").alias("_above"))
    ups = own.filter(F.col("_own").isNull()).select(*keys, "path").distinct()
    ups = ups.withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("path")))).withColumn("_up", F.slice("path", F.lit(1), F.col("_n")))
    near = ups.join(numbers, [*keys, "_up"]).groupBy(*keys, "path").agg(F.max_by("_above", "_n").alias("_above"), F.max("_n").alias("_n"))
    wide = own.join(near, [*keys, "path"], "left")
    rest = F.slice("path", F.coalesce("_n", F.lit(0)) + 1, F.size("path")).cast("array<string>")
    shown = F.coalesce("_own", F.array_join(F.concat(F.array_compact(F.array("_above")), rest), "."))
    return wide.withColumn("shown", shown).select(*senses.columns, "shown")


def joined(items: Column, sep: str = ", ") -> Column:
    return F.array_join(items, sep)


def filled(value: Column | str) -> Column:
    return F.coalesce(F.trim(K.col(value)), F.lit("")) != ""


def some(items: Column | str) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) > 0


def sense_lines(senses: DataFrame, style: str, examples: int) -> DataFrame:
    """Lines of the senses: (rec_id, kind, ord, key, line)."""
    md = style == "markdown"
    say = escape if md else K.col
    indent = F.repeat(F.lit("  "), F.size("path") - 1)
    empty = F.lit("")
    if md:
        head = F.concat(
            indent,
            F.lit("- **"),
            escape("shown"),
            F.lit("**"),
            F.when(some("labels"), F.concat(F.lit(" *("), escape(joined(F.col("labels"))), F.lit(")*"))).otherwise(empty),
            F.when(filled("topic"), F.concat(F.lit(" ["), escape("topic"), F.lit("]"))).otherwise(empty),
            F.when(filled("definition"), F.concat(F.lit(" "), escape("definition"))).otherwise(empty),
            F.when(filled("translation") & filled("definition"), " —").otherwise(empty),
            F.when(filled("translation"), F.concat(F.lit(" "), escape("translation"))).otherwise(empty),
            F.when(filled("grammar"), F.concat(F.lit(" · `"), escape("grammar"), F.lit("`"))).otherwise(empty),
            F.when(some("patterns"), F.concat(F.lit(" · `"), escape(joined(F.col("patterns"), " / ")), F.lit("`"))).otherwise(empty),
        )
    else:
        details = F.concat_ws(
            " ",
            F.when(some("labels"), F.concat(F.lit("("), joined(F.col("labels")), F.lit(")"))),
            F.when(filled("topic"), F.concat(F.lit("["), "topic", F.lit("]"))),
            F.when(filled("grammar"), F.col("grammar")),
            F.when(some("patterns"), joined(F.col("patterns"), " / ")),
        )
        text = F.trim(F.concat(details, F.lit(" "), F.coalesce("definition", empty)))
        text = F.concat(
            text,
            F.when(filled("translation"), F.concat(F.when(text != "", " — ").otherwise(empty), "translation")).otherwise(empty),
        )
        head = F.concat(indent, "shown", F.lit(". "), F.trim(text))
    child = F.concat(indent, F.lit("  - " if md else "  "))
    example = lambda e: F.concat(
        child,
        F.concat(F.lit("*"), say(e["text"]), F.lit("*")) if md else F.concat(F.lit("Example: "), e["text"]),
        F.when(filled(e["translation"]), F.concat(F.lit(" — "), say(e["translation"]))).otherwise(empty),
    )
    listed = lambda name, label: F.when(some(name), F.array(F.concat(child, F.lit(label), say(joined(F.col(name)))))).otherwise(
        F.array().cast("array<string>")
    )
    lines = F.concat(
        F.array(head),
        F.transform(F.slice(F.coalesce("examples", F.array()), 1, examples), example),
        listed("synonyms", "syn: " if md else "Synonyms: "),
        listed("antonyms", "ant: " if md else "Antonyms: "),
    )
    # (path, -1, line number): a subsense comes after the lines of the sense above it
    return numbered_senses(senses).select(
        "rec_id", F.lit(2).alias("kind"), F.col("part_ord").alias("ord"), "path", F.posexplode(lines).alias("n", "line")
    ).select("rec_id", "kind", "ord", F.concat("path", F.array(F.lit(0), F.col("n"))).alias("key"), "line")


TITLES = {
    "phrase": (4, "Phrases"), "idiom": (5, "Idioms"), "phrasalVerb": (6, "Phrasal verbs"),
    "derivative": (7, "Derivatives"), "collocation": (8, "Collocations"), "synonym": (9, "Synonyms"),
    "antonym": (10, "Antonyms"), "crossReference": (11, "See also"), "related": (12, "Related"),
    "wordFamily": (13, "Word family"), "usageNote": (14, "Usage · "), "grammarNote": (15, "Grammar · "),
    "etymology": (16, "Origin"), "section": (17, ""),
}


def from_titles(column: Column, at: int) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in TITLES.items() for x in (k, v[at])])
    return F.element_at(table, column)


def entry_blocks(entries: Entries, style: str = "markdown", examples: int = 4) -> DataFrame:
    """Blocks of each record: (rec_id, kind, ord, title, body), kinds in print order."""
    md = style == "markdown"
    say = escape if md else K.col
    bullet = "- " if md else ""
    none = F.lit("")
    blocks = []
    flat = F.lit("")
    named = entries.records.filter(filled("headword") & (F.trim("headword") != F.col("lookup_key")))
    blocks.append(
        named.select(
            "rec_id", F.lit(0).alias("kind"), F.lit(0).alias("ord"), flat.alias("title"),
            F.concat(F.lit("*headword:* " if md else "Headword: "), say(F.trim("headword"))).alias("body"),
        )
    )

    def gather(lines: DataFrame, title: Column) -> DataFrame:
        return lines.groupBy("rec_id", "kind", "ord").agg(
            F.max(title).alias("title"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "line"))), lambda x: x["line"]), "\n").alias("body"),
        )

    if entries.pronunciations is not None:
        fields = F.concat_ws(
            " · ",
            F.when(filled("ipa"), F.concat(region_label(F.col("ipa_region")), F.lit(" /"), say("ipa"), F.lit("/"))),
            F.when(filled("label"), F.concat(F.lit("*"), say("label"), F.lit("*")) if md else F.col("label")),
            F.when(filled("audio"), F.concat(F.lit("🔊 audio " if md else "audio "), region_label(F.col("audio_region")))),
        )
        lines = entries.pronunciations.select(
            "rec_id", F.lit(1).alias("kind"), F.lit(0).alias("ord"), F.array("ord").alias("key"),
            F.when(fields != "", F.concat(F.lit(bullet), fields)).alias("line"),
        ).filter(F.col("line").isNotNull())
        blocks.append(gather(lines, F.lit("" if md else "Pronunciation")))
    if entries.parts is not None and entries.senses is not None:
        label = F.concat_ws(" · ", F.when(filled("pos"), F.trim("pos")), F.when(filled("grammar"), F.trim("grammar")))
        if not md:
            label = F.concat_ws(
                " · ", F.when(filled("pos"), F.trim("pos")).otherwise("Meanings"), F.when(filled("grammar"), F.trim("grammar"))
            )
        heads = entries.parts.select("rec_id", F.col("part_ord").alias("ord"), label.alias("title"))
        body = gather(sense_lines(entries.senses, style, examples), F.lit(""))
        blocks.append(body.drop("title").join(heads, ["rec_id", "ord"]).select("rec_id", "kind", "ord", "title", "body"))
    if entries.forms is not None:
        name = F.when(filled("name"), F.trim("name")).otherwise("form")
        shown = F.concat(F.lit("- **"), say(name), F.lit("**: "), say(joined(F.col("words")))) if md else F.concat(
            name, F.lit(": "), joined(F.col("words"))
        )
        lines = entries.forms.filter(some("words")).select(
            "rec_id", F.lit(3).alias("kind"), F.lit(0).alias("ord"), F.array("ord").alias("key"), shown.alias("line")
        )
        blocks.append(gather(lines, F.lit("Forms")))
    if entries.phrases is not None:
        phrase = F.when(filled("phrase"), F.concat(F.lit("**"), say("phrase"), F.lit("**")) if md else F.trim("phrase"))
        line = F.concat_ws(" — ", phrase, F.when(filled("definition"), say("definition")))
        lines = entries.phrases.filter(filled("phrase") | filled("definition")).select(
            "rec_id", from_titles(F.col("kind"), 0).alias("kind"), F.lit(0).alias("ord"), F.array("ord").alias("key"),
            F.concat(F.lit(bullet), line).alias("line"), from_titles(F.col("kind"), 1).alias("_t"),
        )
        blocks.append(gather(lines, F.col("_t")))
    if entries.terms is not None:
        pointing = F.col("kind").isin("crossReference", "related")
        shown = F.when(pointing, code_span("value")).otherwise(say(F.trim("value"))) if md else F.trim("value")
        lines = entries.terms.filter(filled("value")).select(
            "rec_id", from_titles(F.col("kind"), 0).alias("kind"), F.lit(0).alias("ord"), F.array("ord").alias("key"),
            F.concat(F.lit(bullet), shown).alias("line"), from_titles(F.col("kind"), 1).alias("_t"),
        )
        gathered = gather(lines, F.col("_t"))
        if not md:
            # references are printed on the line of their title
            inline = F.col("kind").isin(11, 12)
            gathered = gathered.withColumn(
                "body",
                F.when(inline, F.concat("title", F.lit(": "), F.replace("body", F.lit("\n"), F.lit(", ")))).otherwise(F.col("body")),
            ).withColumn("title", F.when(inline, "").otherwise(F.col("title")))
        blocks.append(gathered)
    if entries.sections is not None:
        base = from_titles(F.col("kind"), 1)
        title = F.when(F.col("kind").isin("usageNote", "grammarNote"), F.concat(base, F.coalesce("title", none))).when(
            F.col("kind") == "etymology", base
        ).otherwise(F.when(filled("title"), F.trim("title")).otherwise("Note"))
        blocks.append(
            entries.sections.filter(filled("body")).select(
                "rec_id", from_titles(F.col("kind"), 0).alias("kind"), "ord", title.alias("title"),
                say(F.trim("body")).alias("body"),
            )
        )
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out.filter(F.col("body") != "")


def render_records(entries: Entries, style: str = "markdown", examples: int = 4) -> DataFrame:
    """Text of each record with its place in the set: (set_id, rec_ord, of, lookup_key, text)."""
    md = style == "markdown"
    # one small table of set sizes instead of a window over whole sets
    sizes = entries.records.groupBy("set_id").agg(F.count(F.lit(1)).alias("of"))
    placed = entries.records.join(sizes, "set_id").select("rec_id", "set_id", "rec_ord", "of", "lookup_key")
    blocks = entry_blocks(entries, style, examples).join(placed.select("rec_id", "of"), "rec_id")
    if md:
        level = F.when(F.col("of") > 1, "### ").otherwise("## ")
        shown = F.when(F.col("title") != "", F.concat(level, escape("title"), F.lit("\n\n"), "body")).otherwise(F.col("body"))
    else:
        shown = F.when(F.col("title") != "", F.concat("title", F.lit("\n"), "body")).otherwise(F.col("body"))
    texts = blocks.groupBy("rec_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("kind", "ord", shown.alias("t")))), lambda x: x["t"]), "\n\n"
        ).alias("text")
    )
    return placed.join(texts, "rec_id", "left").select("set_id", "rec_ord", "of", "lookup_key", F.coalesce("text", F.lit("")).alias("text"))


def render_sets(rendered: DataFrame, style: str = "markdown") -> DataFrame:
    """The document of each set, records parted and never mixed."""
    md = style == "markdown"
    many = F.col("of") > 1
    place = F.concat(F.lit("Record "), F.col("rec_ord").cast("string"), F.lit(" of "), F.col("of").cast("string"))
    head = F.concat(F.lit("## "), place) if md else place
    rule = "---" if md else "===================="
    part = F.concat_ws("\n\n", F.when(many & (F.col("rec_ord") > 1), rule), F.when(many, head), F.when(F.col("text") != "", F.col("text")))
    # the answer to one query: as long as its page, so collected per set
    return rendered.groupBy("set_id").agg(
        F.concat(
            F.when(F.lit(md), "# ").otherwise(""),
            escape(F.max("lookup_key")) if md else F.max("lookup_key"),
            F.lit("\n\n"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rec_ord", part.alias("p")))), lambda x: x["p"]), "\n\n"),
            F.lit("\n"),
        ).alias("document")
    )


def render_selected(rendered: DataFrame, ordinal: int = 1) -> DataFrame:
    """One record of each set, with selectors of the others."""
    label = F.concat(F.lit("- "), code_span(F.concat("lookup_key", F.translate(F.col("rec_ord").cast("string"), "0123456789", K.SUPERSCRIPTS))))
    others = (
        rendered.filter(F.col("rec_ord") != ordinal)
        .groupBy("set_id")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rec_ord", label.alias("l")))), lambda x: x["l"]), "\n").alias("_others"))
    )
    return rendered.filter(F.col("rec_ord") == ordinal).join(others, "set_id", "left").select(
        "set_id",
        F.concat(
            F.concat_ws(
                "\n\n",
                F.concat(F.lit("# "), escape("lookup_key")),
                F.when(F.col("text") != "", F.col("text")),
                F.when(F.col("_others").isNotNull(), F.concat(F.lit("## Other entries\n\n"), "_others")),
            ),
            F.lit("\n"),
        ).alias("document"),
    )


# Short part-of-speech labels of cards.
COMPACT_POS = {
    "noun": "n.", "verb": "v.", "transitive verb": "vt.", "intransitive verb": "vi.", "adjective": "adj.",
    "adverb": "adv.", "preposition": "prep.", "conjunction": "conj.", "pronoun": "pron.",
    "determiner": "det.", "article": "art.", "number": "num.", "interjection": "interj.",
    "modal verb": "modal v.", "auxiliary verb": "aux. v.", "abbreviation": "abbr.",
    "combining form": "comb. form", "prefix": "pref.", "suffix": "suff.", "symbol": "symb.",
}


def compact_pos(pos: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for p in COMPACT_POS.items() for x in p])
    text = F.trim(K.col(pos))
    return F.coalesce(F.element_at(table, F.lower(text)), text)


def card_parts(entries: Entries) -> DataFrame:
    """One row per sense or subsense: (rec_id, card_ord, label, number, meaning)."""
    line = Window.partitionBy("rec_id").orderBy("part_ord", "path")
    meaning = F.concat_ws(" — ", F.when(filled("definition"), F.col("definition")), F.when(filled("translation"), F.col("translation")))
    grammar = F.concat_ws(", ", F.array_distinct(F.array_compact(F.array(F.when(filled("part_grammar"), F.col("part_grammar")), F.when(filled("grammar"), F.col("grammar"))))))
    heads = entries.parts.select("rec_id", "part_ord", compact_pos(F.coalesce("pos", F.lit(""))).alias("label"), F.col("grammar").alias("part_grammar"))
    return (
        entries.senses.join(heads, ["rec_id", "part_ord"])
        .withColumn("number", F.array_join(F.transform("path", lambda x: x.cast("string")), "."))
        .withColumn("card_ord", F.row_number().over(line).cast("bigint"))
        .select("rec_id", "card_ord", "label", "number", meaning.alias("meaning"), grammar.alias("grammar"))
    )


def card_exchanges(forms: DataFrame) -> DataFrame:
    """Form names with their words; forms of one name are merged."""
    return forms.groupBy("rec_id", "name").agg(
        F.min("ord").alias("ord"),
        F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "words"))), lambda x: x["words"]))).alias("words"),
    )


def phonetic_slots(pronunciations: DataFrame) -> DataFrame:
    """Two slots per record, (uk, us), with shared and unknown facts placed.

    A shared transcription fills slots that have audio only, else the first
    free slot; unknown facts take a free slot left after that.
    """
    at = lambda hit, value: F.min_by(F.when(hit, F.col(value)), F.when(hit, F.col("ord")))
    has_ipa, has_audio = filled("ipa"), filled("audio")
    unknown = lambda c: ~F.col(c).isin("uk", "us", "neutral") | F.col(c).isNull()
    base = pronunciations.groupBy("rec_id").agg(
        *[at(has_ipa & (F.col("ipa_region") == r), "ipa").alias(f"{r}_ipa") for r in ("uk", "us")],
        *[at(has_audio & (F.col("audio_region") == r), "audio").alias(f"{r}_audio") for r in ("uk", "us")],
        at(has_ipa & (F.col("ipa_region") == "neutral"), "ipa").alias("shared"),
        at(has_ipa & unknown("ipa_region"), "ipa").alias("odd_ipa"),
        at(has_audio & ~F.coalesce(F.col("audio_region").isin("uk", "us"), F.lit(False)), "audio").alias("odd_audio"),
    )
    c = F.col
    taken = lambda r: c(f"{r}_ipa").isNotNull() | c(f"{r}_audio").isNotNull()
    waits = lambda r: taken(r) & c(f"{r}_ipa").isNull()
    shared = c("shared").isNotNull()
    used = waits("uk") | waits("us")
    uk_shared = shared & F.when(used, waits("uk")).otherwise(~taken("uk"))
    us_shared = shared & F.when(used, waits("us")).otherwise(taken("uk") & ~taken("us"))
    with_shared = base.withColumn("uk_shared", uk_shared).withColumn("us_shared", us_shared)
    odd = c("odd_ipa").isNotNull() | c("odd_audio").isNotNull()
    uk_full, us_full = taken("uk") | c("uk_shared"), taken("us") | c("us_shared")
    with_odd = with_shared.withColumn("uk_odd", odd & ~uk_full).withColumn("us_odd", odd & uk_full & ~us_full)
    value = lambda r: F.when(c(f"{r}_shared"), F.concat("shared", F.lit(" · 共用音标"))).when(
        c(f"{r}_odd"), F.when(c("odd_ipa").isNotNull(), F.concat("odd_ipa", F.lit(" · 未标口音")))
    ).otherwise(c(f"{r}_ipa"))
    audio = lambda r: F.when(c(f"{r}_odd"), c("odd_audio")).otherwise(c(f"{r}_audio"))
    left_shared = shared & ~c("uk_shared") & ~c("us_shared")
    left_odd = odd & ~c("uk_odd") & ~c("us_odd")
    return with_odd.select(
        "rec_id",
        value("uk").alias("uk_value"), audio("uk").alias("uk_audio"),
        value("us").alias("us_value"), audio("us").alias("us_audio"),
        left_shared.alias("shared_left_out"), left_odd.alias("unknown_left_out"),
    )


def preview_text(value: Column, more: Column, limit: int = 80) -> Column:
    """First `limit` letters; an ellipsis where cut or where more remains."""
    text = T.collapse_space(value)
    cut = F.length(text) > limit
    short = F.when(cut, F.trim(F.left(text, F.lit(limit)))).otherwise(text)
    mark = (cut | more) & ~short.rlike(r"(…|\.\.\.)$") & (short != "")
    return F.concat(short, F.when(mark, "…").otherwise(""))


def record_previews(entries: Entries, limit: int = 80) -> DataFrame:
    """First sense, else first section, else first phrase of each record."""
    candidates = []
    if entries.senses is not None:
        body = F.concat_ws(" — ", F.when(filled("definition"), F.trim("definition")), F.when(filled("translation"), F.trim("translation")))
        heads = entries.parts.select("rec_id", "part_ord", F.trim("pos").alias("pos"))
        said = entries.senses.withColumn("_b", body).filter(F.col("_b") != "").join(heads, ["rec_id", "part_ord"], "left")
        shown = F.concat_ws(" · ", F.when(filled("pos"), F.col("pos")), "_b")
        candidates.append(said.select("rec_id", F.lit(0).alias("rank"), F.struct(F.col("part_ord").cast("bigint").alias("part_ord"), "path").alias("at"), shown.alias("t")))
    simple = lambda ord_: F.struct(F.col(ord_).cast("bigint").alias("part_ord"), F.array().cast("array<int>").alias("path"))
    if entries.sections is not None:
        body = entries.sections.filter((F.col("kind") == "section") & filled("body"))
        candidates.append(body.select("rec_id", F.lit(1).alias("rank"), simple("ord").alias("at"), F.trim("body").alias("t")))
    if entries.phrases is not None:
        text = F.concat_ws(" — ", F.when(filled("phrase"), F.trim("phrase")), F.when(filled("definition"), F.trim("definition")))
        order = F.shiftleft(from_titles(F.col("kind"), 0).cast("bigint"), 48) + F.col("ord")
        body = entries.phrases.withColumn("_o", order).filter(text != "")
        candidates.append(body.select("rec_id", F.lit(2).alias("rank"), simple("_o").alias("at"), text.alias("t")))
    every = candidates[0]
    for more in candidates[1:]:
        every = every.unionByName(more)
    per_rank = every.groupBy("rec_id", "rank").agg(F.min_by("t", "at").alias("t"), F.count(F.lit(1)).alias("n"))
    best = per_rank.groupBy("rec_id").agg(F.min_by(F.struct("t", "n"), "rank").alias("b"))
    return best.select("rec_id", preview_text(F.col("b.t"), F.col("b.n") > 1, limit).alias("preview"))


def link_headword(href: Column | str) -> Column:
    """Headword an entry link points at: decoded, without fragment; plus signs kept."""
    rest = F.regexp_extract(K.col(href), r"(?is)^(?:entry|bword)://([^#]*)", 1)
    decoded = F.try_url_decode(F.replace(rest, F.lit("+"), F.lit("%2B")))
    return F.when(F.lower(K.col(href)).rlike("^(entry|bword)://"), F.trim(F.coalesce(decoded, rest)))


# Elements with no reading text, and elements laid out as blocks.
CHROME = [
    "script", "style", "link", "meta", "head", "noscript", "template", "iframe", "object", "embed", "button",
    "input", "select", "textarea", "form", "svg", "canvas",
]
LAYOUT_BLOCKS = [
    "address", "article", "aside", "blockquote", "body", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "header", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li", "main",
    "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
]


def page_markdown(nodes: DataFrame) -> DataFrame:
    """Markdown of each record's layout: (rec_id, markdown).

    Chrome, hidden parts and comments are out. Every text belongs to the block
    begun by the last block boundary; blocks get the prefix of their heading or
    list item, bold, italics and links wrap runs of text, blank lines collapse.
    """
    shown = N.without(nodes, F.col("tag").isin(CHROME) | N.hides(F.col("attrs")))
    tagged = lambda *tags: F.col("tag").isin(*tags)
    styled_in = inside(shown, _bold=tagged("b", "strong"), _headed=F.col("tag").rlike("^h[1-6]$"), _italic=tagged("i", "em"))
    is_block = F.col("tag").isin(LAYOUT_BLOCKS)
    rows = N.with_boundaries(styled_in, is_block).filter(F.col("tag").isin(TEXT, "br", "img"))
    # what the rows stand in: link, heading, item, lists; and how far their parent reaches
    places = rows.select("rec_id", "pre")
    said = shown.select("rec_id", F.col("pre").alias("_up"), F.col("tag").alias("_uptag"), F.coalesce(F.col("attrs")["href"], F.lit("")).alias("_uphref"))
    near = lambda name, hit: stack_join(places, shown.filter(hit), name)
    links = near("_up", tagged("a")).join(said, ["rec_id", "_up"]).select("rec_id", "pre", F.col("_up").alias("_a"), F.col("_uphref").alias("_href"))
    heads = near("_up", F.col("tag").rlike("^h[1-6]$")).join(said, ["rec_id", "_up"]).select("rec_id", "pre", F.col("_uptag").alias("_h"))
    rows = rows.join(links, ["rec_id", "pre"], "left").join(heads, ["rec_id", "pre"], "left")
    rows = rows.join(near("_li", tagged("li")), ["rec_id", "pre"], "left")
    rows = heights(rows, shown.filter(tagged("ul", "ol")), "_depth")
    rows = rows.join(shown.select("rec_id", F.col("pre").alias("parent"), F.col("end").alias("_parent_end")), ["rec_id", "parent"], "left")
    bold = F.col("_bold") & ~F.col("_headed")
    italic = F.col("_italic")
    href = F.coalesce("_href", F.lit(""))
    web = F.when(href.rlike("(?i)^https?://"), href).otherwise("")
    image = F.when(
        F.col("attrs")["src"].rlike("(?i)^https?://"),
        F.concat(F.lit("!["), F.coalesce(F.col("attrs")["alt"], F.lit("")), F.lit("]("), F.col("attrs")["src"], F.lit(")")),
    ).otherwise("")
    piece = F.when(F.col("tag") == "br", "\n").when(F.col("tag") == "img", image).otherwise(
        F.regexp_replace(F.regexp_replace("text", f"{T.BLANK}+", " "), r"([\\`*_\[\]<>])", r"\\$1")
    )
    # a run is a stretch of one block with one style and link; it is wrapped once
    run = F.struct(bold.alias("b"), italic.alias("i"), web.alias("w"), F.coalesce("_a", F.lit(-1)).alias("a"))
    styled = rows.withColumn("_run", run).withColumn("_piece", piece)
    order = Window.partitionBy("rec_id", "_block").orderBy("pre")
    prior = F.lag("text").over(order)
    # words merge only where both texts are wrapped: two inline elements side by side
    wrapped = (F.lag("_parent_end").over(order) < F.col("pre")) & (F.lag("pre").over(order) < F.col("parent"))
    gap = F.coalesce(wrapped & N.needs_gap(prior, F.col("text")) & ~(prior.rlike(r"\p{L}$") & F.col("text").rlike(r"^\p{Nd}")), F.lit(False))
    turned = F.coalesce(F.lag("_run").over(order) != F.col("_run"), F.lit(True)) | (F.col("tag") != TEXT)
    numbered = styled.withColumn("_gap", gap).withColumn("_r", F.sum(turned.cast("int")).over(order))
    runs = numbered.groupBy("rec_id", "_block", "_r").agg(
        F.min("pre").alias("pre"),
        F.first("_run").alias("_run"),
        *[F.min_by(c, "pre").alias(c) for c in ("_h", "_li", "_depth")],
        F.min_by("_gap", "pre").alias("_gap"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("pre", "_gap", "_piece"))),
                lambda x, i: F.concat(F.when(x["_gap"] & (i > 0), " ").otherwise(""), x["_piece"]),
            ), "",
        ).alias("t"),
    )
    core = F.regexp_replace("t", r"^[ ]+|[ ]+$", "")
    lead = F.when(F.col("t").rlike("^ ") | F.col("_gap"), " ").otherwise("")
    tail = F.when(F.col("t").rlike(" $") & (core != ""), " ").otherwise("")
    linked = F.when(F.col("_run.w") != "", F.concat(F.lit("["), core, F.lit("]("), "_run.w", F.lit(")"))).otherwise(core)
    mark = F.concat(F.when(F.col("_run.b"), "**").otherwise(""), F.when(F.col("_run.i"), "*").otherwise(""))
    wrapped = F.when(core.isin("", "\n"), core).otherwise(F.concat(mark, linked, F.reverse(mark)))
    joined_runs = (
        runs.withColumn("w", F.concat(lead, wrapped, tail))
        .withColumn("_li", F.coalesce("_li", F.lit(-1)))
        .groupBy("rec_id", "_block")
        .agg(
            F.min("pre").alias("pre"),
            F.max("_h").alias("h"),
            F.max("_li").alias("li"),
            F.max("_depth").alias("depth"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", "w"))), lambda x: x["w"]), "").alias("body"),
        )
    )
    tidy = F.trim(F.regexp_replace(F.regexp_replace("body", " *\n *", "  \n"), " {3,}(?=\n)|(?<=\\S) {2,}(?=\\S)", " "))
    tidy = F.regexp_replace(tidy, r"^(?:\s*\n)+|(?:\n\s*)+$", "")
    text = joined_runs.withColumn("body", F.rtrim(tidy)).filter(F.col("body") != "")
    line = Window.partitionBy("rec_id").orderBy("pre")
    first_of_item = (F.col("li") >= 0) & (F.coalesce(F.lag("li").over(line), F.lit(-2)) != F.col("li"))
    prefix = (
        F.when(F.col("h").isNotNull(), F.concat(F.repeat(F.lit("#"), F.substring("h", 2, 1).cast("int")), F.lit(" ")))
        .when(first_of_item, F.concat(F.repeat(F.lit("  "), F.greatest(F.col("depth") - 1, F.lit(0))), F.lit("- ")))
        .when(F.col("li") >= 0, F.repeat(F.lit("  "), F.col("depth")))
        .otherwise("")
    )
    same_list = (F.col("li") >= 0) & (F.coalesce(F.lag("li").over(line), F.lit(-1)) >= 0)
    out = text.withColumn("_prefix", prefix).withColumn("_tight", same_list)
    part = F.concat(F.when(F.col("_tight"), "\n").otherwise("\n\n"), "_prefix", "body")
    return out.groupBy("rec_id").agg(
        F.trim(
            F.regexp_replace(
                F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", part.alias("p")))), lambda x: x["p"]), ""),
                "\n{3,}", "\n\n",
            )
        ).alias("_md")
    ).select("rec_id", F.regexp_replace("_md", r"^\n+|\n+$", "").alias("markdown"))


def multi_record_document(pages: DataFrame) -> DataFrame:
    """Layout Markdown of the records of a set, parted by rules and numbered.

    `pages` has (set_id, rec_ord, markdown); empty records are left out.
    """
    sizes = pages.groupBy("set_id").agg(F.count(F.lit(1)).alias("of"), F.min(F.when(F.col("markdown") != "", F.col("rec_ord"))).alias("_first"))
    placed = pages.filter(F.col("markdown") != "").join(sizes, "set_id")
    many = F.col("of") > 1
    part = F.concat_ws(
        "\n\n",
        F.when(many & (F.col("rec_ord") > F.col("_first")), "---"),
        F.when(many, F.concat(F.lit("## Record "), F.col("rec_ord").cast("string"), F.lit(" of "), F.col("of").cast("string"))),
        "markdown",
    )
    return placed.groupBy("set_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rec_ord", part.alias("p")))), lambda x: x["p"]), "\n\n").alias("document")
    )


def outline(nodes: DataFrame, clip: int = 160) -> DataFrame:
    """Indented markup of each record by depth, texts clipped for the page."""
    name = F.concat(
        "tag",
        F.when(F.col("id") != "", F.concat(F.lit("#"), "id")).otherwise(""),
        F.when(F.size("classes") > 0, F.concat(F.lit("."), F.array_join("classes", "."))).otherwise(""),
    )
    said = T.truncated(T.collapse_space("text"), clip)
    line = F.concat(F.repeat(F.lit("  "), "depth"), F.when(F.col("tag") == TEXT, said).otherwise(name))
    kept = nodes.filter((F.col("tag") != TEXT) | (T.collapse_space("text") != ""))
    return kept.groupBy("rec_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pre", line.alias("l")))), lambda x: x["l"]), "\n").alias("outline")
    )


def review_page(snapshots: DataFrame, outlines: DataFrame, summaries: DataFrame) -> DataFrame:
    """One Markdown page per queued record: facts, checks, structure, markup."""
    row = lambda label, value: F.concat(F.lit(f"| {label} | "), value, F.lit(" |"))
    facts = F.concat_ws(
        "\n",
        F.lit("| fact | value |"),
        F.lit("| --- | --- |"),
        row("tokens", F.col("source_tokens").cast("string")),
        row("retention", F.format_number("retention", 3)),
        row("duplication", F.format_number("duplication", 3)),
        row("largest field", F.concat_ws(" ", F.format_number("largest_share", 3), "largest_kind")),
        row("signals", F.array_join("signals", ", ")),
    )
    return (
        snapshots.join(outlines, "rec_id")
        .join(summaries, "rec_id", "left")
        .select(
            "rec_id",
            F.concat_ws(
                "\n\n",
                F.concat(F.lit("# "), escape("key")),
                facts,
                F.concat(F.lit("## Structure\n\n"), F.coalesce("structure", F.lit("(none)"))),
                F.concat(F.lit("## Markup\n\n```\n"), "outline", F.lit("\n```")),
            ).alias("page"),
        )
    )


def structure_summary(nodes: DataFrame, k: int = 10) -> DataFrame:
    """Commonest tags of each record on one line."""
    counts = nodes.filter(F.col("tag") != TEXT).groupBy("rec_id", "tag").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("rec_id").orderBy(F.col("n").desc(), "tag")
    best = counts.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k)
    item = F.concat_ws("×", "tag", F.col("n").cast("string"))
    return best.groupBy("rec_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", item.alias("t")))), lambda x: x["t"]), ", ").alias("structure")
    )
