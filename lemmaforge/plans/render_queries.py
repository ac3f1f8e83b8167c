"""Rendering queries: documents as entries, pages as layout."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lemmaforge.functions import text as T
from lemmaforge.functions.markup import TEXT
from lemmaforge.operators import metrics as M
from lemmaforge.operators import nodes as N
from lemmaforge.operators import render as R
from lemmaforge.operators import style as S
from lemmaforge.operators.intervals import inside
from lemmaforge.plans.page_queries import page_nodes, page_records, text_sql
from lemmaforge.plans.registry import query, table
from lemmaforge.plans.validate_queries import LINES, checked, documents, with_fields


def document_entries(spark, sf_dir) -> R.Entries:
    """Lines of a document as an entry; four documents make a set."""
    docs = with_fields(documents(spark, sf_dir)).select(
        F.col("doc_id").alias("rec_id"), "lang", "fields"
    ).repartition("rec_id")
    lines = docs.select("rec_id", "lang", F.posexplode("fields").alias("i", "f")).select("rec_id", "lang", "i", "f.kind", "f.text")
    upto = Window.partitionBy("rec_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("sense", F.sum((F.col("kind") == "definition").cast("int")).over(upto).cast("int"))
    heads = lines.filter(F.col("kind") == "headword").select("rec_id", F.col("text").alias("headword"))
    records = docs.select("rec_id").join(heads, "rec_id", "left").select(
        "rec_id",
        F.floor(F.col("rec_id") / 4).cast("string").alias("set_id"),
        (F.col("rec_id") % 4 + 1).alias("rec_ord"),
        F.col("rec_id").cast("string").alias("lookup_key"),
        "headword",
    )
    none = F.lit(None).cast("string")
    nothing = F.array().cast("array<string>")
    listed = F.transform(
        F.sort_array(F.collect_list(F.when(F.col("kind") == "example", F.struct("i", "text")))),
        lambda x: F.struct(x["text"].alias("text"), none.alias("translation")),
    )
    senses = (
        placed.filter(F.col("sense") > 0)
        .groupBy("rec_id", "sense")
        .agg(
            F.min_by(F.when(F.col("kind") == "definition", F.col("text")), F.when(F.col("kind") == "definition", F.col("i"))).alias("definition"),
            F.min_by(F.when(F.col("kind") == "translation", F.col("text")), F.when(F.col("kind") == "translation", F.col("i"))).alias("translation"),
            listed.alias("examples"),
        )
        .select(
            "rec_id", F.lit(0).alias("part_ord"), F.array("sense").alias("path"), none.alias("number"), "definition", "translation",
            nothing.alias("labels"), none.alias("grammar"), none.alias("topic"), nothing.alias("patterns"),
            nothing.alias("synonyms"), nothing.alias("antonyms"), "examples",
        )
    )
    pos = F.when(F.col("lang") == "en", "noun").when(F.col("lang") == "de", "verb").otherwise("")
    parts = docs.select("rec_id", F.lit(0).alias("part_ord"), pos.alias("pos"), F.lit("").alias("grammar"))
    terms = placed.filter((F.col("sense") == 0) & F.col("kind").isin("example", "translation")).select(
        "rec_id", F.lit("collocation").alias("kind"), F.col("i").alias("ord"), F.col("text").alias("value")
    )
    sections = placed.filter(F.col("kind").isin("section", "fallback")).select(
        "rec_id", F.lit("section").alias("kind"), F.col("i").alias("ord"),
        F.when(F.col("kind") == "fallback", "Entry").otherwise("").alias("title"), F.col("text").alias("body"),
    )
    return R.Entries(records, parts=parts, senses=senses, terms=terms, sections=sections)


ESC = r"trim(regexp_replace({0}, '([\\`*_\[\]<>])', '\\\1', 'g'))"
E_T = ESC.format("t")

ENTRY = rf"""{LINES}, z AS (SELECT *, (sum((kind = 'definition')::INT) OVER (PARTITION BY doc_id ORDER BY i))::INT AS sense FROM f1),
head AS (SELECT doc_id, t AS headword FROM z WHERE kind = 'headword'),
ex AS (SELECT doc_id, sense, i, t, row_number() OVER (PARTITION BY doc_id, sense ORDER BY i) AS k FROM z WHERE kind = 'example' AND sense > 0),
se AS (SELECT doc_id, sense, max(t) FILTER (WHERE kind = 'definition') AS d, arg_min(t, i) FILTER (WHERE kind = 'translation') AS tr FROM z WHERE sense > 0 GROUP BY ALL),
sz AS (SELECT doc_id // 4 AS s, count(*) AS n FROM documents GROUP BY 1)"""


@query(
    "r01_markdown_records",
    rf"""WITH {ENTRY},
sl AS (SELECT doc_id, sense, 0 AS k, '- **' || sense || '** ' || {ESC.format('d')} || CASE WHEN tr IS NOT NULL THEN ' — ' || {ESC.format('tr')} ELSE '' END AS l FROM se
  UNION ALL SELECT doc_id, sense, k, '  - *' || {E_T} || '*' FROM ex WHERE k <= 4),
sb AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY sense, k) AS b FROM sl GROUP BY doc_id),
cb AS (SELECT doc_id, string_agg('- ' || {E_T}, chr(10) ORDER BY i) AS b FROM z WHERE sense = 0 AND kind IN ('example', 'translation') GROUP BY doc_id),
bl AS (SELECT doc_id, 0 AS o, 0 AS i, '' AS title, '*headword:* ' || {ESC.format('headword')} AS b FROM head
  UNION ALL SELECT doc_id, 2, 0, CASE lang WHEN 'en' THEN 'noun' WHEN 'de' THEN 'verb' ELSE '' END, b FROM sb JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 8, 0, 'Collocations', b FROM cb
  UNION ALL SELECT doc_id, 17, i, CASE kind WHEN 'fallback' THEN 'Entry' ELSE 'Note' END, {E_T} FROM z WHERE kind IN ('section', 'fallback')),
tx AS (SELECT doc_id, string_agg(CASE WHEN title <> '' THEN CASE WHEN n > 1 THEN '### ' ELSE '## ' END || title || chr(10) || chr(10) || b ELSE b END, chr(10) || chr(10) ORDER BY o, i) AS text
  FROM bl JOIN sz ON sz.s = doc_id // 4 GROUP BY doc_id)
SELECT (d.doc_id // 4)::VARCHAR AS set_id, d.doc_id % 4 + 1 AS rec_ord, sz.n AS of, d.doc_id::VARCHAR AS lookup_key, coalesce(tx.text, '') AS text
FROM documents d JOIN sz ON sz.s = d.doc_id // 4 LEFT JOIN tx USING (doc_id)""",
)
def markdown_records(spark, sf_dir):
    return R.render_records(document_entries(spark, sf_dir), "markdown")


TEXTS = rf"""{ENTRY},
sl AS (SELECT doc_id, sense, 0 AS k, sense || '. ' || d || CASE WHEN tr IS NOT NULL THEN ' — ' || tr ELSE '' END AS l FROM se
  UNION ALL SELECT doc_id, sense, k, '  Example: ' || t FROM ex WHERE k <= 4),
sb AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY sense, k) AS b FROM sl GROUP BY doc_id),
cb AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY i) AS b FROM z WHERE sense = 0 AND kind IN ('example', 'translation') GROUP BY doc_id),
bl AS (SELECT doc_id, 0 AS o, 0 AS i, 'Headword: ' || headword AS b FROM head
  UNION ALL SELECT doc_id, 2, 0, CASE lang WHEN 'en' THEN 'noun' WHEN 'de' THEN 'verb' ELSE 'Meanings' END || chr(10) || b FROM sb JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 8, 0, 'Collocations' || chr(10) || b FROM cb
  UNION ALL SELECT doc_id, 17, i, CASE kind WHEN 'fallback' THEN 'Entry' ELSE 'Note' END || chr(10) || t FROM z WHERE kind IN ('section', 'fallback')),
tx AS (SELECT doc_id, string_agg(b, chr(10) || chr(10) ORDER BY o, i) AS text FROM bl GROUP BY doc_id)"""


@query(
    "r02_plain_text_sets",
    rf"""WITH {TEXTS},
pt AS (SELECT d.doc_id // 4 AS s, d.doc_id, CASE WHEN n > 1 AND d.doc_id % 4 > 0 THEN '====================' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN n > 1 THEN 'Record ' || (d.doc_id % 4 + 1) || ' of ' || n || CASE WHEN tx.text IS NULL THEN '' ELSE chr(10) || chr(10) END ELSE '' END || coalesce(tx.text, '') AS p
  FROM documents d JOIN sz ON sz.s = d.doc_id // 4 LEFT JOIN tx USING (doc_id))
SELECT s::VARCHAR AS set_id, max(doc_id::VARCHAR) || chr(10) || chr(10) || string_agg(p, chr(10) || chr(10) ORDER BY doc_id) || chr(10) AS document FROM pt GROUP BY s""",
)
def plain_text_sets(spark, sf_dir):
    return R.render_sets(R.render_records(document_entries(spark, sf_dir), "text"), "text")


@query(
    "r03_card_parts",
    rf"""WITH {ENTRY} SELECT doc_id AS rec_id, row_number() OVER (PARTITION BY doc_id ORDER BY sense) AS card_ord,
CASE lang WHEN 'en' THEN 'n.' WHEN 'de' THEN 'v.' ELSE '' END AS label, sense::VARCHAR AS number,
d || CASE WHEN tr IS NOT NULL THEN ' — ' || tr ELSE '' END AS meaning, '' AS grammar FROM se JOIN documents USING (doc_id)""",
)
def card_parts(spark, sf_dir):
    return R.card_parts(document_entries(spark, sf_dir))


@query(
    "r04_phonetic_slots",
    """WITH r AS (SELECT l_orderkey, min(CASE WHEN l_suppkey % 5 = 0 THEN l_linenumber END) AS uki, min(CASE WHEN l_suppkey % 5 = 1 THEN l_linenumber END) AS usi,
  min(CASE WHEN l_suppkey % 5 = 2 THEN l_linenumber END) AS shi, min(CASE WHEN l_suppkey % 5 = 3 THEN l_linenumber END) AS odi, min(CASE WHEN l_suppkey % 5 = 4 THEN l_linenumber END) AS uka FROM lineitem GROUP BY 1)
SELECT l_orderkey AS rec_id, CASE WHEN uki IS NOT NULL THEN 'i' || uki WHEN uka IS NOT NULL AND shi IS NOT NULL THEN 'i' || shi || ' · 共用音标'
    WHEN uka IS NULL AND shi IS NOT NULL THEN 'i' || shi || ' · 共用音标' WHEN uka IS NULL AND odi IS NOT NULL THEN 'i' || odi || ' · 未标口音' END AS uk_value,
  CASE WHEN uka IS NOT NULL THEN 'a' || uka END AS uk_audio,
  CASE WHEN usi IS NOT NULL THEN 'i' || usi WHEN uki IS NOT NULL AND shi IS NOT NULL THEN 'i' || shi || ' · 共用音标'
    WHEN odi IS NOT NULL AND (uki IS NOT NULL OR uka IS NOT NULL OR shi IS NOT NULL) THEN 'i' || odi || ' · 未标口音' END AS us_value
FROM r""",
)
def phonetic_slots(spark, sf_dir):
    kind = F.col("l_suppkey") % 5
    audio = kind == 4
    region = F.when(kind.isin(0, 4), "uk").when(kind == 1, "us").when(kind == 2, "neutral").otherwise("other")
    number = F.col("l_linenumber").cast("string")
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("rec_id"),
        F.col("l_linenumber").alias("ord"),
        F.when(~audio, region).alias("ipa_region"),
        F.when(~audio, F.concat(F.lit("i"), number)).alias("ipa"),
        F.when(audio, region).alias("audio_region"),
        F.when(audio, F.concat(F.lit("a"), number)).alias("audio"),
    )
    return R.phonetic_slots(items).select("rec_id", "uk_value", "uk_audio", "us_value")


@query(
    "r05_record_preview",
    rf"""WITH {ENTRY}, c AS (SELECT doc_id, 0 AS o, sense AS i, CASE lang WHEN 'en' THEN 'noun · ' WHEN 'de' THEN 'verb · ' ELSE '' END || d || CASE WHEN tr IS NOT NULL THEN ' — ' || tr ELSE '' END AS t FROM se JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 1, i, t FROM z WHERE kind IN ('section', 'fallback')),
g AS (SELECT doc_id, o, arg_min(t, i) AS t, count(*) AS n FROM c GROUP BY ALL),
b AS (SELECT doc_id, trim(regexp_replace(arg_min(t, o), '[\s\x{{a0}}]+', ' ', 'g')) AS t, arg_min(n, o) > 1 AS more FROM g GROUP BY doc_id),
s AS (SELECT doc_id, CASE WHEN length(t) > 80 THEN trim(t[1:80]) ELSE t END AS t, more OR length(t) > 80 AS more FROM b)
SELECT doc_id AS rec_id, t || CASE WHEN more AND NOT regexp_matches(t, '(…|\.\.\.)$') THEN '…' ELSE '' END AS preview FROM s""",
)
def record_preview(spark, sf_dir):
    return R.record_previews(document_entries(spark, sf_dir))


@query(
    "r07_markdown_escape",
    rf"""SELECT doc_id, sha256({ESC.format("replace(text, chr(10), ' ')")}) AS escaped,
'`' || trim(regexp_replace(text, '\s+', ' ', 'g')) || '`' AS span FROM documents WHERE NOT contains(text, '`')
UNION ALL SELECT doc_id, sha256({ESC.format("replace(text, chr(10), ' ')")}), '``' || trim(regexp_replace(text, '\s+', ' ', 'g')) || '``' FROM documents WHERE contains(text, '`')""",
)
def markdown_escape(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.sha2(R.escape("text"), 256).alias("escaped"), R.code_span("text").alias("span")
    )


@query(
    "r07_markdown_table",
    """WITH c AS (SELECT l_orderkey, l_linenumber, string_agg(l_returnflag || '|' || l_linestatus, '/' ORDER BY l_partkey, l_extendedprice) AS v FROM lineitem GROUP BY ALL),
t AS (SELECT l_orderkey, list('| ' || l_linenumber || ' | ' || replace(v, '|', '\\|') || ' |' ORDER BY l_linenumber) AS rows FROM c GROUP BY 1)
SELECT l_orderkey, array_to_string(list_concat(['| line | flags |', '| --- | --- |'], rows), chr(10)) AS md FROM t""".replace("'\\\\|'", "'\\|'"),
)
def markdown_table(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    flags = F.concat_ws("|", "l_returnflag", "l_linestatus")
    cells = lines.groupBy("l_orderkey", "l_linenumber").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_partkey", "l_extendedprice", flags.alias("f")))), lambda x: x["f"]), "/").alias("v")
    )
    rows = cells.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "v"))).alias("r"))
    body = F.transform("r", lambda x: F.array(x["l_linenumber"].cast("string"), x["v"]))
    return rows.withColumn("t", F.concat(F.array(F.array(F.lit("line"), F.lit("flags"))), body)).select(
        "l_orderkey", R.table_lines(F.col("t")).alias("md")
    )


@query("r08_page_markdown")
def page_markdown(spark, sf_dir):
    return R.page_markdown(page_nodes(spark, sf_dir))


@query("r10_page_documents")
def page_documents(spark, sf_dir):
    pages = R.page_markdown(page_nodes(spark, sf_dir)).select(
        F.floor(F.col("rec_id") / 3).cast("string").alias("set_id"), (F.col("rec_id") % 3 + 1).alias("rec_ord"), "markdown"
    )
    return R.multi_record_document(pages)


@query(
    "r11_link_targets",
    """SELECT page_id, x AS position, 'entry://' || replace(replace(substr(ref, 2), '%', '%25'), ' ', '%20') || '+x#top' AS href, trim(substr(ref, 2)) || '+x' AS target
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#]*)"', 1)) AS ref, generate_subscripts(regexp_extract_all(html, 'href="(/[^"#]*)"', 1), 1)::BIGINT AS x FROM pages)""",
)
def link_targets(spark, sf_dir):
    refs = table(spark, sf_dir, "pages").select(
        "page_id", F.posexplode(F.expr("regexp_extract_all(html, 'href=\"(/[^\"#]*)\"', 1)")).alias("i", "ref")
    )
    word = F.replace(F.replace(F.expr("substring(ref, 2)"), F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    href = F.concat(F.lit("entry://"), word, F.lit("+x#top"))
    return refs.select(
        "page_id", (F.col("i") + 1).cast("bigint").alias("position"), href.alias("href"), R.link_headword(href).alias("target")
    )


@query("r12_review_pages")
def review_pages(spark, sf_dir):
    nodes = page_nodes(spark, sf_dir)
    facts = M.snapshots(checked(spark, sf_dir))
    return R.review_page(facts, R.outline(nodes), R.structure_summary(nodes))


@query(
    "v06_fields_in_order",
    rf"""WITH {LINES} SELECT doc_id AS rec_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS field_ord, kind, t AS text FROM f1""",
)
def fields_in_order(spark, sf_dir):
    fields = with_fields(documents(spark, sf_dir)).select(F.col("doc_id").alias("rec_id"), F.posexplode("fields").alias("i", "f"))
    return fields.select("rec_id", (F.col("i") + 1).cast("bigint").alias("field_ord"), "f.kind", "f.text")


@query(
    "v10_render_parity",
    rf"""WITH {LINES}, w AS (SELECT doc_id, count(*) FILTER (WHERE kind IN ('headword', 'definition', 'section', 'fallback'))::BIGINT AS n FROM f1 GROUP BY doc_id)
SELECT doc_id AS rec_id, n AS fields, 0::BIGINT AS missing FROM w WHERE n > 0""",
)
def render_parity(spark, sf_dir):
    """Every definition, headword and section stands in the Markdown of its record."""
    entries = document_entries(spark, sf_dir)
    rendered = R.render_records(entries, "markdown").select(F.col("lookup_key").cast("bigint").alias("rec_id"), T.compare_form("text").alias("md"))
    fields = with_fields(documents(spark, sf_dir)).select(F.col("doc_id").alias("rec_id"), F.explode("fields").alias("f"))
    wanted = fields.filter(F.col("f.kind").isin("headword", "definition", "section", "fallback"))
    return (
        wanted.join(rendered, "rec_id")
        .withColumn("lost", ~F.contains("md", T.compare_form(R.escape("f.text"))))
        .groupBy("rec_id")
        .agg(F.count(F.lit(1)).alias("fields"), F.count_if("lost").alias("missing"))
    )


STYLE = (
    ".ad{display:none} nav ul li a:hover{display:none} nav li a, footer{font-weight:bold} article>p{margin:0 8px !important} "
    "@media (max-width:10px){p{display:none}} /* p{float:left} */ h1+p{font-style:italic} p{margin-left:1px;color:red} "
    "li:before{content:\"\\2022 \"} @media screen{footer{visibility:hidden}}"
)


def _styled_nodes(spark, sf_dir):
    content = F.replace("content", F.lit("<style>p{margin:0}</style>"), F.lit(f"<style>{STYLE}</style>"))
    nodes = N.html_nodes(page_records(spark, sf_dir).withColumn("content", content))
    sheets = (
        inside(nodes, _sheet=F.col("tag") == "style")
        .filter((F.col("tag") == TEXT) & F.col("_sheet"))
        .select("dict_id", F.col("text").alias("css"))
        .distinct()
        .withColumn("sheet_ord", F.lit(0))
    )
    return nodes, S.css_rules(sheets)


@query(
    "c01_css_rules",
    """SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS dict_id, r.* FROM pages, (VALUES
 ('.ad', '', 'display', 'none', false, 1000::BIGINT), ('nav li a', '', 'font-weight', 'bold', false, 3), ('footer', '', 'font-weight', 'bold', false, 1),
 ('article>p', '', 'margin-left', '8px', true, 2), ('article>p', '', 'margin-right', '8px', true, 2), ('h1+p', '', 'font-style', 'italic', false, 2),
 ('p', '', 'margin-left', '1px', false, 1), ('li:before', 'before', 'content', '"' || chr(92) || '2022 "', false, 2), ('footer', '', 'visibility', 'hidden', false, 1)) r(selector, pseudo, property, value, important, specificity)""",
)
def css_rules(spark, sf_dir):
    return _styled_nodes(spark, sf_dir)[1].select("dict_id", "selector", "pseudo", "property", "value", "important", "specificity")


@query(
    "c02_cascade_winners",
    """WITH c AS (SELECT page_id AS rec_id, html FROM pages),
n AS (SELECT rec_id, 'display' AS property, 'none' AS value, len(regexp_extract_all(html, 'class="ad"')) AS n FROM c
UNION ALL SELECT rec_id, 'font-weight', 'bold', len(regexp_extract_all(html, '<a ')) + len(regexp_extract_all(html, '<footer>')) FROM c
UNION ALL SELECT rec_id, 'margin-left', '8px', len(regexp_extract_all(html, '<p>')) FROM c
UNION ALL SELECT rec_id, 'margin-right', '8px', len(regexp_extract_all(html, '<p>')) FROM c
UNION ALL SELECT rec_id, 'font-style', 'italic', len(regexp_extract_all(html, '</h1><p>')) FROM c
UNION ALL SELECT rec_id, 'visibility', 'hidden', len(regexp_extract_all(html, '<footer>')) FROM c
UNION ALL SELECT rec_id, 'content', '"' || chr(92) || '2022 "', len(regexp_extract_all(html, '<li>')) FROM c)
SELECT rec_id, property, value, n::BIGINT AS n FROM n WHERE n > 0""",
)
def cascade_winners(spark, sf_dir):
    nodes, rules = _styled_nodes(spark, sf_dir)
    return S.cascade(nodes, rules).groupBy("rec_id", "property", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "c03_inherited_visibility",
    f"""SELECT page_id AS rec_id, {text_sql(r"regexp_extract(html, '(?s)<footer>(.*?)(</footer>|$)', 1)")} AS hidden_text FROM pages
WHERE {text_sql(r"regexp_extract(html, '(?s)<footer>(.*?)(</footer>|$)', 1)")} <> ''""",
)
def inherited_visibility(spark, sf_dir):
    nodes, rules = _styled_nodes(spark, sf_dir)
    flags = S.inherited_visibility(nodes, S.cascade(nodes, rules)).filter("hidden")
    pieces = N.text_pieces(nodes).join(flags.select("rec_id", "pre"), ["rec_id", "pre"], "left_semi")
    return N.joined_text(pieces, ["rec_id"], "hidden_text").filter(F.col("hidden_text") != "")


@query(
    "c04_generated_text",
    "SELECT page_id AS rec_id, '•' AS text, len(regexp_extract_all(html, '<li>'))::BIGINT AS n FROM pages WHERE contains(html, '<li>')",
)
def generated_text(spark, sf_dir):
    nodes, rules = _styled_nodes(spark, sf_dir)
    made = S.generated_text(nodes, S.cascade(nodes, rules))
    return made.groupBy("rec_id", F.trim("text").alias("text")).agg(F.count(F.lit(1)).alias("n"))
