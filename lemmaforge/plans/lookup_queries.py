"""Lookup queries over parts (records), orders (queries) and page links (resources)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lemmaforge.functions import keys as K
from lemmaforge.operators import lookup as L
from lemmaforge.operators import ranking
from lemmaforge.plans.bindings import (
    BRAND_DICTIONARIES,
    ORDER_QUERIES,
    PAGE_REFS,
    PART_RECORDS,
    brand_dictionaries,
    order_queries,
    page_refs,
    page_resources,
    part_records,
)
from lemmaforge.plans.registry import query, table

INDEX = """idx AS (
  SELECT dict_id, key, min(source_ord) AS first_ord, lower(nfc_normalize(trim(key))) AS fold
  FROM records GROUP BY dict_id, key
)"""

# The four tiers one by one, each with its own join.
MATCHES = """cand AS (
  SELECT t.query, i.dict_id, i.key, 1 AS tier, i.first_ord FROM texts t JOIN idx i ON i.key = trim(t.query)
  UNION ALL
  SELECT t.query, i.dict_id, i.key, 2, i.first_ord FROM texts t JOIN idx i ON i.key = nfc_normalize(trim(t.query))
  UNION ALL
  SELECT t.query, i.dict_id, i.key, 3, i.first_ord FROM texts t JOIN idx i ON i.key = lower(nfc_normalize(trim(t.query)))
  UNION ALL
  SELECT t.query, i.dict_id, i.key, 4, i.first_ord FROM texts t
  JOIN idx i ON i.fold = lower(nfc_normalize(trim(t.query))) AND i.fold <> i.key
), matches AS (
  SELECT query, dict_id, key AS matched_key, tier::BIGINT AS tier FROM (
    SELECT *, row_number() OVER (PARTITION BY query, dict_id ORDER BY tier, first_ord) AS rn FROM cand
  ) WHERE rn = 1
)"""

BASE = f"WITH RECURSIVE {PART_RECORDS}, {ORDER_QUERIES}, {BRAND_DICTIONARIES}, {INDEX}"
MATCHED = f"{BASE}, texts AS (SELECT DISTINCT query FROM queries), {MATCHES}"

NUMBERED = r"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY dict_id, key ORDER BY source_ord) AS raw_ord,
         CASE WHEN content LIKE '@@@LINK=_%' THEN substr(content, 9) END AS link
  FROM records
)"""

# Depth-first resolution of every key, by the path of raw ordinals.
RESOLVED = f"""{NUMBERED}, link_cand AS (
  SELECT n.dict_id, n.key, n.raw_ord, i.key AS to_key, i.first_ord,
         CASE WHEN i.key = n.link THEN 1 WHEN i.key = lower(n.link) THEN 3 ELSE 4 END AS tier
  FROM numbered n JOIN idx i ON i.dict_id = n.dict_id AND i.fold = lower(nfc_normalize(trim(n.link)))
  WHERE n.link IS NOT NULL
), edges AS (
  SELECT dict_id, key, raw_ord, to_key FROM (
    SELECT *, row_number() OVER (PARTITION BY dict_id, key, raw_ord ORDER BY tier, first_ord) AS rn FROM link_cand
  ) WHERE rn = 1
), walk AS (
  SELECT dict_id, key AS root, key AS node, [key] AS seen, []::BIGINT[] AS path, 0 AS depth FROM idx
  UNION ALL
  SELECT w.dict_id, w.root, e.to_key, list_append(w.seen, e.to_key), list_append(w.path, e.raw_ord), w.depth + 1
  FROM walk w JOIN edges e ON e.dict_id = w.dict_id AND e.key = w.node
  WHERE w.depth < 8 AND NOT list_contains(w.seen, e.to_key)
), resolved AS (
  SELECT w.dict_id, w.root AS key, n.key AS matched_key, n.raw_ord, w.depth, n.source_ord,
         list_append(w.path, n.raw_ord) AS path, n.content,
         CASE WHEN w.depth > 0 THEN w.root END AS redirected_from
  FROM walk w JOIN numbered n ON n.dict_id = w.dict_id AND n.key = w.node
  WHERE n.link IS NULL
), answers AS (
  SELECT *, row_number() OVER (PARTITION BY dict_id, key ORDER BY path) AS rec_ord FROM (
    SELECT *, row_number() OVER (PARTITION BY dict_id, key, content ORDER BY path) AS dup FROM resolved
  ) WHERE dup = 1
)"""


@query(
    "s04_records_source",
    f"""WITH {PART_RECORDS}, n AS (
  SELECT dict_id, key, source_ord, trim(key) AS norm_key, lower(trim(key)) AS fold_key,
         row_number() OVER (PARTITION BY dict_id, key ORDER BY source_ord) AS raw_ord FROM records)
SELECT dict_id, key, source_ord, norm_key, fold_key, raw_ord FROM n""",
)
def records_source(spark, sf_dir):
    numbered = L.numbered_records(part_records(spark, sf_dir))
    return numbered.select(
        "dict_id",
        "key",
        "source_ord",
        K.norm_key("key").alias("norm_key"),
        K.fold_key("key").alias("fold_key"),
        "raw_ord",
    )


@query(
    "s06_registry_summary",
    f"""WITH {BRAND_DICTIONARIES}, {PART_RECORDS}, audio AS (
  SELECT dict_id, bool_or(content LIKE '%STEEL%' OR key LIKE '%bolt%') AS has_audio FROM records GROUP BY dict_id)
SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE health = 'ok')::BIGINT AS healthy,
       sum(entry_count)::BIGINT AS entries, bool_or(has_audio) AS any_audio
FROM dictionaries JOIN audio USING (dict_id)""",
)
def registry_summary(spark, sf_dir):
    audio = part_records(spark, sf_dir).groupBy("dict_id").agg(
        F.bool_or(F.col("content").contains("STEEL") | F.col("key").contains("bolt")).alias("has_audio")
    )
    return brand_dictionaries(spark, sf_dir).join(audio, "dict_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("health") == "ok").alias("healthy"),
        F.sum("entry_count").alias("entries"),
        F.bool_or("has_audio").alias("any_audio"),
    )


# Letters of the texts written as base letter plus accent, to be composed again.
DECOMPOSE = [("é", "é"), ("è", "è"), ("ü", "ü"), ("ñ", "ñ"), ("ç", "ç"), ("ó", "ó")]


def _decomposed_sql(column: str) -> str:
    out = column
    for whole, split in DECOMPOSE:
        out = f"replace({out}, '{whole}', '{split}')"
    return out


def _decomposed(column):
    out = F.col(column)
    for whole, split in DECOMPOSE:
        out = F.replace(out, F.lit(whole), F.lit(split))
    return out


@query(
    "p01_norm_key",
    f"""SELECT doc_id, sha256(nfc_normalize(trim({_decomposed_sql('text')}, chr(10) || chr(9) || chr(13) || ' '))) AS norm_hash,
       length(nfc_normalize(trim({_decomposed_sql('text')}, chr(10) || chr(9) || chr(13) || ' ')))::BIGINT AS norm_length
FROM documents""",
)
def norm_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", _decomposed("text").alias("key"))
    return docs.withColumn("norm", K.norm_key("key")).select(
        "doc_id", F.sha2("norm", 256).alias("norm_hash"), F.length("norm").cast("bigint").alias("norm_length")
    )


@query(
    "p02_fold_key",
    f"""WITH {PART_RECORDS} SELECT lower(nfc_normalize(trim(key))) AS fold_key, count(*) AS records,
       count(DISTINCT key) AS spellings FROM records GROUP BY 1""",
)
def fold_key(spark, sf_dir):
    return (
        part_records(spark, sf_dir)
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(K.fold_key("key").alias("fold_key"))
        .agg(F.sum("n").alias("records"), F.count(F.lit(1)).alias("spellings"))
    )


@query(
    "p03_record_selector",
    r"""WITH s AS (
  SELECT p_partkey, CASE p_partkey % 4
      WHEN 0 THEN p_name || '^' || p_size WHEN 1 THEN p_name || '^{' || p_size || '}'
      WHEN 2 THEN p_name || translate(p_size::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') ELSE p_name END AS selector
  FROM part)
SELECT p_partkey, selector,
       nullif(trim(regexp_extract(translate(regexp_replace(selector, '([⁰¹²³⁴⁵⁶⁷⁸⁹]+)$', '^\1'), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'),
              '^(.*)\^\{?([0-9]+)\}?$', 1)), '') AS base,
       try_cast(regexp_extract(translate(regexp_replace(selector, '([⁰¹²³⁴⁵⁶⁷⁸⁹]+)$', '^\1'), '⁰¹²³⁴⁵⁶⁷⁸⁹', '0123456789'),
              '^(.*)\^\{?([0-9]+)\}?$', 2) AS BIGINT) AS ordinal
FROM s""",
)
def record_selector(spark, sf_dir):
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    selector = (
        F.when(kind == 0, F.concat("p_name", F.lit("^"), size))
        .when(kind == 1, F.concat("p_name", F.lit("^{"), size, F.lit("}")))
        .when(kind == 2, F.concat("p_name", F.translate(size, "0123456789", K.SUPERSCRIPTS)))
        .otherwise(F.col("p_name"))
    )
    base, ordinal = K.selector_base_ordinal("selector")
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", selector.alias("selector"))
        .select("p_partkey", "selector", base.alias("base"), ordinal.alias("ordinal"))
    )


@query(
    "p04_redirect_parse",
    f"""WITH {PART_RECORDS} SELECT dict_id, source_ord,
       CASE WHEN content LIKE '@@@LINK=_%' THEN trim(substr(content, 9)) END AS link FROM records""",
)
def redirect_parse(spark, sf_dir):
    return part_records(spark, sf_dir).select("dict_id", "source_ord", K.link_target("content").alias("link"))


RES_KEY_SQL = r"""lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(
    trim({ref}), '\', '/'), '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '/+', '/', 'g'), '^/', ''), '[?#].*$', ''))"""

URL_KEY = RES_KEY_SQL.format(ref="url")
REF_KEY = RES_KEY_SQL.format(ref="ref")


@query("p05_resource_key", f"SELECT page_id, {URL_KEY} AS res_key FROM pages")
def resource_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", K.resource_key("url").alias("res_key"))


@query(
    "p06_resource_candidates",
    f"""WITH k AS (SELECT page_id, {URL_KEY} AS res_key FROM pages),
c AS (SELECT page_id, 0 AS cand, res_key FROM k UNION ALL
      SELECT page_id, 1, regexp_extract(rtrim(res_key, '/'), '([^/]*)$', 1) FROM k)
SELECT page_id, cand::BIGINT AS cand, res_key FROM c c1 WHERE res_key <> '' AND (cand = 0 OR NOT EXISTS
  (SELECT 1 FROM k WHERE k.page_id = c1.page_id AND k.res_key = c1.res_key))""",
)
def resource_candidates(spark, sf_dir):
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.posexplode(K.resource_candidates("url")).alias("cand", "res_key"))
        .withColumn("cand", F.col("cand").cast("bigint"))
    )


@query(
    "p07_media_classify",
    r"""WITH f AS (SELECT page_id, url || CASE page_id % 6 WHEN 0 THEN '.mp3' WHEN 1 THEN '.SPX?x=1' WHEN 2 THEN '.png'
      WHEN 3 THEN '/style.css' WHEN 4 THEN '.jpeg' ELSE '' END AS ref FROM pages),
e AS (SELECT page_id, regexp_extract(""" + REF_KEY + r""", '(\.[^./]*)$', 1) AS ext FROM f)
SELECT page_id, ext IN ('.mp3','.wav','.ogg','.spx','.m4a','.aac','.flac') AS is_audio,
       ext IN ('.jpg','.jpeg','.png','.gif','.svg','.webp') AS is_image, ext = '.spx' AS is_speex,
       CASE ext WHEN '.mp3' THEN 'audio/mpeg' WHEN '.spx' THEN 'audio/wav' WHEN '.png' THEN 'image/png'
            WHEN '.jpeg' THEN 'image/jpeg' WHEN '.css' THEN 'text/css; charset=utf-8'
            ELSE 'application/octet-stream' END AS mime FROM e""",
)
def media_classify(spark, sf_dir):
    kind = F.col("page_id") % 6
    tail = (
        F.when(kind == 0, ".mp3").when(kind == 1, ".SPX?x=1").when(kind == 2, ".png")
        .when(kind == 3, "/style.css").when(kind == 4, ".jpeg").otherwise("")
    )
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.concat("url", tail).alias("ref"))
        .select(
            "page_id",
            K.is_audio_ref("ref").alias("is_audio"),
            K.is_image_ref("ref").alias("is_image"),
            K.is_speex_ref("ref").alias("is_speex"),
            K.mime_type("ref").alias("mime"),
        )
    )


@query(
    "p08_reference_scheme",
    r"""WITH r AS (SELECT unnest(list_concat([url], regexp_extract_all(html, '(?:href|src)="([^"]*)"', 1))) AS ref FROM pages)
SELECT CASE WHEN lower(ref) LIKE 'http://%' THEN 'http:' WHEN lower(ref) LIKE 'https://%' THEN 'https:'
            WHEN regexp_matches(lower(ref), '\.(mp3|spx|wav|ogg)([?#].*)?$') THEN 'bare-audio'
            WHEN regexp_matches(lower(ref), '\.(jpg|jpeg|png|gif|webp|svg)([?#].*)?$') THEN 'bare-image' ELSE '' END AS scheme,
       count(*) AS n FROM r GROUP BY 1""",
)
def reference_scheme(spark, sf_dir):
    refs = table(spark, sf_dir, "pages").select(
        F.explode(
            F.concat(F.array("url"), F.expr("regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)"))
        ).alias("ref")
    )
    return refs.groupBy(K.reference_scheme("ref").alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p09_stylesheet_path",
    r"""WITH s AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '.css' WHEN 1 THEN '\css\' || page_id || '.CSS?v=1'
      WHEN 2 THEN './a/./p' || page_id || '.css' WHEN 3 THEN '../x.css' ELSE '/data/p' || page_id || '.js' END AS href FROM pages)
SELECT page_id, href, CASE page_id % 5 WHEN 1 THEN 'css/' || page_id || '.CSS' WHEN 2 THEN 'a/p' || page_id || '.css' END AS sheet FROM s""",
)
def stylesheet_path(spark, sf_dir):
    kind = F.col("page_id") % 5
    number = F.col("page_id").cast("string")
    href = (
        F.when(kind == 0, F.concat("url", F.lit(".css")))
        .when(kind == 1, F.concat(F.lit("\\css\\"), number, F.lit(".CSS?v=1")))
        .when(kind == 2, F.concat(F.lit("./a/./p"), number, F.lit(".css")))
        .when(kind == 3, F.lit("../x.css"))
        .otherwise(F.concat(F.lit("/data/p"), number, F.lit(".js")))
    )
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", href.alias("href"))
        .withColumn("sheet", K.stylesheet_path("href"))
    )


@query(
    "p10_dictionary_select",
    f"""WITH {BRAND_DICTIONARIES}, {PART_RECORDS}
SELECT d.dict_id, d.dict_ord AS sel_ord, count(*) AS records FROM dictionaries d JOIN records r USING (dict_id)
WHERE d.health = 'ok' GROUP BY 1, 2""",
)
def dictionary_select(spark, sf_dir):
    chosen = L.select_dictionaries(brand_dictionaries(spark, sf_dir))
    counts = part_records(spark, sf_dir).groupBy("dict_id").agg(F.count(F.lit(1)).alias("records"))
    return chosen.join(counts, "dict_id").select("dict_id", "sel_ord", "records")


@query(
    "p12_size_filter",
    "SELECT page_id, octet_length(encode(html))::BIGINT AS bytes FROM pages WHERE octet_length(encode(html)) >= 120",
)
def size_filter(spark, sf_dir):
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", F.octet_length("html").cast("bigint").alias("bytes"))
        .filter(F.col("bytes") >= 120)
    )


@query(
    "p15_dictionary_find",
    f"""WITH {BRAND_DICTIONARIES} SELECT dict_id, title, entry_count FROM dictionaries
WHERE dict_id = 'brand#13' OR contains(lower(title), 'brand#13')""",
)
def dictionary_find(spark, sf_dir):
    return L.find_dictionary(brand_dictionaries(spark, sf_dir), "brand#13").select("dict_id", "title", "entry_count")


@query(
    "j01_batch_match",
    f"{MATCHED} SELECT q.query_id, m.dict_id, m.matched_key, m.tier FROM queries q JOIN matches m USING (query)",
)
def batch_match(spark, sf_dir):
    queries = order_queries(spark, sf_dir)
    matches = L.match_keys(queries, L.key_index(part_records(spark, sf_dir)))
    return queries.join(matches, "query").select("query_id", "dict_id", "matched_key", "tier")


@query(
    "j02_duplicate_expansion",
    f"""{MATCHED}, {NUMBERED} SELECT m.query, m.dict_id, m.matched_key, n.raw_ord, n.content
FROM matches m JOIN numbered n ON n.dict_id = m.dict_id AND n.key = m.matched_key""",
)
def duplicate_expansion(spark, sf_dir):
    records = part_records(spark, sf_dir)
    matches = L.match_keys(order_queries(spark, sf_dir), L.key_index(records))
    return L.expand_duplicates(matches, L.numbered_records(records)).select(
        "query", "dict_id", "matched_key", "raw_ord", "content"
    )


FLAGSHIP_SQL = f"""{MATCHED}, {NUMBERED}, sizes AS (
  SELECT dict_id, key AS matched_key, count(*) AS n FROM numbered GROUP BY ALL)
SELECT q.query_id, q.query, count(*)::BIGINT AS dictionaries, min(m.tier)::BIGINT AS best_tier, sum(s.n)::BIGINT AS records
FROM queries q JOIN matches m USING (query) JOIN sizes s USING (dict_id, matched_key) GROUP BY ALL"""


@query("j00_orders_lookup_report", FLAGSHIP_SQL)
def orders_lookup_report(spark, sf_dir):
    """For every order's text: dictionaries that match, best tier, records under the keys."""
    records = part_records(spark, sf_dir)
    queries = order_queries(spark, sf_dir)
    matches = L.match_keys(queries, L.key_index(records))
    sizes = records.groupBy("dict_id", F.col("key").alias("matched_key")).agg(F.count(F.lit(1)).alias("n"))
    per_text = matches.join(sizes, ["dict_id", "matched_key"]).groupBy("query").agg(
        F.count(F.lit(1)).alias("dictionaries"),
        F.min("tier").alias("best_tier"),
        F.sum("n").alias("records"),
    )
    return queries.join(per_text, "query").select("query_id", "query", "dictionaries", "best_tier", "records")


def _resolved(spark, sf_dir):
    records = part_records(spark, sf_dir)
    index = L.key_index(records)
    numbered = L.numbered_records(records)
    return L.resolved_records(index.select("dict_id", "key"), numbered, L.redirect_edges(numbered, index))


def _first_records(spark, sf_dir):
    records = part_records(spark, sf_dir)
    index = L.key_index(records)
    numbered = L.numbered_records(records)
    return L.first_records(index.select("dict_id", "key"), numbered, L.redirect_edges(numbered, index))


def _answers(spark, sf_dir):
    return L.lookup(order_queries(spark, sf_dir), part_records(spark, sf_dir))


@query(
    "j03_redirect_closure",
    f"""{BASE}, {RESOLVED} SELECT dict_id, key, matched_key, redirected_from, raw_ord, depth::BIGINT AS depth, content,
row_number() OVER (PARTITION BY dict_id, key ORDER BY path) AS position FROM resolved""",
)
def redirect_closure(spark, sf_dir):
    placed = L.visible_ordinals(_resolved(spark, sf_dir)).withColumnRenamed("rec_ord", "position")
    return placed.select(
        "dict_id", "key", "matched_key", "redirected_from", "raw_ord", "depth", "content", "position"
    )


@query(
    "j04_content_dedupe",
    f"""{BASE}, {RESOLVED} SELECT dict_id, key, content, matched_key, raw_ord FROM answers""",
)
def content_dedupe(spark, sf_dir):
    return _first_records(spark, sf_dir).select("dict_id", "key", "content", "matched_key", "raw_ord")


ANSWERED = f"""{MATCHED}, {RESOLVED}, found AS (
  SELECT m.query, m.dict_id, m.tier, a.key AS lookup_key, a.matched_key, a.redirected_from, a.raw_ord, a.rec_ord, a.content
  FROM matches m JOIN answers a ON a.dict_id = m.dict_id AND a.key = m.matched_key)"""


@query(
    "j05_first_answering",
    f"""{ANSWERED}, p AS (SELECT DISTINCT f.query, f.dict_id, d.dict_ord FROM found f JOIN dictionaries d USING (dict_id) WHERE d.health = 'ok')
SELECT query, dict_id, dict_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY dict_ord) AS dict_rank FROM p) WHERE dict_rank <= 3""",
)
def first_answering(spark, sf_dir):
    chosen = L.select_dictionaries(brand_dictionaries(spark, sf_dir))
    return L.first_answering(_answers(spark, sf_dir), chosen, 3).select("query", "dict_id", "dict_rank")


@query(
    "j06_prefix_suggest",
    f"""{MATCHED}, missed AS (
  SELECT query, lower(trim(query)) AS f FROM texts t WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.query = t.query)),
near AS (SELECT m.query, r.dict_id, r.key, d.dict_ord,
         row_number() OVER (PARTITION BY m.query, r.dict_id ORDER BY r.source_ord) AS rn
  FROM missed m JOIN records r ON starts_with(lower(r.key), m.f) JOIN dictionaries d ON d.dict_id = r.dict_id AND d.health = 'ok'),
uniq AS (SELECT query, key, min(dict_ord) AS dict_ord FROM near WHERE rn <= 8 GROUP BY query, key),
ranked AS (SELECT query, key AS suggestion, row_number() OVER (PARTITION BY query ORDER BY dict_ord, key) AS rank FROM uniq)
SELECT query, rank, suggestion FROM ranked WHERE rank <= 8""",
)
def prefix_suggest(spark, sf_dir):
    records = part_records(spark, sf_dir)
    queries = order_queries(spark, sf_dir).select("query").distinct()
    chosen = L.select_dictionaries(brand_dictionaries(spark, sf_dir))
    missed = queries.join(L.match_keys(queries, L.key_index(records)), "query", "left_anti")
    return L.prefix_suggest(missed, records, chosen)


RESOURCES = rf"""{PAGE_REFS}, stored AS (
  SELECT DISTINCT dict_id, lower('words/' || regexp_replace(ref, '^/', '')) AS res_key, page_id % 3 AS volume FROM refs
), asked AS (SELECT DISTINCT dict_id, 'sound://Words/' || ltrim(ref, '/') || '?v=1' AS ref FROM refs
  UNION SELECT DISTINCT dict_id, ref FROM refs)"""


def _asked(spark, sf_dir):
    refs = page_refs(spark, sf_dir)
    sounded = F.concat(F.lit("sound://Words/"), F.ltrim("ref", F.lit("/")), F.lit("?v=1"))
    return refs.select("dict_id", sounded.alias("ref")).union(refs.select("dict_id", "ref")).distinct()


def _stored(spark, sf_dir):
    return page_resources(spark, sf_dir).select("dict_id", K.resource_key("stored").alias("res_key"), "volume")


@query(
    "j07_resource_resolve",
    f"""WITH {RESOURCES}, k AS (SELECT *, {REF_KEY} AS k0 FROM asked),
c AS (SELECT dict_id, ref, 0 AS cand, k0 AS res_key FROM k UNION ALL
      SELECT dict_id, ref, 1, regexp_extract(rtrim(k0, '/'), '([^/]*)$', 1) FROM k)
SELECT dict_id, ref, res_key, cand::BIGINT AS cand, volume::BIGINT AS volume FROM (
  SELECT c.*, s.volume, row_number() OVER (PARTITION BY c.dict_id, c.ref ORDER BY cand, volume) AS rn
  FROM c JOIN stored s USING (dict_id, res_key)) WHERE rn = 1""",
)
def resource_resolve(spark, sf_dir):
    out = L.resolve_resources(_asked(spark, sf_dir), _stored(spark, sf_dir))
    return out.select("dict_id", "ref", "res_key", F.col("cand").cast("bigint"), F.col("volume").cast("bigint"))


@query(
    "j08_has_resource",
    f"""WITH {RESOURCES}, k AS (SELECT *, {REF_KEY} AS k0 FROM asked)
SELECT dict_id, ref FROM k WHERE EXISTS (SELECT 1 FROM stored s WHERE s.dict_id = k.dict_id
  AND s.res_key IN (k.k0, regexp_extract(rtrim(k.k0, '/'), '([^/]*)$', 1)))""",
)
def has_resource(spark, sf_dir):
    return L.has_resource(_asked(spark, sf_dir), _stored(spark, sf_dir))


@query(
    "j09_missing_stylesheets",
    f"""WITH {RESOURCES}, sheets AS (
  SELECT dict_id, ltrim(ref, '/') || '.css' AS sheet, page_id * 2147483648 + pos AS position FROM refs),
kept AS (SELECT DISTINCT dict_id, lower(ltrim(ref, '/') || '.css') AS res_key FROM refs WHERE pos % 2 = 0)
SELECT dict_id, sheet, position FROM (
  SELECT *, row_number() OVER (PARTITION BY dict_id, lower(sheet) ORDER BY position) AS rn FROM sheets)
WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.dict_id = dict_id AND k.res_key = lower(sheet) AND k.dict_id = sheets_dict(dict_id))""".replace(
        "k.dict_id = dict_id AND k.res_key = lower(sheet) AND k.dict_id = sheets_dict(dict_id)",
        "(k.dict_id, k.res_key) = (t.dict_id, lower(t.sheet))",
    ).replace("FROM sheets)\nWHERE", "FROM sheets) t\nWHERE"),
)
def missing_stylesheets(spark, sf_dir):
    refs = page_refs(spark, sf_dir)
    name = F.concat(F.ltrim("ref", F.lit("/")), F.lit(".css"))
    links = refs.select("dict_id", name.alias("href"), "position")
    kept = refs.filter(F.col("pos") % 2 == 0).select("dict_id", F.lower(name).alias("res_key"))
    return L.missing_stylesheets(links, kept)


@query(
    "j10_raw_semantic_pairing",
    f"""{BASE}, {RESOLVED}, raw AS (SELECT dict_id, key AS matched_key, raw_ord, content FROM numbered)
SELECT a.dict_id, a.key, a.matched_key, a.raw_ord, a.rec_ord, raw.content FROM answers a
JOIN raw USING (dict_id, matched_key, raw_ord)""",
)
def raw_semantic_pairing(spark, sf_dir):
    records = part_records(spark, sf_dir)
    numbered = L.numbered_records(records)
    raw = numbered.select("dict_id", F.col("key").alias("matched_key"), "raw_ord", "content")
    semantic = L.visible_ordinals(_first_records(spark, sf_dir)).select(
        "dict_id", "key", "matched_key", "raw_ord", "rec_ord"
    )
    return L.pair_raw_semantic(raw, semantic).select("dict_id", "key", "matched_key", "raw_ord", "rec_ord", "content")


@query(
    "j11_close_ranges",
    """WITH e AS (SELECT l_orderkey AS dict_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS source_ord,
  floor((sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING)) / 20)::BIGINT AS start_off,
  CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE -1 END AS end_off FROM lineitem)
SELECT dict_id, source_ord::BIGINT AS source_ord, start_off, CASE WHEN end_off <> 0 THEN end_off ELSE coalesce(
  (SELECT min(n.start_off) FROM e n WHERE n.dict_id = e.dict_id AND n.start_off > e.start_off), 0) END::BIGINT AS end_off FROM e""",
)
def close_ranges(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"
    )
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice")
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    entries = lines.select(
        F.col("l_orderkey").alias("dict_id"),
        F.row_number().over(line).cast("bigint").alias("source_ord"),
        F.floor(F.sum("l_quantity").over(upto) / 20).cast("bigint").alias("start_off"),
        F.when(F.col("l_linenumber") % 2 == 0, 0).otherwise(-1).cast("bigint").alias("end_off"),
    )
    return L.close_ranges(entries).select("dict_id", "source_ord", "start_off", "end_off")


@query("j12_alias_preservation", f"{ANSWERED} SELECT query, dict_id, lookup_key, matched_key, redirected_from, rec_ord FROM found")
def alias_preservation(spark, sf_dir):
    return _answers(spark, sf_dir).select(
        "query", "dict_id", "lookup_key", "matched_key", "redirected_from", "rec_ord"
    )


@query(
    "j13_visible_ordinals",
    f"""{BASE}, {RESOLVED} SELECT dict_id, key, rec_ord, content,
first_value(matched_key) OVER (PARTITION BY dict_id, key ORDER BY rec_ord) AS headword FROM answers""",
)
def visible_ordinals(spark, sf_dir):
    answers = L.visible_ordinals(_first_records(spark, sf_dir))
    first = answers.filter(F.col("rec_ord") == 1).select("dict_id", "key", F.col("matched_key").alias("headword"))
    return answers.join(first, ["dict_id", "key"]).select("dict_id", "key", "rec_ord", "content", "headword")


@query(
    "p14_record_ordinal_select",
    f"""{ANSWERED}, w AS (SELECT query, (min(query_id) % 4 + 1)::BIGINT AS ordinal FROM queries GROUP BY query),
sized AS (SELECT query, dict_id, max(rec_ord) AS available FROM found GROUP BY ALL)
SELECT f.query, f.dict_id, w.ordinal, f.content, NULL::BIGINT AS available FROM found f JOIN w USING (query) WHERE f.rec_ord = w.ordinal
UNION ALL SELECT s.query, s.dict_id, w.ordinal, NULL, s.available FROM sized s JOIN w USING (query) WHERE w.ordinal > s.available""",
)
def record_ordinal_select(spark, sf_dir):
    queries = order_queries(spark, sf_dir)
    wanted = queries.groupBy("query").agg((F.min("query_id") % 4 + 1).alias("ordinal"))
    picked, errors = L.pick_ordinal(_answers(spark, sf_dir), wanted)
    none = F.lit(None)
    return picked.select(
        "query", "dict_id", "ordinal", "content", none.cast("bigint").alias("available")
    ).unionByName(errors.select("query", "dict_id", "ordinal", none.cast("string").alias("content"), "available"))


@query(
    "r06_sibling_selectors",
    f"""{ANSWERED} SELECT query, dict_id, rec_ord,
lookup_key || translate(rec_ord::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') AS selector FROM found WHERE rec_ord <> 1""",
)
def sibling_selectors(spark, sf_dir):
    return L.sibling_selectors(_answers(spark, sf_dir))


@query(
    "q08_first_seen_distinct",
    f"""WITH {PAGE_REFS} SELECT dict_id, ref, min(page_id * 2147483648 + pos)::BIGINT AS position FROM refs GROUP BY ALL""",
)
def first_seen(spark, sf_dir):
    return ranking.first_seen(page_refs(spark, sf_dir), ["dict_id"], "ref", "position")
