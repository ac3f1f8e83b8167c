"""Fingerprints, sinks and gain over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lemmaforge.functions import text as T
from lemmaforge.operators import diagnose as D
from lemmaforge.operators import metrics as M
from lemmaforge.operators import review as R
from lemmaforge.plans.page_queries import PAGE_ENTRIES, _page_entries
from lemmaforge.plans.registry import query, table
from lemmaforge.plans.validate_queries import AFTER, SCORED, _scored, checked
from lemmaforge.session import cut_lineage, work_folder
from lemmaforge.sources import corpus as C


@query(
    "s01_corpus_listing",
    """WITH f AS (SELECT c_custkey, '/corpus/' || CASE c_custkey % 7 WHEN 0 THEN '.cache/' ELSE '' END || c_mktsegment || '/' || CASE c_custkey % 5 WHEN 0 THEN '._' ELSE '' END
  || c_name || CASE c_custkey % 4 WHEN 0 THEN '.mdx' WHEN 1 THEN '.MDD' WHEN 2 THEN '.1.mdd' ELSE '.txt' END AS path FROM customer)
SELECT path, lower(regexp_extract(path, '(\\.[^.]*)$', 1)) AS ext FROM f WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 4 <> 3""".replace("\\\\", "\\"),
)
def corpus_listing(spark, sf_dir):
    return C.named_files(_paths(spark, sf_dir), "/corpus").select("path", "ext")


def _paths(spark, sf_dir):
    key = F.col("c_custkey")
    kind = key % 4
    return table(spark, sf_dir, "customer").select(
        F.concat(
            F.lit("/corpus/"),
            F.when(key % 7 == 0, ".cache/").otherwise(""),
            "c_mktsegment",
            F.lit("/"),
            F.when(key % 5 == 0, "._").otherwise(""),
            "c_name",
            F.when(kind == 0, ".mdx").when(kind == 1, ".MDD").when(kind == 2, ".1.mdd").otherwise(".txt"),
        ).alias("path"),
        F.lit(1).cast("bigint").alias("length"),
    )


@query(
    "s02_volume_pairing",
    """WITH m AS (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY ALL),
v AS (SELECT c_nationkey, c_mktsegment, c_custkey AS number FROM customer)
SELECT '/c/' || m.c_nationkey || '/' || m.c_mktsegment || '.mdx' AS path, count(*) AS volumes,
  string_agg('/c/' || m.c_nationkey || '/' || lower(m.c_mktsegment) || '.' || number || '.mdd', ',' ORDER BY number) AS listed
FROM m JOIN v USING (c_nationkey, c_mktsegment) GROUP BY ALL""",
)
def volume_pairing(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    folder = F.concat(F.lit("/c/"), F.col("c_nationkey").cast("string"), F.lit("/"))
    mains = customer.select(F.concat(folder, "c_mktsegment", F.lit(".mdx")).alias("path")).distinct()
    volumes = customer.select(
        F.concat(folder, F.lower("c_mktsegment"), F.lit("."), F.col("c_custkey").cast("string"), F.lit(".mdd")).alias("path")
    )
    files = mains.unionByName(volumes).withColumn("length", F.lit(1).cast("bigint"))
    paired = C.pair_volumes(C.named_files(files, "/c"))
    return paired.select("path", F.size("volumes").cast("bigint").alias("volumes"), F.array_join("volumes", ",").alias("listed"))


@query(
    "s03_fingerprint",
    r"""WITH b AS (SELECT page_id, hex(encode(html)) AS h, strlen(html) AS n FROM pages),
o AS (SELECT page_id, h, n, list_distinct([0, n // 3, n * 2 // 3, greatest(n - 65536, 0)]) AS offs FROM b),
p AS (SELECT page_id, n, h, unnest(list_sort(offs)) AS o FROM o)
SELECT page_id, sha256(unhex(hex(encode('corpus-id-v1' || chr(0))) || lpad(hex(any_value(n)), 16, '0') || string_agg(
  lpad(CASE WHEN o = 0 THEN '0' ELSE hex(o) END, 16, '0') || substr(h, o * 2 + 1, 131072), '' ORDER BY CASE WHEN o = 0 THEN 0 WHEN o = n // 3 THEN 1 WHEN o = n * 2 // 3 THEN 2 ELSE 3 END)))[1:16] AS fingerprint
FROM p GROUP BY page_id""",
)
def fingerprints(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.fingerprint(F.encode("html", "UTF-8")).alias("fingerprint"))


@query(
    "s07_baseline_round_trip",
    f"{AFTER} SELECT source AS dict_id, doc_id::VARCHAR AS key, retention, array_to_string(signals, ',') AS signals FROM snap_a",
)
def baseline_round_trip(spark, sf_dir):
    path = f"{work_folder(spark)}/s07-{uuid.uuid4().hex}"
    C.write_baseline(M.snapshots(checked(spark, sf_dir)), path)
    return C.read_baseline(spark, path).select("dict_id", "key", "retention", F.array_join("signals", ",").alias("signals"))


@query(
    "s08_review_set",
    f"{SCORED.replace('SIZE', '30')} SELECT dict_id, lpad(position::VARCHAR, 3, '0') || '-' || key AS name, score FROM queue",
)
def review_set(spark, sf_dir):
    path = f"{work_folder(spark)}/s08-{uuid.uuid4().hex}"
    scored = cut_lineage(_scored(spark, sf_dir))
    queue = R.capped_queue(scored, 30)
    index = scored.groupBy("tier").agg(F.count(F.lit(1)).alias("records"))
    C.write_review(index, M.dictionary_summary(scored), queue.select("dict_id", "key", "position", "score", "reasons"), path)
    return spark.read.json(f"{path}/queue").select("dict_id", "name", "score")


@query(
    "s09_diagnostics_rows",
    f"""WITH {PAGE_ENTRIES} SELECT dict_id, '| ' || concat_ws(' | ', dict_id, samples::VARCHAR, floor(structured_rate * 100 + 0.5)::BIGINT || '%', median_senses::VARCHAR) || ' |' AS line FROM cov""",
)
def diagnostics_rows(spark, sf_dir):
    covered = D.coverage(_page_entries(spark, sf_dir))
    return C.diagnostics_rows(covered, covered.select("dict_id", F.col("dict_id").alias("title"))).select("dict_id", "line")


@query(
    "s10_rebuild",
    """SELECT source AS dict_id, count(*) AS records, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source""",
)
def rebuild(spark, sf_dir):
    path = f"{work_folder(spark)}/s10-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    totals = docs.groupBy(F.col("source").alias("dict_id")).agg(
        F.count(F.lit(1)).alias("records"), F.sum("n_chars").alias("chars")
    )
    C.rebuild({"totals": totals}, path)
    C.rebuild({"totals": totals}, path)
    return spark.read.parquet(f"{path}/totals")


@query(
    "f01_loudness_gain",
    """WITH m AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE -value / 3 END AS loud, CASE WHEN event_id % 7 = 0 THEN NULL ELSE -value / 4 END AS peak FROM events),
d AS (SELECT event_id, peak, CASE WHEN loud IS NULL THEN 0 ELSE greatest(-20.0, least(20.0, -16.0 - loud)) END + 20 * log10(0.5) AS db FROM m)
SELECT event_id, round(power(10, CASE WHEN peak IS NULL THEN db ELSE least(db, -1.0 - peak) END / 20), 9) AS gain FROM d""",
)
def loudness_gain(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 5 != 0, -F.col("value") / 3).alias("loud"),
        F.when(F.col("event_id") % 7 != 0, -F.col("value") / 4).alias("peak"),
    )
    return events.select("event_id", F.round(C.loudness_gain("loud", "peak", 50), 9).alias("gain"))


@query(
    "f02_slug",
    r"""SELECT doc_id, CASE WHEN rtrim(ltrim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', '-', 'g'), '-')[1:32], '-') = '' THEN 'entry'
ELSE rtrim(ltrim(regexp_replace(lower(text), '[^\p{L}\p{Nd}]+', '-', 'g'), '-')[1:32], '-') END AS slug FROM documents""",
)
def slug(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.slug("text").alias("slug"))
