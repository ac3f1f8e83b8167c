"""One query per operator, over the whole of its table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.llm import bpe, centroids, collocations, context_tree, decontaminate, jaccard, near_vectors, private, quality, templates, toxicity, urls, warc
from lemmaforge.plans.registry import Query, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_template_removal")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = templates.extract_articles(table(spark, sf_dir, "pages"))
    return articles.withColumn("n_chars", F.length("text").cast("bigint"))


def tokenizer_path() -> str:
    """The vocabulary of the public tokenizers package, found on the driver."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op5_bpe_round_trip")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_report(table(spark, sf_dir, "documents"), tokenizer_path())


OP6 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), n AS (
  SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS newest,
    list_transform(range(8), lambda g: ('0x' || substr(hex, 5 * g + 1, 5))::INTEGER) AS five
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((five[i // 4 + 1] >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> newest THEN newest END AS refers_to
FROM n
"""


@query("op6_warc_index", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.archive_pages(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP4 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), smallest AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a, count(*) AS n FROM link GROUP BY a
)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN smallest s ON s.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


@query("op4_near_vectors", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"))


OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4))) END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, md5(unnest(s)::VARCHAR) AS x FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.b) AS component_id FROM s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""


@query("op8_jaccard_join", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_documents(table(spark, sf_dir, "documents"))


@query("op2_url_filter")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


@query("op9_private_data")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.private_report(table(spark, sf_dir, "documents"))


@query("op12_context_tree")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_texts(table(spark, sf_dir, "documents"))


OP11 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d
), w AS (
  SELECT lang, list_filter(string_split_regex(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p
), g AS (
  SELECT lang, unnest(flatten(list_transform([1, 2, 3, 4, 5],
    lambda k: list_transform(range(1, len(w) - k + 2), lambda i: list_slice(w, i, i + k - 1))))) AS g
  FROM w
), total AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, g, count(*) AS f FROM g GROUP BY lang, g HAVING count(*) >= 100
), part AS (
  SELECT lang, f, unnest(flatten(list_transform(range(2, len(g)),
    lambda k: list_transform(range(1, len(g) - k + 2), lambda i: list_slice(g, i, i + k - 1))))) AS g
  FROM f WHERE len(g) > 2
), most AS (
  SELECT lang, g, max(f) AS most FROM part GROUP BY lang, g
), kept AS (
  SELECT f.lang, f.g, f.f AS a FROM f LEFT JOIN most m ON m.lang = f.lang AND m.g = f.g
  WHERE len(f.g) > 1 AND (m.most IS NULL OR 100 * m.most < 100 * f.f)
), cut AS (
  SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM kept
), scored AS (
  SELECT c.lang, c.g, c.a, c.k, l.f AS l, r.f AS r, t.n, ((1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cut c JOIN total t ON t.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, c.k)
  JOIN f r ON r.lang = c.lang AND r.g = list_slice(c.g, c.k + 1, len(c.g))
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank,
  array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


@query("op11_collocations", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def _rounds(rounds: int) -> str:
    """Assignments and new centroids in turn, each a step of its own."""
    nearest = """a{i} AS MATERIALIZED (
  SELECT vec_id, e, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT v.vec_id, v.e, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
    FROM v, c{i} c) GROUP BY vec_id, e
)"""
    moved = """s{i} AS (
  SELECT k, place, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(e) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY k, place
), m{i} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY place) AS e FROM s{i} GROUP BY k
), c{next} AS MATERIALIZED (
  SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k
)"""
    steps = [f"{nearest},\n{moved}".format(i=i, next=i + 1) for i in range(rounds)]
    return ",\n".join([*steps, nearest.format(i=rounds)])


OP13 = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k, e FROM v ORDER BY k LIMIT 8
), {_rounds(centroids.ROUNDS)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} JOIN c{centroids.ROUNDS} c USING (k)
"""


@query("op13_centroid_clustering", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
