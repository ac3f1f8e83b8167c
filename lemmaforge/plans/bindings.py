"""The abstract tables, derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.plans.registry import table


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1: brands as dictionaries, part names as keys, some records redirects."""
    part = table(spark, sf_dir, "part")
    total = part.count()  # answered from the file footers
    target = part.select(F.col("p_partkey").alias("_t"), F.col("p_name").alias("_target"))
    return part.join(target, (F.col("p_partkey") * 31 + 7) % F.lit(total) == F.col("_t")).select(
        F.col("p_brand").alias("dict_id"),
        F.when(F.col("p_partkey") % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("key"),
        F.col("p_partkey").alias("source_ord"),
        F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("@@@LINK="), F.col("_target")))
        .otherwise(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")))
        .alias("content"),
    )


PART_RECORDS = """records AS (
  SELECT p.p_brand AS dict_id,
         CASE WHEN p.p_partkey % 5 = 0 THEN upper(p.p_name) ELSE p.p_name END AS key,
         p.p_partkey AS source_ord,
         CASE WHEN p.p_size % 7 = 0 THEN '@@@LINK=' || t.p_name
              ELSE p.p_type || ' ' || p.p_size END AS content
  FROM part p JOIN part t ON t.p_partkey = (p.p_partkey * 31 + 7) % (SELECT count(*) FROM part)
)"""


def order_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: one query text per order; case, padding and cut vary."""
    part = table(spark, sf_dir, "part")
    total = part.count()
    name = F.col("p_name")
    kind = F.col("o_orderkey") % 8
    text = (
        F.when(kind.isin(0, 4), name)
        .when(kind.isin(1, 5), F.upper(name))
        .when(kind.isin(2, 6), F.concat(F.upper(F.left(name, F.lit(1))), F.substr(name, F.lit(2))))
        .when(kind == 3, F.concat(F.lit("  "), name, F.lit(" ")))
        .otherwise(F.upper(F.left(name, F.lit(4))))
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % F.lit(total)).alias("_p"))
    return orders.join(part.select(F.col("p_partkey").alias("_p"), "p_name"), "_p").select(
        F.col("o_orderkey").alias("query_id"), text.alias("query")
    )


ORDER_QUERIES = """queries AS (
  SELECT o.o_orderkey AS query_id,
         CASE WHEN o.o_orderkey % 8 IN (0, 4) THEN p.p_name
              WHEN o.o_orderkey % 8 IN (1, 5) THEN upper(p.p_name)
              WHEN o.o_orderkey % 8 IN (2, 6) THEN upper(p.p_name[1:1]) || p.p_name[2:]
              WHEN o.o_orderkey % 8 = 3 THEN '  ' || p.p_name || ' '
              ELSE upper(p.p_name[1:4]) END AS query
  FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)
)"""


def brand_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as the list of dictionaries, in order of lower-case name."""
    part = table(spark, sf_dir, "part")
    brands = part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("entry_count"))
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("bigint")
    return brands.select(
        F.col("p_brand").alias("dict_id"),
        number.alias("dict_ord"),
        F.concat(F.lit("Parts of "), "p_brand").alias("title"),
        "entry_count",
        F.when(number % 6 == 0, "unavailable").otherwise("ok").alias("health"),
    )


BRAND_DICTIONARIES = r"""dictionaries AS (
  SELECT p_brand AS dict_id, regexp_extract(p_brand, '(\d+)$', 1)::BIGINT AS dict_ord,
         'Parts of ' || p_brand AS title, count(*) AS entry_count,
         CASE WHEN regexp_extract(p_brand, '(\d+)$', 1)::BIGINT % 6 = 0 THEN 'unavailable' ELSE 'ok' END AS health
  FROM part GROUP BY p_brand
)"""


def page_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link values of the pages, in order, per host."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("dict_id"),
        "page_id",
        F.posexplode(F.expr("regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)")).alias("pos", "ref"),
    ).withColumn("position", F.shiftleft("page_id", 31) + F.col("pos"))


PAGE_REFS = r"""refs AS (
  SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS dict_id, page_id,
         unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref,
         generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos
  FROM pages
)"""


def page_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link words of every third page as stored resources of the page's host."""
    refs = page_refs(spark, sf_dir)
    return refs.select(
        "dict_id",
        F.concat(F.lit("Words\\"), F.regexp_replace("ref", "^/", "")).alias("stored"),
        (F.col("page_id") % 3).alias("volume"),
    ).distinct()
