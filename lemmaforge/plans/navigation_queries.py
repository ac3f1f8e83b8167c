"""Navigation queries over events: the event type is the page of a user's step."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lemmaforge.operators import metrics as M
from lemmaforge.plans.registry import query, table
from lemmaforge.plans.validate_queries import COMPARED, _rejected, checked, with_fields
from lemmaforge.session import cut_lineage, work_folder
from lemmaforge.streaming import navigation as N

GAP = 8 * 3600


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("step_id"),
        F.col("event_type").alias("page"),
    )


STEPS = """e AS (SELECT user_id, ts, event_id AS step_id, event_type AS page FROM events),
st AS (SELECT *, lag(page) OVER w AS from_page, lag(ts) OVER w AS pts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, step_id)),
steps AS (SELECT user_id, ts, step_id, from_page, page AS to_page, lag(ts) OVER w AS step_before FROM st WHERE from_page IS NOT NULL
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, step_id)),
fl AS (SELECT *, CASE WHEN step_before IS NULL OR epoch_us(ts) - epoch_us(step_before) > 28800000000 THEN 1 ELSE 0 END AS fresh FROM steps),
pa AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, step_id) AS path FROM fl),
walked AS (SELECT *, least(1 + sum((from_page <> to_page)::INT) OVER (PARTITION BY user_id, path ORDER BY ts, step_id), 50) AS length FROM pa)"""


@query(
    "n01_navigation_paths",
    f"WITH {STEPS} SELECT user_id, step_id, from_page, to_page, path::BIGINT AS path, length::BIGINT AS length FROM walked",
)
def navigation_paths(spark, sf_dir):
    return N.paths(N.steps_of(events(spark, sf_dir)), GAP).select(
        "user_id", "step_id", "from_page", "to_page", "path", "length"
    )


@query(
    "n02_previous_page",
    f"""WITH {STEPS}, b AS (SELECT *, last_value(CASE WHEN from_page <> to_page THEN from_page END IGNORE NULLS) OVER (PARTITION BY user_id, path ORDER BY ts, step_id) AS before FROM walked)
SELECT e.user_id, e.step_id AS look_id, e.page, CASE WHEN epoch_us(e.ts) + 600000000 - epoch_us(s.ts) <= 28800000000 AND s.to_page = e.page THEN s.before END AS previous
FROM e ASOF LEFT JOIN b s ON e.user_id = s.user_id AND e.ts + INTERVAL 10 MINUTE >= s.ts""",
)
def previous_page(spark, sf_dir):
    """Every event's page is looked up ten minutes later."""
    base = events(spark, sf_dir)
    later = base.select(
        "user_id", (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"), F.col("step_id").alias("look_id"), "page"
    )
    return N.previous_pages(N.steps_of(base), later, GAP, GAP).select("user_id", "look_id", "page", "previous")


def _back_steps(spark, sf_dir):
    """Steps; errors go back to the page before."""
    return N.steps_of(events(spark, sf_dir)).withColumn("back", F.col("to_page") == "error")


@query(
    "n03_back_steps",
    f"""WITH RECURSIVE {STEPS},
s AS (SELECT user_id, step_id, from_page, to_page, fresh, row_number() OVER (PARTITION BY user_id ORDER BY ts, step_id) AS n FROM fl),
w AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, 0::BIGINT AS step_id, []::VARCHAR[] AS path FROM s
  UNION ALL
  SELECT user_id, n, step_id, CASE WHEN to_page = 'error' THEN CASE WHEN len(p) >= 2 AND p[-2] = to_page THEN p[:len(p) - 1] ELSE [to_page] END
    ELSE (CASE WHEN q[-1] = to_page THEN q ELSE list_append(q, to_page) END)[-50:] END
  FROM (SELECT *, CASE WHEN len(p) = 0 OR p[-1] <> from_page THEN [from_page] ELSE p END AS q
    FROM (SELECT s.user_id, s.n, s.step_id, s.from_page, s.to_page, CASE WHEN s.fresh = 1 THEN []::VARCHAR[] ELSE w.path END AS p
      FROM w JOIN s ON s.user_id = w.user_id AND s.n = w.n + 1))
)
SELECT user_id, step_id, len(path)::INTEGER AS length, CASE WHEN len(path) > 1 THEN path[-2] END AS previous FROM w WHERE n > 0""",
)
def back_steps(spark, sf_dir):
    return N.stack_batch(_back_steps(spark, sf_dir), GAP).select("user_id", "step_id", "length", "previous")


@query(
    "n04_session_stream",
    """WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 28800000000 THEN 1 ELSE 0 END AS fresh
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM f),
g AS (SELECT user_id, min(ts) AS started, max(ts) AS last_ts, count(*) AS events FROM s GROUP BY user_id, n)
SELECT user_id, epoch_us(started) AS started_us, events FROM g
WHERE epoch_us(last_ts) + 28800000000 <= (SELECT epoch_us(max(ts)) FROM events) // 1000 * 1000 - 28800000000""",
)
def session_stream(spark, sf_dir):
    source = N.read_stream(spark, sf_dir, "events.parquet", table(spark, sf_dir, "events").schema)
    base = f"{work_folder(spark)}/n04-{uuid.uuid4().hex}"
    out = N.drain(N.session_stream(source.select("user_id", "ts"), GAP), f"{base}/out", f"{base}/checkpoint")
    return out.select("user_id", F.unix_micros("started").alias("started_us"), "events")


@query(
    "n05_incremental_validation",
    f"{COMPARED} SELECT dict_id, key, change, reason FROM compared WHERE change <> 'missing'",
)
def incremental_validation(spark, sf_dir):
    """Documents arrive as a stream; each batch is compared with the earlier run."""
    zero = F.lit(0)
    # written once: every batch is compared with it
    baseline = cut_lineage(M.snapshots(checked(spark, sf_dir, "before")).withColumn("failures", zero))
    source = N.read_stream(spark, sf_dir, "documents.parquet", table(spark, sf_dir, "documents").schema)
    base = f"{work_folder(spark)}/n05-{uuid.uuid4().hex}"

    def validate(batch):
        fields = with_fields(M.placed_by_record(batch, "doc_id"))
        records = fields.select(
            F.col("doc_id").alias("rec_id"),
            F.col("source").alias("dict_id"),
            F.col("doc_id").cast("string").alias("key"),
            F.col("text").alias("source_text"),
            F.concat_ws(" ", "source", "text").alias("record_text"),
            F.array_distinct("fields").alias("fields"),
        )
        kept = records.join(_rejected(spark, sf_dir), "rec_id", "left_anti")
        return M.snapshots(kept).withColumn("failures", zero)

    def compare(before, after):
        # records the batch does not hold are not missing, only not yet seen
        return M.compare_runs(before, after).filter(F.col("change") != "missing")

    N.revalidate_stream(source, baseline, validate, compare, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("dict_id", "key", "change", "reason")
