"""Navigation paths: batch windows, session windows on streams, and the step stack."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lemmaforge.functions.keys import fold_key
from lemmaforge.operators import ranking
from lemmaforge.session import cut_lineage

IDLE_SECONDS = 30 * 60
ARRIVAL_SECONDS = 30
DEPTH = 50
STRETCH_SECONDS = 6 * 3600


def seconds(ts: Column | str) -> Column:
    """Time as a number of seconds, exact to the microsecond."""
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts) / 1e6


def stretch_of(ts: str = "ts") -> Column:
    return F.floor(F.unix_micros(ts) / (STRETCH_SECONDS * 1_000_000))


def steps_of(events: DataFrame) -> DataFrame:
    """Steps between consecutive events of a user.

    `events` has user_id, ts, step_id (unique, breaking ties of ts) and page.
    """
    placed = events.withColumn("_at", F.struct("ts", "step_id"))
    before = ranking.with_previous(placed, ["user_id"], "_at", ["page"], stretch_of())
    return before.filter(F.col("prev").isNotNull()).select(
        "user_id", "ts", "step_id", F.col("prev.page").alias("from_page"), F.col("page").alias("to_page")
    )


def paths(steps: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """Path number, place in the path (at most 50 pages are kept), start of path.

    A path starts over after an idle time or where a step does not begin at
    the page the path ends with; a step to the same page adds nothing. A busy
    user is worked on one stretch of time after another.
    """
    placed = steps.withColumn("_at", F.struct("ts", "step_id"))
    before = ranking.with_previous(placed, ["user_id"], "_at", ["ts", "to_page"], stretch_of())
    same = lambda a, b: fold_key(a) == fold_key(b)
    fresh = (
        F.col("prev").isNull()
        | (seconds("ts") - seconds(F.col("prev.ts")) > idle)
        | ~same(F.col("prev.to_page"), F.col("from_page"))
    )
    moved = (~same(F.col("to_page"), F.col("from_page"))).cast("int")
    marked = before.withColumn("fresh", fresh.cast("int")).withColumn("moved", moved)
    numbered = ranking.running_position(
        marked,
        ["user_id"],
        "_at",
        name="_n",
        sums={"_before": F.col("fresh"), "_moves": F.col("moved")},
        stretch=stretch_of(),
    )
    base = numbered.withColumn("path", F.col("_before") + F.col("fresh"))
    starts = base.filter(F.col("fresh") == 1).select("user_id", "path", F.col("_moves").alias("_start"))
    length = F.col("_moves") + F.col("moved") - F.col("_start") + 1
    return base.join(starts, ["user_id", "path"]).select(
        "user_id",
        "ts",
        "step_id",
        "from_page",
        "to_page",
        "path",
        F.least(length, F.lit(DEPTH)).cast("bigint").alias("length"),
    )


def previous_pages(steps: DataFrame, lookups: DataFrame, idle: int = IDLE_SECONDS, arrival: int = ARRIVAL_SECONDS) -> DataFrame:
    """Page to go back to for each lookup (user_id, ts, look_id, page).

    Offered while the lookup follows the step that opened its page within
    the arrival time, and something came before it on the path.
    """
    walked = paths(steps, idle)
    inside = Window.partitionBy("user_id", "path").orderBy("ts", "step_id")
    second = F.last(F.when(fold_key("from_page") != fold_key("to_page"), F.col("from_page")), ignorenulls=True)
    ends = walked.withColumn("before", second.over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    both = ends.select(
        "user_id", "ts", F.lit(0).alias("_kind"), F.col("step_id").alias("_id"),
        F.struct("ts", "to_page", "before").alias("step"), F.lit(None).cast("string").alias("page"),
    ).unionByName(
        lookups.select(
            "user_id", "ts", F.lit(1).alias("_kind"), F.col("look_id").alias("_id"),
            F.lit(None).cast(T.StructType([
                T.StructField("ts", lookups.schema["ts"].dataType),
                T.StructField("to_page", T.StringType()),
                T.StructField("before", T.StringType()),
            ])).alias("step"),
            "page",
        )
    )
    # the latest step counts only within the arrival time, so a stretch of time and the one before suffice
    width = max(arrival, 1)
    cut = both.withColumn("_slot", F.floor(seconds("ts") / width)).withColumn(
        "_slots", F.when(F.col("_kind") == 0, F.array(F.col("_slot"), F.col("_slot") + 1)).otherwise(F.array(F.col("_slot")))
    )
    slotted = cut.withColumn("_s", F.explode("_slots"))
    asof = Window.partitionBy("user_id", "_s").orderBy("ts", "_kind", "_id").rowsBetween(Window.unboundedPreceding, 0)
    found = slotted.withColumn("step", F.last("step", ignorenulls=True).over(asof)).filter(F.col("_kind") == 1)
    near = seconds("ts") - seconds(F.col("step.ts")) <= arrival
    good = near & (fold_key(F.col("step.to_page")) == fold_key("page"))
    return found.select(
        "user_id", "ts", F.col("_id").alias("look_id"), "page", F.when(good, F.col("step.before")).alias("previous")
    )


def same_page(a: str, b: str) -> bool:
    return a.strip().lower() == b.strip().lower()


def take_step(path: list[str], source: str, target: str, back: bool) -> list[str]:
    """The path after one step; a step back pops or starts over."""
    if back:
        if len(path) >= 2 and same_page(path[-2], target):
            return path[:-1]
        return [target]
    if not path or not same_page(path[-1], source):
        path = [source]
    if not same_page(path[-1], target):
        path = [*path, target]
    return path[-DEPTH:]


STACK = "user_id long, ts timestamp, step_id long, length int, previous string"


class Stretch:
    """What a run of steps does to a path it does not know yet.

    Going on, steps only look at the pages the path ends with. So the run either leaves all but `pops` of the unknown path
    and puts `pushed` behind, or it meets a page it did not expect: then it starts over, and what follows is known. Each
    `check` is a page looked for at a place from the end, with the height reached until then and the path that results
    if it is not there. Runs are applied one after another, so a run of runs is one again.
    """

    def __init__(self) -> None:
        self.pops, self.pushed, self.peak = 0, [], 0
        self.checks: list[tuple[int, str, int, list[str]]] = []
        self.known: list[str] | None = None  # once the run has started over for certain

    def step(self, source: str, target: str, back: bool) -> None:
        for _, _, _, path in self.checks:
            path[:] = take_step(path, source, target, back)
        if self.known is not None:
            self.known = take_step(self.known, source, target, back)
            return
        if back:
            if len(self.pushed) >= 2:
                if same_page(self.pushed[-2], target):
                    self.pushed.pop()
                else:
                    self.known = [target]
                return
            # the page before the last one lies in the unknown path
            self._expect(target, 2 - len(self.pushed), [target])
            if self.pushed:
                self.pushed.pop()
            else:
                self.pops += 1
            return
        if self.pushed:
            if not same_page(self.pushed[-1], source):
                self.known = take_step([], source, target, False)
                return
        else:
            self._expect(source, 1, take_step([], source, target, False))
        if not same_page(self.pushed[-1] if self.pushed else source, target):
            self.pushed.append(target)
            self.peak = max(self.peak, len(self.pushed) - self.pops)
            if len(self.pushed) >= DEPTH:
                self.known = self.pushed[-DEPTH:]  # nothing of the unknown path is left

    def _expect(self, page: str, place: int, otherwise: list[str]) -> None:
        """`page` stands at this place from the end of what is left of the unknown path."""
        self.checks.append((self.pops + place, page, self.peak, list(otherwise)))

    def apply(self, path: list[str]) -> list[str]:
        """The path after the run, from the one before it."""
        for place, page, peak, otherwise in self.checks:
            lost = max(0, len(path) + peak - DEPTH)
            if len(path) - place < lost or not same_page(path[len(path) - place], page):
                return otherwise
        if self.known is not None:
            return self.known
        lost = max(0, len(path) + self.peak - DEPTH)
        return (path[lost : len(path) - self.pops] + self.pushed)[-DEPTH:]


def stack_batch(steps: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """N3 on stored steps (with `back`).

    A session is cut into stretches of time, and the steps of a stretch are read by one task, in order, batch by batch.
    First each stretch is summed up in one row; the rows of a session, applied one after another, give the path before
    each stretch; then the stretches are walked from there. So an endless session spreads over the tasks.
    """
    placed = steps.withColumn("_at", F.struct("ts", "step_id"))
    before = ranking.with_previous(placed, ["user_id"], "_at", ["ts"], stretch_of())
    fresh = F.col("prev").isNull() | (seconds("ts") - seconds(F.col("prev.ts")) > idle)
    sessions = ranking.running_position(
        before.withColumn("fresh", fresh.cast("int")).drop("prev"),
        ["user_id"], "_at", name="_n", sums={"_s": F.col("fresh")}, stretch=stretch_of(),
    ).withColumn("session", F.col("_s") + F.col("fresh"))
    keys = ["user_id", "session", "stretch"]
    sessions = cut_lineage(sessions.withColumn("stretch", stretch_of()).select(*keys, "ts", "step_id", "from_page", "to_page", "back"))
    ordered = sessions.repartition(*keys).sortWithinPartitions(*keys, "ts", "step_id")

    def sum_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, run = None, Stretch()
        for batch in batches:
            done = []
            for *key, source, target, back in zip(*(batch[c] for c in (*keys, "from_page", "to_page", "back"))):
                if key != at:
                    if at is not None:
                        done.append((*at, pickle.dumps(run)))
                    at, run = key, Stretch()
                run.step(source, target, bool(back))
            yield pd.DataFrame(done, columns=[*keys, "run"])
        if at is not None:
            yield pd.DataFrame([(*at, pickle.dumps(run))], columns=[*keys, "run"])

    runs = ordered.mapInPandas(sum_up, "user_id long, session long, stretch long, run binary")

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, path = None, []
        for batch in batches:
            found = []
            for user, session, run in zip(batch.user_id, batch.session, batch.run):
                if (user, session) != at:
                    at, path = (user, session), []
                found.append(path)
                path = pickle.loads(run).apply(path)
            yield batch[keys].assign(start=found)

    begun = runs.repartition("user_id", "session").sortWithinPartitions(*keys)
    begun = begun.mapInPandas(starts, "user_id long, session long, stretch long, start array<string>")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, path = None, []
        for batch in batches:
            lengths, previous = [], []
            for *key, source, target, back, start in zip(*(batch[c] for c in (*keys, "from_page", "to_page", "back", "start"))):
                if key != at:
                    at, path = key, list(start)
                path = take_step(path, source, target, bool(back))
                lengths.append(len(path))
                previous.append(path[-2] if len(path) > 1 else None)
            yield batch[["user_id", "ts", "step_id"]].assign(length=lengths, previous=previous)

    walked = sessions.join(begun, keys).repartition(*keys).sortWithinPartitions(*keys, "ts", "step_id")
    return walked.mapInPandas(walk, STACK)


class StepStack(StatefulProcessor):
    """The stack of one user; dropped when the user has been idle."""

    def __init__(self, idle: int = IDLE_SECONDS) -> None:
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.path = handle.getValueState("path", "pages array<string>, updated timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pages: list[str] = []
        updated = None
        if self.path.exists():
            stored = self.path.get()
            pages, updated = list(stored[0]), pd.Timestamp(stored[1])
        out = []
        # the rows of one user in one batch come in any order
        columns = ("ts", "step_id", "from_page", "to_page", "back")
        for ts, step_id, source, target, back in sorted(r for frame in rows for r in zip(*(frame[c] for c in columns))):
            now = pd.Timestamp(ts)
            if updated is not None and (now - updated).total_seconds() > self.idle:
                pages = []
            pages = take_step(pages, source, target, bool(back))
            updated = now
            out.append((key[0], ts, step_id, len(pages), pages[-2] if len(pages) > 1 else None))
        self.path.update((pages, updated.to_pydatetime()))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(updated.timestamp() * 1000) + self.idle * 1000)
        yield pd.DataFrame(out, columns=["user_id", "ts", "step_id", "length", "previous"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.path.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        yield pd.DataFrame({"user_id": [], "ts": [], "step_id": [], "length": [], "previous": []})

    def close(self) -> None:
        pass


STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}


def stack_stream(steps: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """N3 on a stream of steps (user_id, ts, step_id, from_page, to_page, back)."""
    spark = steps.sparkSession
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    return (
        steps.withWatermark("ts", f"{idle} seconds")
        .groupBy("user_id")
        .transformWithStateInPandas(
            statefulProcessor=StepStack(idle), outputStructType=STACK, outputMode="Append", timeMode="EventTime"
        )
    )


def session_stream(events: DataFrame, idle: int = IDLE_SECONDS) -> DataFrame:
    """Idle-parted sessions of a stream with event-time watermark."""
    gap = f"{idle} seconds"
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", gap)
        .groupBy("user_id", F.session_window("ts", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")
    )


def read_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """File stream over one table of a folder, a file or a folder of files; new files are taken as they arrive."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return spark.readStream.schema(schema).parquet(f"{folder}/{name}")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def drain(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now, into Parquet, and read it back."""
    job = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    job.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def revalidate_stream(records: DataFrame, baseline: DataFrame, validate, compare, out: str, checkpoint: str):
    """Every batch of new records is measured and compared with the baseline."""

    def each(batch: DataFrame, number: int) -> None:
        compare(baseline, validate(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        records.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
