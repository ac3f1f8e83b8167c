"""Streams over files: step stack with state, idle sessions."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaforge.streaming import navigation as Nav
from tests.conftest import rows


def test_step_stack_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    steps = [(0, "tarn", "mere", False), (5, "mere", "lough", False), (9, "lough", "mere", True), (4000, "x", "y", False), (4001, "y", "x", True)]
    schema = "user_id long, ts timestamp, step_id long, from_page string, to_page string, back boolean"
    df = spark.createDataFrame([(u, t0 + dt.timedelta(seconds=s), i, a, b, k) for u in (1, 2) for i, (s, a, b, k) in enumerate(steps)], schema)
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = Nav.drain(Nav.stack_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    names = ("user_id", "step_id", "length", "previous")
    assert rows(got, *names) == rows(Nav.stack_batch(df), *names)


def test_sessions_close_after_the_watermark(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    data = [(1, t0), (1, t0 + dt.timedelta(minutes=10)), (1, t0 + dt.timedelta(hours=2)), (2, t0 + dt.timedelta(hours=9))]
    df = spark.createDataFrame(data, T.StructType([T.StructField("user_id", T.LongType()), T.StructField("ts", T.TimestampNTZType())]))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = Nav.drain(Nav.session_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(got, "user_id", "events") == [(1, 1), (1, 2)]


def test_runs_of_steps_sum_up(spark):
    """A run summed up and applied to any path gives what its steps give one after another."""
    rng = random.Random(7)
    pages = ["tarn", "Mere", "mere ", "beck", "ghyll"]

    def walk(path, steps):
        for step in steps:
            path = Nav.take_step(path, *step)
        return path

    def steps_from(path, count):
        out = []
        for _ in range(count):
            end = path[-1] if path and rng.random() < 0.8 else rng.choice(pages)
            back = rng.random() < 0.4
            target = path[-2] if back and len(path) > 1 and rng.random() < 0.8 else rng.choice(pages)
            out.append((end, target, back))
            path = Nav.take_step(path, *out[-1])
        return out

    for _ in range(600):
        path = walk([], steps_from([], rng.choice([0, 1, 3, 20, 130])))
        steps = steps_from(path, rng.choice([0, 1, 2, 5, 30, 80]))
        run = Nav.Stretch()
        for step in steps:
            run.step(*step)
        for start in (path, path[:-1], [], path[1:], ["beck", *path][-Nav.DEPTH :], ["mere"]):
            assert [p.strip().lower() for p in run.apply(list(start))] == [p.strip().lower() for p in walk(list(start), steps)]


def test_endless_sessions_are_walked_in_stretches(spark):
    rng = random.Random(3)
    rows, path, want = [], [], []
    for i in range(400):
        back = rng.random() < 0.3
        source = path[-1] if path else "p0"
        target = path[-2] if back and len(path) > 1 else f"p{rng.randint(0, 6)}"
        rows.append((1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * i), i, source, target, back))
        path = Nav.take_step(path, source, target, back)
        want.append((i, len(path), path[-2] if len(path) > 1 else None))
    steps = spark.createDataFrame(rows, "user_id long, ts timestamp, step_id long, from_page string, to_page string, back boolean")
    got = Nav.stack_batch(steps.repartition(5))
    assert sorted((r.step_id, r.length, r.previous) for r in got.collect()) == want


def test_a_table_of_several_files_is_streamed_whole(spark, tmp_path):
    table = spark.range(30).withColumn("v", F.col("id") * 2)
    table.repartition(3).write.parquet(f"{tmp_path}/in/t.parquet")
    table.repartition(2).write.parquet(f"{tmp_path}/in/other.parquet")
    source = Nav.read_stream(spark, f"{tmp_path}/in", "t.parquet", table.schema)
    got = Nav.drain(source, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert rows(got, "id", "v") == rows(table, "id", "v")
