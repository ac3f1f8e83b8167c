"""Corpus sources and sinks: file listing, volumes, fingerprints, baselines, reports."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaforge.functions import text as Txt
from lemmaforge.functions.keys import col
from lemmaforge.session import cut_lineage

SAMPLE_BYTES = 64 << 10

RECORD = T.StructType(
    [
        T.StructField("dict_id", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("source_ord", T.LongType()),
        T.StructField("content", T.StringType()),
    ]
)
PROFILE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("selectors", T.ArrayType(T.StringType())),
        T.StructField("titles", T.ArrayType(T.StringType())),
        T.StructField("require_title", T.BooleanType()),
        T.StructField("root", T.StringType()),
        T.StructField("ignore", T.ArrayType(T.StringType())),
        T.StructField("fields", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Dictionary and volume files below a folder; file contents are not read.

    Folders and files whose names begin with a dot are left out; subtrees that
    cannot be read are skipped.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("ignoreMissingFiles", "true")
        .option("ignoreCorruptFiles", "true")
        .option("pathGlobFilter", "*.[mM][dD][xXdD]")
        .load(root)
        .select("path", "length")
    )
    return named_files(files, root)


def named_files(files: DataFrame, root: str) -> DataFrame:
    """Parts of the paths of (path, length) rows, hidden ones out."""
    name = F.element_at(F.split("path", "/"), -1)
    # the path may carry a scheme before the root; what follows is kept as it is
    top = F.lit(root.rstrip("/"))
    below = F.substr("path", F.greatest(F.instr("path", root.rstrip("/")) + F.length(top), F.lit(1)))
    return (
        files.withColumn("name", name)
        .filter(~F.startswith("name", F.lit("._")) & ~below.rlike(r"/\.[^/]*/"))
        .withColumn("dir", F.expr("left(path, length(path) - length(name) - 1)"))
        .withColumn("ext", F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1)))
        .withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))
        .filter(F.col("ext").isin(".mdx", ".mdd"))
    )


def volume_stem(name: Column | str) -> tuple[Column, Column]:
    """(base, number) of a volume file name; number 0 without one."""
    stem = F.regexp_replace(col(name), r"\.[^.]*$", "")
    number = F.regexp_extract(stem, r"\.(\d+)$", 1)
    return (
        F.when(number != "", F.regexp_replace(stem, r"\.\d+$", "")).otherwise(stem),
        F.when(number != "", number.try_cast("bigint")).otherwise(0).cast("bigint"),
    )


def pair_volumes(files: DataFrame) -> DataFrame:
    """Main files with their volumes, in order of (number, path)."""
    base, number = volume_stem("name")
    mains = files.filter(F.col("ext") == ".mdx").select("dir", "path", F.lower("stem").alias("_stem"), F.col("stem").alias("title"))
    volumes = files.filter(F.col("ext") == ".mdd").select(
        "dir", F.lower(base).alias("_stem"), F.struct(number.alias("number"), F.col("path").alias("path")).alias("volume")
    )
    grouped = volumes.groupBy("dir", "_stem").agg(F.sort_array(F.collect_list("volume")).alias("_v"))
    return mains.join(grouped, ["dir", "_stem"], "left").select(
        "path", "title", F.coalesce(F.transform("_v", lambda v: v["path"]), F.array().cast("array<string>")).alias("volumes")
    )


def registry_order(mains: DataFrame) -> DataFrame:
    """Dictionaries in order of lower-case path; the list is one row per file."""
    window = Window.orderBy(F.lower("path"))
    return mains.withColumn("dict_ord", F.row_number().over(window).cast("bigint"))


def fingerprint(content: Column | str, salt: str = "corpus-id-v1") -> Column:
    """S3: path-independent hash of size and four slices of a binary content."""
    data = col(content)
    size = F.octet_length(data).cast("bigint")
    third = F.floor(size / 3).cast("bigint")
    offsets = F.array_distinct(
        F.array(F.lit(0).cast("bigint"), third, F.floor(size * 2 / 3).cast("bigint"), F.greatest(size - SAMPLE_BYTES, F.lit(0).cast("bigint")))
    )
    word = lambda n: F.lpad(F.hex(n), 16, "0")
    pieces = F.transform(
        offsets, lambda o: F.concat(word(o), F.hex(F.substring(data, (o + 1).cast("int"), F.lit(SAMPLE_BYTES))))
    )
    whole = F.unhex(F.concat(F.hex(F.concat(F.lit(salt), F.lit("\0"))), word(size), F.array_join(pieces, "")))
    return F.left(F.sha2(whole, 256), F.lit(16))


def read_records(spark: SparkSession, path: str, dict_ids: Sequence[str] | None = None) -> DataFrame:
    """Record table with a fixed schema; a selection of dictionaries prunes the scan."""
    records = spark.read.schema(RECORD).parquet(path)
    return records.filter(F.col("dict_id").isin(list(dict_ids))) if dict_ids else records


def read_record_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good records of JSON line files, and health per file.

    A file with unreadable lines is reported and its good lines are kept; a
    file with no good line is unavailable. The job does not fail.
    """
    schema = T.StructType([*RECORD.fields, T.StructField("_bad", T.StringType())])
    rows = (
        spark.read.schema(schema)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("ignoreCorruptFiles", "true")
        .json(path)
        .withColumn("file", F.input_file_name())
    )
    good = F.col("_bad").isNull() & F.col("key").isNotNull()
    health = rows.groupBy("file").agg(F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))
    health = health.withColumn(
        "health", F.when(F.col("good") > 0, "ok").otherwise("unavailable")
    ).withColumn("diagnostic", F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" unreadable records"))))
    return rows.filter(good).drop("_bad"), health


def write_baseline(snapshots: DataFrame, path: str) -> None:
    """Snapshots sorted by identity, across files as well.

    They are worked out once and written before: finding the ranges reads them a second time.
    """
    cut_lineage(snapshots).repartitionByRange("dict_id", "key").sortWithinPartitions("dict_id", "key").write.mode(
        "overwrite"
    ).parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """The run before, or None on a first run."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.parquet(path)


def write_review(index: DataFrame, dictionaries: DataFrame, queue: DataFrame, path: str) -> None:
    """Index, dictionary rows and queued records, each replaced as a whole."""
    index.write.mode("overwrite").json(os.path.join(path, "index"))
    dictionaries.write.mode("overwrite").partitionBy("dict_id").json(os.path.join(path, "dictionaries"))
    named = queue.withColumn(
        "name", F.concat(F.lpad(F.col("position").cast("string"), 3, "0"), F.lit("-"), Txt.slug("key"))
    )
    named.write.mode("overwrite").partitionBy("dict_id").json(os.path.join(path, "queue"))


def cell(value: Column | str) -> Column:
    return F.replace(F.replace(col(value), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def diagnostics_rows(covered: DataFrame, titles: DataFrame) -> DataFrame:
    """Markdown table rows by structured rate, then title."""
    joined = covered.join(titles, "dict_id")
    rate = F.concat(F.floor(F.col("structured_rate") * 100 + 0.5).cast("string"), F.lit("%"))
    line = F.concat(
        F.lit("| "),
        F.concat_ws(" | ", cell("title"), F.col("samples").cast("string"), rate, F.col("median_senses").cast("string")),
        F.lit(" |"),
    )
    return joined.withColumn("line", line).orderBy(F.col("structured_rate").desc(), "title")


def write_diagnostics(covered: DataFrame, titles: DataFrame, path: str) -> None:
    rows = diagnostics_rows(covered, titles)
    rows.write.mode("overwrite").json(os.path.join(path, "json"))
    rows.select("line").write.mode("overwrite").text(os.path.join(path, "markdown"))


def rebuild(derived: dict[str, DataFrame], path: str) -> None:
    """Every derived table is computed again and replaces the old one."""
    for name, df in derived.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))


def profile_table(spark: SparkSession, path: str) -> DataFrame:
    """Layout profiles from a JSON array, with a fixed schema, one row each."""
    return spark.read.schema(PROFILE).option("multiLine", "true").json(path)


def read_profiles(spark: SparkSession, path: str) -> list[dict]:
    """The profiles as selector settings of a plan; they are hand-written, so all of them fit the driver."""
    rows = profile_table(spark, path).collect()
    return [
        {
            "id": r["id"],
            "selectors": list(r["selectors"] or []),
            "titles": list(r["titles"] or []),
            "require_title": bool(r["require_title"]),
            "root": r["root"],
            "ignore": list(r["ignore"] or []),
            "fields": {k: list(v) for k, v in (r["fields"] or {}).items()},
        }
        for r in rows
    ]


def loudness_gain(
    loudness: Column | str, peak: Column | str, volume: Column | int = 100, normalize: bool = True,
    least: int = 10, most: int = 200,
) -> Column:
    """Linear gain of a recording: matched loudness plus volume, held under the peak ceiling.

    Unknown (NULL or NaN) loudness or peak leaves that step out.
    """
    known = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    loud, top = col(loudness), col(peak)
    setting = F.greatest(F.lit(least), F.least(F.lit(most), F.lit(volume) if isinstance(volume, int) else volume))
    base = 20 * F.log10(setting / 100)
    matched = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.lit(-16.0) - loud))
    decibel = base + (F.when(known(loud), matched).otherwise(0.0) if normalize else F.lit(0.0))
    held = F.when(known(top), F.least(decibel, F.lit(-1.0) - top)).otherwise(decibel)
    return F.pow(F.lit(10.0), held / 20)
