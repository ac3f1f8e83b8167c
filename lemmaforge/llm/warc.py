"""WARC archives of pages, and their capture index merged from sorted runs.

Writing: every record is one string column made in the JVM, so Spark writes the archives to any file system it
knows. Of pages with equal payloads the newest is a response, the others revisit it. Reading: one archive a row,
its records one after another; each archive gives a run of captures in order of URL key and time. The runs are
written, dealt by ranges of the whole sort key (a URL with very many captures spans several ranges), and in each
range a loser tree merges the pieces of the runs, so ranges in turn hold the histories in global order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaforge.session import cut_lineage, work_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = 2000  # of an archive at most
FIRST_SECOND = 1_704_067_200  # capture times are made from page ids, a second each, where pages have none

CAPTURES = (
    "url_key string, captured_at string, page_id {id}, url string, record_type string, payload_bytes bigint,"
    " payload_digest string, refers_to {id}, archive string, record_offset bigint, run string, seq bigint"
)


def base32_sha1(text: Column) -> Column:
    """SHA-1 of the text's UTF-8 bytes in base32: five hex digits at a time give four letters."""
    digest, letters = F.sha1(text), []
    for group in range(8):
        number = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """`pages` with `payload`, its size and digest, `record_type`, `refers_to` and `captured_at`.

    Null HTML is an empty payload. Rows that share the newest id of a payload are all responses; rows without id
    revisit the newest, and are responses if no row of their payload has an id. Null URLs have an empty target.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    own = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    own = own.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    # only payloads that repeat: most pages have none, and the table is written so that the planner knows its size
    repeated = own.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
    repeated = cut_lineage(repeated.agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1").drop("n"))
    own = own.join(repeated, "payload_digest", "left")
    again = F.col("newest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("newest")) & (F.col("payload_bytes") >= least_bytes)
    second = F.lit(FIRST_SECOND) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(2**31))
    return own.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("newest")).alias("refers_to"),
        F.date_format(F.timestamp_seconds(second), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at"),
    )


def record_text(pages: DataFrame) -> DataFrame:
    """A record a row, without the line feed that ends it and that the writer adds."""
    again = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    length = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Date: "), F.col("captured_at")),
        F.concat(F.lit("WARC-Target-URI: "), target),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), name("refers_to"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    body = F.when(again, F.lit("")).otherwise(F.col("payload"))
    return pages.select(F.concat(F.concat_ws("\r\n", *head), F.lit("\r\n\r\n"), http, body, F.lit("\r\n\r")).alias("value"))


def write_archives(pages: DataFrame, folder: str, records: int = RECORDS, least_bytes: int = 0) -> None:
    """Archives of at most `records` records each, compressed, in `folder`."""
    text = record_text(with_records(pages, least_bytes))
    text.write.option("compression", "gzip").option("maxRecordsPerFile", records).text(folder)


def read_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record; only one record is held."""
    offset = 0
    while line := stream.readline():
        size, headers = len(line), {}
        if line.strip():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no record at {offset}")
            while (field := stream.readline()).strip():
                size += len(field)
                key, _, value = field.decode().partition(":")
                headers[key.strip().lower()] = value.strip()
            size += len(field)
            block = stream.read(length := int(headers["content-length"]))
            if len(block) < length:
                raise ValueError(f"the record at {offset} is cut off")
            yield offset, headers, block
            size += length
        offset += size


def url_key(url: str) -> str:
    """Host labels in reverse, then path and query, in lower case; without scheme, port, `www` and fragment."""
    host, _, rest = re.sub(r"^[^/?#]*://", "", url.lower()).partition("#")[0].partition("/")
    labels = host.split("?")[0].split(":")[0].removeprefix("www.").split(".")
    return f"{','.join(reversed(labels))})/{rest}" if url else ""


def sort_key(url: str, at: str, page: int | None) -> tuple:
    return url, at, page is not None, page or 0


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    number = lambda name: int(name[10:-1]) if name[10:-1] else None  # noqa: E731  <urn:page:7>
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            run, found = path.as_py().rsplit("/", 1)[-1], []
            with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                for offset, head, block in read_records(io.BufferedReader(stream, 1 << 20)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"content-length:\s*(\d+)", http, re.I)[1])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response":
                        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if own != digest or size != len(payload):
                            raise ValueError(f"{run}: the record at {offset} is damaged")
                    target = head["warc-target-uri"]
                    back = number(head["warc-refers-to"]) if "warc-refers-to" in head else None
                    found.append((url_key(target), head["warc-date"], number(head["warc-record-id"]), target, head["warc-type"], size, digest, back, run, offset))
            found.sort(key=lambda c: sort_key(*c[:3]))
            yield run, found


def capture_runs(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """The captures of every archive, each archive a run sorted by URL key, time and id, `seq` its order."""
    schema = CAPTURES.format(id=id_type)
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, found in _captures(batches):
            columns = [*zip(*found)] or [()] * 10
            columns += [[name] * len(found), list(range(len(found)))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], names=arrow.names)

    files = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    return files.option("pathGlobFilter", "*.gz").load(folder).select("path", "content").mapInArrow(run, schema)


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of the match below it, the winner goes on up."""

    def __init__(self, lists: list[list[tuple]]) -> None:
        self.lists, self.places = lists, [0] * len(lists)
        self.losers = [-1] * max(1, len(lists))
        for i in range(len(lists)):
            self._replay(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether list a's head goes before b's; an empty list loses, of equal heads the earlier list wins."""
        if self.places[a] >= len(self.lists[a]):
            return False
        if self.places[b] >= len(self.lists[b]):
            return True
        one, two = self.lists[a][self.places[a]], self.lists[b][self.places[b]]
        return one < two or one == two and a < b

    def _replay(self, winner: int) -> None:
        node = (winner + len(self.lists)) // 2
        while node > 0:
            rival = self.losers[node]
            if rival < 0:  # while the tree is built the first to come waits for the other
                self.losers[node] = winner
                return
            if self._beats(rival, winner):
                self.losers[node], winner = winner, rival
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """Number of the list and place in it, of all entries in order."""
        for _ in range(sum(map(len, self.lists))):
            winner = self.losers[0]
            yield winner, self.places[winner]
            self.places[winner] += 1
            self._replay(winner)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order: `position` rises with URL key, time and id.

    Each range of keys comes to a task as pieces of runs, held as index rows only.
    """
    order = ["url_key", "captured_at", "page_id"]
    # run and seq part what is equal in the key, so no range has to hold all of it
    dealt = runs.repartitionByRange(*order, "run", "seq").sortWithinPartitions("run", "seq")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        names = rows.column("run").to_pylist()
        starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
        keys = list(map(sort_key, *(rows.column(c).to_pylist() for c in order)))
        tree = LoserTree([keys[a:b] for a, b in zip(starts, starts[1:])])
        places = pa.array([starts[i] + j for i, j in tree], pa.int64())
        first = TaskContext.get().partitionId() << 33
        merged = rows.take(places).append_column("position", pa.array(range(first, first + len(places)), pa.int64()))
        yield from merged.to_batches(max_chunksize=10_000)

    kind = f"{CAPTURES.format(id=runs.schema['page_id'].dataType.simpleString())}, position bigint"
    return dealt.mapInArrow(merge, kind)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, records: int = RECORDS) -> DataFrame:
    """Writes the pages to archives, reads these back, and returns the merged capture index, a row per page.

    `folder` is one that all executors share; by default a new one in the session's work folder.
    """
    spark = pages.sparkSession
    folder = folder or f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, records, least_bytes)
    kind = pages.schema["page_id"].dataType.simpleString()
    return merge_runs(cut_lineage(capture_runs(spark, folder, kind)))
