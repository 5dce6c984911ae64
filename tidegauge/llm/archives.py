r"""WARC archives of pages, and their capture index by an external merge.

A record is built by DataFrame functions and written by Spark's text sink, whose
line separator ``\r\n\r\n`` is what ends a record, so that archives commit and
survive lost executors like any other output. Equal payloads of at least
REVISIT_BYTES are stored once: the record of the greatest page_id is the
response, the others are revisit records that refer to it. A payload that holds
the start line of a record is stored in base64 under an HTTP header that says so;
archives can therefore be read in splits, by the start line ``WARC/1.1\r\n`` as the
separator: its first character doesn't come again in it, and readers of splits lose
a separator that overlaps with itself where it crosses the end of a buffer.

The index has a row per record: URL key (host labels reversed, then path and
query), timestamp, archive, offset. It is made by an external merge: each task
that reads captures sorts them by (URL key, timestamp) and writes them as a run.
Range partitions of bounded size then get their slice of every run, in the runs'
own order, and a loser tree merges the slices. The rows of all partitions in
order are the capture histories of all URLs, and a URL with very many captures
spreads over partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.common import shared_dir, written

REVISIT_BYTES = 1000
_EOL, _END = "\r\n", "\r\n\r\n"
_START = "WARC/1.1\r\n"
_OFFSET = "X-Archive-Offset: "
#: Seconds since the epoch of the capture with page_id 0; captures are a second apart.
FIRST_CAPTURE = 1_704_067_200


def url_key(url: Column) -> Column:
    """Sortable form of a URL: ``com,example,www)/path?query``; the port and the fragment go, userinfo too."""
    text = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(text, r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(text, r"^[a-z][a-z0-9+.\-]*://[^/?#]*", ""), "#.*$", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def _uuid(page: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def records(pages: DataFrame) -> DataFrame:
    """(value): the text of each page's record, with room for its offset."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    base = base.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload"))
    # who refers to whom is found among digests; payloads are then dealt by (page_id, digest), so that those of a popular digest are spread
    known = written(base.where(F.col("bytes") >= REVISIT_BYTES).select("page_id", "digest"))
    repeated = known.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = lambda page: F.coalesce(page.cast("string"), F.lit(""))
    revisits = written(known.join(repeated, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select(named(F.col("page_id")).alias("page"), "digest", "keeper").distinct())
    rows = base.withColumn("page", named(F.col("page_id"))).join(revisits, ["page", "digest"], "left").drop("page")
    revisit = F.col("keeper").isNotNull()
    packed = F.contains(F.concat(F.col("payload"), F.lit(_END)), F.lit(_START))
    body = F.when(revisit, "").when(packed, F.base64("payload")).otherwise(F.col("payload"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
        F.when(~revisit & packed, "Content-Encoding: base64\r\n").otherwise(""),
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(_END), body,
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(_EOL))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    head = F.concat(
        F.lit(f"{_START}{_OFFSET}{'0' * 20}{_EOL}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _uuid(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + FIRST_CAPTURE), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("X-Page-Id", page),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", _uuid(F.col("keeper"))), line("X-Refers-To-Page-Id", F.col("keeper").cast("string")),
        )).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(http).cast("string")),
        F.lit(_EOL), http,
    )
    return rows.select(head.alias("value"))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records with their offsets in the file that their partition becomes."""
    offset, at = 0, len(_START) + len(_OFFSET)
    for batch in batches:
        out = []
        for value in batch.column(0).to_pylist():
            out.append(f"{value[:at]}{offset:020d}{value[at + 20 :]}")
            offset += len(out[-1].encode()) + len(_END)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_archives(pages: DataFrame, folder: str) -> None:
    """One archive for each partition of ``pages`` (page_id, url, html)."""
    records(pages).mapInArrow(_placed, "value string").write.option("lineSep", _END).text(folder)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, captured, archive, offset, intact, payload."""
    rows = spark.read.option("lineSep", _START).text(folder).select("value", F.col("_metadata.file_name").alias("archive"))
    cut = F.locate(_END, F.col("value"))
    head = F.concat(F.lit(_EOL), F.substring(F.col("value"), F.lit(1), cut - 1), F.lit(_EOL))
    block = F.col("value").substr(cut + 4, F.length("value"))
    field = lambda name: F.regexp_extract(F.col("head"), rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda name: F.nullif(field(name), F.lit("")).cast("long")
    rows = rows.where(F.length("value") > 0).select("archive", head.alias("head"), block.alias("block"))
    http = F.locate(_END, F.col("block"))
    size = F.regexp_extract(F.col("block"), r"^HTTP/1.1 200 OK\r\n(?:[^\r\n]+\r\n)*?Content-Length: (\d+)\r\n\r\n", 1).cast("int")
    raw = F.substring(F.col("block").substr(http + 4, F.length("block")).cast("binary"), F.lit(1), size)
    rows = rows.select("archive", "head", F.substring("block", 1, 200).contains("\r\nContent-Encoding: base64\r\n").alias("packed"), raw.alias("raw"))
    rows = rows.withColumn("payload", F.when(F.col("packed"), F.unbase64(F.col("raw").cast("string"))).otherwise(F.col("raw")))
    revisit = field("WARC-Type") == "revisit"
    digest = F.regexp_extract(F.col("head"), r"\r\nWARC-Payload-Digest: sha1:([0-9a-f]{40})\r\n", 1)
    found = F.when(revisit, digest).otherwise(F.sha1("payload"))
    return rows.select(
        number("X-Page-Id").alias("page_id"),
        F.when(revisit, number("X-Payload-Length")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        found.alias("payload_digest"), field("WARC-Type").alias("record_type"), number("X-Refers-To-Page-Id").alias("refers_to"),
        field("WARC-Target-URI").alias("url"), field("WARC-Date").alias("captured"), "archive", number(_OFFSET[:-2]).alias("offset"),
        (found == digest).alias("intact"), "payload",
    )


class LoserTree:
    """Merge of k sorted sequences: the tree keeps the loser of every match, so a step replays one path."""

    def __init__(self, runs: list) -> None:
        self.runs, self.k = [iter(r) for r in runs], len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._replay(leaf)

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _replay(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            held = self.tree[node]
            if held < 0:  # the first to come waits for its opponent
                self.tree[node] = winner
                return
            if self._wins(held, winner):
                self.tree[node], winner = winner, held
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and self.heads[self.tree[0]] is not None:
            winner = self.tree[0]
            yield winner, self.heads[winner]
            self.heads[winner] = next(self.runs[winner], None)
            self._replay(winner)


#: Rows that a range partition of the merge holds, about.
MERGE_ROWS = 200_000
_ORDER = ["url_key", "captured", "page_id", "archive", "offset"]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of runs of a range, which come one after another, each sorted, as one sorted sequence."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    rows = pa.Table.from_batches(table).combine_chunks()
    seq = rows["_seq"].to_numpy() >> 33  # the run's number stands above its rows'
    cuts = [0, *(np.flatnonzero(np.diff(seq)) + 1).tolist(), len(seq)]

    def slice_(start: int, stop: int) -> Iterator[tuple]:
        for at in range(start, stop, 1024):
            part = rows.slice(at, min(1024, stop - at))
            for i, (key, stamp, page, archive, offset) in enumerate(zip(*(part[c].to_pylist() for c in _ORDER)), at):
                yield key.encode(), stamp or "", page is not None, page or 0, archive or "", offset or 0, i

    rows_out = rows.drop_columns(["_seq"])
    place: list[int] = []
    for _, entry in LoserTree([slice_(a, b) for a, b in zip(cuts, cuts[1:])]):
        place.append(entry[-1])
        if len(place) == 10_000:
            yield from rows_out.take(pa.array(place)).combine_chunks().to_batches()
            place = []
    if place:
        yield from rows_out.take(pa.array(place)).combine_chunks().to_batches()


def sorted_runs(captures: DataFrame) -> DataFrame:
    """``captures`` with url_key, written as sorted runs, one by each task that reads captures; ``_seq`` is a row's run and place."""
    keyed = captures.withColumn("url_key", url_key(F.col("url")))
    return written(keyed.sortWithinPartitions(*_ORDER).withColumn("_seq", F.monotonically_increasing_id()))


def capture_index(captures: DataFrame) -> DataFrame:
    """``captures`` with url_key, in global order of (url_key, captured, page_id) by partition and row."""
    runs = sorted_runs(captures)
    ranges = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // MERGE_ROWS))
    # keys are compared by the merge alone: the sort by a number only puts each run's slice back together
    slices = runs.repartitionByRange(ranges, *_ORDER).sortWithinPartitions("_seq")
    return slices.mapInArrow(_merged, slices.drop("_seq").schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """The index rows of the archives that ``pages`` (page_id, url, html) were written to and read back from.

    Null html is an empty payload. Of equal payloads of at least REVISIT_BYTES
    the row with the greatest page_id is the response (rows that repeat that
    page_id all are) and the others refer to it; rows without page_id count as
    least. Null URLs have the key ``)/``. An empty table gives no rows; other
    columns are ignored.
    """
    spark, folder = pages.sparkSession, shared_dir(pages.sparkSession)
    write_archives(pages, folder)
    index = capture_index(read_archives(spark, folder).drop("payload"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "offset", "intact")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
k as (select d, max(page_id) as keeper from p where n >= 1000 group by d having count(*) > 1)
select page_id, cast(n as bigint) as payload_bytes, p.d as payload_digest,
  case when keeper is not null and n >= 1000 and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
  case when keeper is not null and n >= 1000 and page_id is distinct from keeper then keeper end as refers_to
from p left join k using (d)
"""
