"""WARC archives written and read by Spark, and their index as a merge of sorted runs.

Writing: every task sorts its captures by URL key and time and packs each WARC 1.1 record into a gzip member of its own.
Spark's text sink writes the members, with an empty gzip member as line separator, so that an archive is a plain gzip
file in any store that Spark reaches, and can be read from any member on. Reading: archives are split at the separators,
so a task holds a record, never an archive. The entries of a split are a sorted run. Entries are dealt by range of
(URL key, time, page); there are as many ranges as it takes for a task to hold its entries. A task merges the runs of
its range with loser trees of at most FAN runs, pass by pass. The ranges in order are the capture histories of all URLs.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrel.llm.common import BROADCAST_ROWS, attach, release, scratch, small_or_shuffled, staged

#: Payloads of fewer bytes are always stored in full.
LEAST_BYTES = 100
#: Records of one archive at most, index entries that a range is meant to hold, and runs that one tree merges.
RECORDS, HELD, FAN = 20_000, 200_000, 64
#: First second of the made-up capture times, 2024-01-01.
EPOCH = "2024-01-01"
END = "\r\n\r\n"
#: Ends a record of an archive: a gzip member without content. Its bytes are never UTF-8, so no stored text has them.
BETWEEN = b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = "url_key string, captured string, page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string"
SPLIT = f"run string, split long, {ENTRY}, inner long, length long"
INDEX = f"run string, {ENTRY}, offset long, length long"


def url_key(url):
    """Host labels from the right, then path and query: sorts a site's pages side by side."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7F]", "")
    host = F.lower(F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    rest = F.regexp_extract(clean, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def _made_up_time(page_id):
    second = F.pmod(F.coalesce(page_id, F.lit(0)), F.lit(100_000_000))
    two = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_add(F.lit(EPOCH).cast("date"), F.floor(second / 86400).cast("int")).cast("string"), F.lit("T"), two(F.floor(second / 3600) % 24), F.lit(":"), two(F.floor(second / 60) % 60), F.lit(":"), two(second % 60), F.lit("Z"))


def _urn(page_id):
    h = F.lower(F.lpad(F.hex(F.coalesce(page_id, F.lit(0))), 16, "0"))
    return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-8000-8000-"), h.substr(13, 4), F.lit("00000000>"))


def _page_of(urn: str) -> int:
    h = urn.split("urn:uuid:")[1].replace("-", "").rstrip(">")
    value = int(h[:12] + h[20:24], 16)
    return value - (1 << 64) if value >> 63 else value


def first_payloads(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = LEAST_BYTES) -> DataFrame:
    """digest, refers_to (the least page id) and copies of the payloads that several pages have; a written table."""
    html = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("bytes")).where(F.col("bytes") >= least)
    return staged(slim.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1"), "first-payloads")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each record as one gzip member that doesn't contain the separator."""
    for batch in batches:
        for record in batch.column(0):
            data = record.as_buffer()
            for level in (5, 6, 9, 1):
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(data) + packer.flush()
                if BETWEEN not in member:
                    break
            yield pa.RecordBatch.from_arrays([pa.array([member], pa.binary())], names=["value"])
    release()


def write_warc(pages: DataFrame, where: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> None:
    """A WARC record for each page, in gzipped archives under `where`; each archive is sorted by URL key and time.

    The payload is the html in UTF-8, empty for null. Of equal payloads of LEAST_BYTES or more, the pages with the least
    id are responses and the others are revisits that refer to it; a page with a null id is a response. A page is told
    by its payload, so rows that repeat an id, with the same payload or another, are each a record. Without time_col
    (ISO 8601 text), capture times are made up from the page id. Control characters and spaces are left out of the
    target URI. Other columns are not read.
    """
    page, html = F.col(id_col).cast("long"), F.coalesce(F.col(html_col), F.lit(""))
    when = F.coalesce(F.col(time_col).cast("string"), _made_up_time(page)) if time_col else _made_up_time(page)
    rows = pages.select(page.alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), when.alias("captured"))
    rows = rows.withColumns({"digest": F.sha2(F.encode("html", "UTF-8"), 256), "url_key": url_key(F.col("url"))})
    facts = first_payloads(pages, id_col, html_col)
    rows = rows.join(F.broadcast(facts), "digest", "left") if facts.count() <= BROADCAST_ROWS else attach(rows, facts, "digest", "copies", rows.count())
    back = F.col("refers_to") < F.col("page_id")
    rows = rows.withColumn("refers_to", F.when(back, F.col("refers_to"))).drop("copies")
    size = F.octet_length("html").cast("string")
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    back = F.col("refers_to").isNotNull()
    block = F.when(back, answer).otherwise(F.concat(answer, F.col("html")))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(back, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7F]", "")),
        F.concat(F.lit("WARC-Date: "), F.col("captured")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(back, F.concat(F.lit(f"WARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _urn(F.col("refers_to")))),
        F.concat(F.lit("X-URL-Key: "), F.col("url_key")),
        F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    record = F.concat(head, F.lit(END), block, F.lit(END))
    packed = rows.sortWithinPartitions("url_key", "captured", "page_id", "digest").select(record.alias("value")).mapInArrow(_members, "value binary")
    # The cast keeps the bytes as they are, and the text sink writes them so.
    packed.select(F.col("value").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).option("maxRecordsPerFile", RECORDS).text(where)


class Stream:
    """Bytes of a gzip file (of one or many members), or of plain bytes, on demand."""

    def __init__(self, content: bytes) -> None:
        self.content, self.at, self.buffer, self.zip = memoryview(content), 0, b"", None
        self.packed = content[:2] == b"\x1f\x8b"

    def _more(self) -> bool:
        if self.at >= len(self.content) and not (self.zip and self.zip.unconsumed_tail):
            return False
        if not self.packed:
            part, self.at = bytes(self.content[self.at : self.at + (1 << 20)]), self.at + (1 << 20)
        else:
            self.zip = self.zip or zlib.decompressobj(31)
            data = self.zip.unconsumed_tail
            if not data:
                data, self.at = self.content[self.at : self.at + (1 << 16)], self.at + (1 << 16)
            part = self.zip.decompress(data, 1 << 20)
            if self.zip.eof:
                self.at = min(self.at, len(self.content)) - len(self.zip.unused_data)
                self.zip = None
        self.buffer += part
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.buffer.find(mark, start)) < 0:
            start = max(0, len(self.buffer) - len(mark))
            if not self._more():
                return None
        out, self.buffer = self.buffer[:k], self.buffer[k + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        while have < n:
            self.buffer = b""
            if not self._more():
                raise ValueError("an archive ends inside a record")
            parts.append(self.buffer)
            have += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked archive, header fields in lower case, block) of each record."""
    stream, offset = Stream(content), 0
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        block = stream.take(int(fields["content-length"]))
        stream.take(4)
        yield offset, fields, block
        offset += len(head) + len(block) + 8


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index entries of the records of each split, with their place in the split."""
    at: dict[tuple[str, int], int] = {}
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    for batch in batches:
        rows = []
        for run, split, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            content = value.as_buffer()
            whole = len(content) + len(BETWEEN)
            for offset, fields, block in records(content.to_pybytes()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
                digest = fields["warc-payload-digest"].partition(":")[2]
                kind, to = fields["warc-type"], fields.get("warc-refers-to")
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"a payload doesn't match its digest: {run}, {offset} bytes into a record of the split at {split}")
                page = fields.get("x-page-id")
                rows.append((run, split, fields["x-url-key"], fields["warc-date"], int(page) if page else None, kind, _page_of(to) if to else None, size, digest, at.get((run, split), 0) + offset, whole))
            at[run, split] = at.get((run, split), 0) + whole
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=[x.split()[0] for x in SPLIT.split(", ")])
    release()


def entry_key(entry: tuple) -> tuple:
    """URL key, time, page id (null first), digest."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[6], entry[7]


def read_index(spark: SparkSession, where: str) -> DataFrame:
    """The index entries of all archives under `where`: run, url_key, captured, page_id, record_type, refers_to,
    payload_bytes, payload_digest, offset and length of the record's gzip member. A written table.

    An archive is read in splits, record by record; offsets are the sum of all earlier splits' records. Archives from
    elsewhere, without separators, are read as one value each and must be below 2 GB.
    """
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", BETWEEN.decode("latin-1")).text(where)
    values = lines.select("_metadata.file_path", "_metadata.file_block_start", F.col("value").cast("binary").alias("value"))
    found = staged(values.mapInArrow(_entries, SPLIT), "splits")
    ends = found.groupBy("run", "split").agg(F.max(F.col("inner") + F.col("length")).alias("size"))
    before = F.sum("size").over(Window.partitionBy("run").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    starts = ends.select("run", "split", F.coalesce(before, F.lit(0)).alias("start"))
    placed = found.join(small_or_shuffled(staged(starts, "split-starts")), ["run", "split"])
    return placed.withColumn("run", F.concat("run", F.lit("#"), F.col("split"))).withColumn("offset", F.col("start") + F.col("inner")).select(*[x.split()[0] for x in INDEX.split(", ")])


class LoserTree:
    """Merges sorted iterators. Inner nodes keep the loser of their game; the winner is replayed on its path only."""

    def __init__(self, runs: list[Iterator[tuple]], key) -> None:
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads = [self._next(i) for i in range(self.k)]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i)

    def _next(self, i: int) -> tuple | None:
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None or (a is not None and a[:2] < b[:2])

    def _replay(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # still building: wait here for the other side
                self.losers[node] = i
                return
            if not self._beats(i, other):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner][2]
            self.heads[winner] = self._next(winner)
            self._replay(winner)


def merged(runs: list[list[tuple]], fan: int = FAN) -> Iterator[tuple]:
    """All entries in order. A run that isn't sorted is cut where the order breaks; passes of trees of at most `fan`
    runs leave few enough for the last tree."""
    pieces: list[list[tuple]] = []
    for run in runs:
        first = 0
        for k in range(1, len(run) + 1):
            if k == len(run) or entry_key(run[k]) < entry_key(run[k - 1]):
                pieces.append(run[first:k])
                first = k
    while len(pieces) > fan:
        pieces = [list(LoserTree([iter(p) for p in pieces[k : k + fan]], entry_key)) for k in range(0, len(pieces), fan)]
    yield from LoserTree([iter(p) for p in pieces], entry_key)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    number, schema = TaskContext.get().partitionId(), None
    for batch in batches:
        schema = batch.schema
        for run, *entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(run, []).append((*entry, run))
    held, at = [], 0
    for entry in merged(list(runs.values())):
        held.append(entry)
        if len(held) == 10_000:
            yield _history(held, schema, number, at)
            at, held = at + len(held), []
    if held:
        yield _history(held, schema, number, at)
    release()


def _history(held: list[tuple], schema: pa.Schema, number: int, at: int) -> pa.RecordBatch:
    names = schema.names[1:] + ["run"]
    columns = [pa.array([e[c] for e in held], schema.field(n).type) for c, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([number] * len(held), pa.int32()), pa.array(range(at, at + len(held)), pa.int64())], names=[*names, "range_no", "inner"])


def histories(index: DataFrame, ranges: int | None = None) -> DataFrame:
    """The entries of all runs with their place in the global order of (url_key, captured, page_id, payload_digest).

    Ties of all four, which are equal but for where they are stored, are placed by offset. Ranges are cut by all of
    these, so no URL, however often captured, has to fit one task.
    """
    least = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or max(least, index.count() // HELD + 1)
    out = ", ".join(INDEX.split(", ")[1:]) + ", run string, range_no int, inner long"
    found = staged(index.repartitionByRange(ranges, "url_key", "captured", "page_id", "payload_digest", "offset", "run").mapInArrow(_merge, out), "ranges")
    sizes = found.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    return found.join(small_or_shuffled(staged(sizes.select("range_no", F.coalesce(before, F.lit(0)).alias("base")), "range-sizes")), "range_no").withColumn("place", F.col("base") + F.col("inner")).drop("base", "inner", "range_no")


def capture_histories(pages: DataFrame, where: str | None = None, **columns: str) -> DataFrame:
    """Writes pages as WARC archives (to a scratch folder if none is named), reads them back and merges the index.

    One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, run, offset,
    length, place (from 0, in the order of histories). Rows that repeat a page_id are each a record. A payload of up
    to 2 GB is one value, as it is in pages. An empty table gives no rows.
    """
    spark = pages.sparkSession
    where = where or scratch(spark, "warc")
    write_warc(pages, where, **columns)
    return histories(read_index(spark, where))
