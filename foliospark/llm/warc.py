"""WARC archives by way of a chunked record table.

A payload never travels whole. Spark cuts it into rows (record, chunk number, at most ``CHUNK``
bytes); each row becomes one WARC segment, so an oversized payload is a first record and
``continuation`` records, and carries the SHA-1 of the payload up to its end. Spark's text writer
stores the rows, one gzip file per task, with the committer that survives lost executors; a row is a
segment and the line separator is the blank lines that end a WARC record. The reader streams the
lines of a file back into bytes, walks headers and lengths, and gives chunk rows again, no longer
than ``CHUNK``, even of archives that were not segmented. A digest is carried from chunk to chunk;
only segmented records are brought together, by record and chunk number, and are streamed, not grouped.

Defined cases. A null payload is empty, a null identifier or URL is left out of the header and null
again when read. Repeated rows are records of their own. Among equal payloads of at least ``least``
bytes the row with the largest identifier is the response (ties: larger URL, null least; of rows equal
in all, one), the others are revisits, which store no payload. No rows give an archive without
records. Other columns don't matter, whatever they are called. A record that breaks off, or whose bytes don't have
the digest the header states, is read with ``intact`` false.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import hot_join, named, shared_dir, stored

CHUNK = 1 << 20  # bytes of payload in a chunk row
LEAST = 1000  # shorter payloads are never deduplicated
DATE = "2026-01-01T00:00:00Z"  # stated capture time: nothing reads the clock
BATCH = 8 << 20  # bytes after which rows leave a task
END = "\r\n\r\n"
CHUNKS = "record string, kind string, chunk long, last boolean, data binary, bytes long, sha1 string, target string, refers string, stated string, stated_bytes long, segmented boolean, intact boolean"
ARROW = pa.schema(
    [("record", pa.string()), ("kind", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes", pa.int64()), ("sha1", pa.string()),
     ("target", pa.string()), ("refers", pa.string()), ("stated", pa.string()), ("stated_bytes", pa.int64()), ("segmented", pa.bool_()), ("intact", pa.bool_())]
)


# ---------------------------------------------------------------- which rows are responses


def record_name(key: str, target: str, copy: Column) -> Column:
    """A URI for one record: identifier (empty if null; holds no colon), content, target and number of the copy."""
    mark = F.sha2(F.concat_ws(":", F.isnull(target).cast("string"), F.coalesce(target, F.lit("")), "sha"), 256)
    return F.concat_ws(":", F.lit("urn:record"), F.coalesce(F.col(key).cast("string"), F.lit("")), mark, copy.cast("string"))


def classified(rows: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(responses with payload, revisits without) of rows (key, target, payload).

    Rows are folded by content with partial aggregation, so the copies of a hot payload become one row
    per task before anything moves, and a payload is shuffled once at most. A revisit meets its
    response on narrow columns.
    """
    body = F.coalesce(F.col("payload"), F.lit("").cast("binary"))
    marked = rows.select("key", "target", body.alias("payload")).select(
        "key", "target", "payload", F.sha2("payload", 256).alias("sha"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("size")
    )
    big = F.col("size") >= least
    own = F.when(~big, F.struct("key", "target"))  # small payloads stay apart by row
    order = F.struct("key", "target")
    responses = marked.groupBy("sha", "sha1", "size", own.alias("own")).agg(
        F.max(order).alias("top"), F.max_by("payload", order).alias("payload"), F.count("*").alias("n")
    )
    copies = F.when(F.col("own").isNull(), F.lit(1).cast("long")).otherwise(F.col("n"))
    responses = responses.select("sha1", "size", "sha", F.col("top.key").alias("key"), F.col("top.target").alias("target"), "payload", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    responses = responses.select(record_name("key", "target", F.col("copy")).alias("record"), "target", "sha1", "size", "payload")

    narrow = stored(marked.where(big).groupBy("sha", "sha1", "size", "key", "target").agg(F.count("*").alias("n")), "warc-rows")
    groups = stored(narrow.groupBy("sha").agg(F.max(order).alias("top"), F.sum("n").alias("all")).where("all > 1"), "warc-groups")
    met = hot_join(narrow, groups, "sha", "all")
    top = F.col("key").eqNullSafe(F.col("top.key")) & F.col("target").eqNullSafe(F.col("top.target"))
    first = F.when(top, 2).otherwise(1).cast("long")  # copy 1 of the top row is the response
    revisits = met.select("sha", "sha1", "size", "key", "target", "top", "n", first.alias("first")).where("n >= first").select(
        "sha", "sha1", "size", "key", "target", "top", F.explode(F.sequence(F.col("first"), F.col("n"))).alias("copy")
    )
    refers = record_name("top.key", "top.target", F.lit(1))
    return responses, revisits.select(record_name("key", "target", F.col("copy")).alias("record"), "target", "sha1", "size", refers.alias("refers"))



# ---------------------------------------------------------------- writing


def cut(responses: DataFrame, chunk: int) -> DataFrame:
    """One row per chunk. The bytes are sliced from the row in the JVM; Python never sees a whole payload."""
    last = F.greatest(F.lit(0), F.ceil(F.col("size") / chunk).cast("int") - 1)
    rows = responses.withColumn("last", last).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("last"))))
    return rows.select("record", "target", "sha1", "size", "last", "chunk", F.substring(F.col("payload"), F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"))


def line(name: str, value: str | int | None) -> str:
    return "" if value is None else f"{name}: {value}\r\n"


def uri(text: str | None) -> str | None:
    """A header value without line breaks or other control characters; ``unquote`` undoes it."""
    return None if text is None else re.sub(r"[\x00-\x20%\x7f]", lambda m: quote(m.group(), safe=""), text)


def segments(batches: Iterator[pa.RecordBatch], date: str) -> Iterator[pa.RecordBatch]:
    """Chunk rows as WARC records, with the digest of the payload so far; chunks of a record follow each other."""
    out, held, digest = [], 0, hashlib.sha1()
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i in range(batch.num_rows):
            record, target, sha1, size, last, chunk = (c[i].as_py() for c in columns[:6])
            data = columns[6][i].as_buffer()
            if not chunk:
                digest = hashlib.sha1()
            digest.update(data)
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}".encode() if not chunk else b""
            block = hashlib.sha1(head)
            block.update(data)
            text = "WARC/1.1\r\n" + line("WARC-Type", "continuation" if chunk else "response")
            text += line("WARC-Record-ID", f"<{record}:{chunk + 1}>" if chunk else f"<{record}>") + line("WARC-Date", date) + line("WARC-Target-URI", uri(target))
            text += line("WARC-Block-Digest", "sha1:" + block.hexdigest()) + line("X-Payload-Digest-So-Far", "sha1:" + digest.hexdigest())
            if last:
                text += line("WARC-Segment-Number", chunk + 1) + (line("WARC-Segment-Origin-ID", f"<{record}>") if chunk else "")
                text += line("WARC-Segment-Total-Length", size) if chunk == last else ""
            text += "" if chunk else line("Content-Type", "application/http; msgtype=response") + line("WARC-Payload-Digest", "sha1:" + sha1) + line("X-Payload-Length", size)
            text += line("Content-Length", len(head) + len(data)) + "\r\n"
            out.append(b"".join((text.encode(), head, data)))
            held += len(out[-1])
            if held > BATCH:
                yield pa.record_batch([pa.array(out, pa.binary())], ["value"])
                out, held = [], 0
    if out:
        yield pa.record_batch([pa.array(out, pa.binary())], ["value"])


def revisit_records(revisits: DataFrame, date: str) -> DataFrame:
    """A revisit has headers only."""
    target = F.concat(F.lit("WARC-Target-URI: "), escaped("target"), F.lit("\r\n"))
    return revisits.select(
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <"), "record", F.lit(f">\r\nWARC-Date: {date}\r\n"), F.coalesce(target, F.lit("")),
            F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"), "refers",
            F.lit(">\r\nWARC-Payload-Digest: sha1:"), "sha1", F.lit("\r\nX-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\nContent-Length: 0\r\n\r\n"),
        ).alias("value")
    )


def escaped(name: str) -> Column:
    """``uri`` for a column."""
    out = F.col(name)
    for code in [0x25, *range(0x21), 0x7F]:
        out = F.replace(out, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return out


def write_archives(rows: DataFrame, path: str, chunk: int = CHUNK, least: int = LEAST, date: str = DATE) -> None:
    """Write rows (key, target, payload) as gzip WARC files below ``path``."""
    responses, revisits = classified(rows, least)
    made = cut(responses, chunk).mapInArrow(lambda batches: segments(batches, date), "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", END).option("compression", "gzip").text(path + "/responses")
    revisit_records(revisits, date).write.option("lineSep", END).option("compression", "gzip").text(path + "/revisits")


# ---------------------------------------------------------------- reading


class Walker:
    """Bytes of one archive, as they come, to chunk rows."""

    def __init__(self, chunk: int):
        self.chunk, self.held, self.rows, self.size = chunk, b"", [], 0
        self.head = self.at = None

    def feed(self, data: bytes) -> None:
        self.held += data
        at = 0
        while True:
            if self.head is None:
                while self.held.startswith(b"\r\n", at):
                    at += 2
                end = self.held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                self.begin(self.held[at:end])
                at = end + 4
            if self.http:  # the head of the HTTP message is no payload
                end = self.held.find(b"\r\n\r\n", at, at + self.left)
                if end < 0 and len(self.held) - at < self.left:
                    break
                took = end + 4 - at if end >= 0 else 0
                at, self.left, self.http = at + took, self.left - took, False
            have = len(self.held) - at
            while self.left and have >= min(self.left, self.chunk):
                n = min(self.left, self.chunk)
                self.left -= n
                self.give(self.held[at : at + n], not self.left, True)
                at, have = at + n, have - n
            if self.left:
                break
            if not self.given:
                self.give(b"", True, True)
            self.head = None
        self.held = self.held[at:]

    def begin(self, head: bytes) -> None:
        fields = {}
        for part in head.decode("utf-8", "replace").split("\r\n"):
            name, _, value = part.partition(":")
            fields.setdefault(name.strip().lower(), value.strip())
        self.head, self.given = fields, 0
        length = fields.get("content-length", "")
        self.left = int(length) if length.isdigit() else 0
        self.http = fields.get("content-type", "").startswith("application/http")
        self.digest, self.bytes = hashlib.sha1(), 0

    def give(self, data: bytes, last: bool, intact: bool) -> None:
        f = self.head
        bare = lambda name: f[name].strip("<>") if name in f else None
        plain = lambda name: f[name].removeprefix("sha1:").lower() if name in f else None
        self.digest.update(data)
        self.bytes += len(data)
        number = int(f.get("warc-segment-number", "0") or 0)
        total = f.get("x-payload-length")
        chunk = max(0, number - 1) * (1 << 20) + self.given if number else self.given
        target = unquote(f["warc-target-uri"]) if "warc-target-uri" in f else None
        kind = f.get("warc-type", "")
        self.rows.append(
            (bare("warc-segment-origin-id") or bare("warc-record-id"), kind, chunk, last, data, self.bytes, self.digest.hexdigest(), target, bare("warc-refers-to"),
             plain("warc-payload-digest"), int(total) if total else None, number > 0, intact)
        )
        self.given += 1
        self.size += len(data) + 300

    def close(self) -> None:
        """What is left of a file that breaks off."""
        if self.head is not None:
            self.give(self.held[: self.left], True, False)
        self.head, self.held = None, b""

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(ARROW)
        self.rows, self.size = [], 0
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, ARROW)], schema=ARROW)


def walked(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Lines (file, value) in the order of each file to chunk rows."""
    walker, now = Walker(chunk), None
    for batch in batches:
        files, values, start = batch.column(0).to_pylist(), batch.column(1), 0
        while start < len(files):
            stop = start + 1
            while stop < len(files) and files[stop] == files[start]:
                stop += 1
            if files[start] != now:
                walker.close()
                now = files[start]
            for at in range(start, stop, 256):
                walker.feed(b"\n".join(values.slice(at, min(256, stop - at)).to_pylist()) + b"\n")
                if walker.size > BATCH:
                    yield walker.take()
            start = stop
    walker.close()
    yield walker.take()


def read_chunks(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """Chunk rows of the archives below ``path``: record, kind, chunk, data, bytes and SHA-1 up to here.

    A gzip file is one split, so a task streams it from its start. Bytes and SHA-1 count from the start of a
    segment; ``read_records`` carries them on where a record has several.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary")).mapInArrow(lambda b: walked(b, chunk), CHUNKS)


def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by record and number to one row per record; the digest is carried over batches."""
    names = [f.name for f in ARROW]
    now, first, digest, size, intact = None, None, None, 0, True
    for batch in batches:
        done = []
        for row in batch.select(names).to_pylist():
            if row["record"] != now:
                if first:
                    done.append(finished(first, digest, size, intact))
                now, first, digest, size, intact = row["record"], row, hashlib.sha1(), 0, True
            digest.update(row["data"])
            size += len(row["data"])
            intact = intact and row["intact"]
        if done:
            yield pa.RecordBatch.from_pylist(done, RECORDS)
    if first:
        yield pa.RecordBatch.from_pylist([finished(first, digest, size, intact)], RECORDS)


RECORDS = pa.schema([("record", pa.string()), ("kind", pa.string()), ("target", pa.string()), ("refers", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_())])


def finished(first: dict, digest, size: int, intact: bool) -> dict:
    same = first["stated"] in (None, digest.hexdigest()) and first["stated_bytes"] in (None, size)
    return {"record": first["record"], "kind": first["kind"], "target": first["target"], "refers": first["refers"], "payload_bytes": size, "payload_digest": digest.hexdigest(), "intact": intact and same}


def read_records(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """One row per record: name, kind, target, refers, payload_bytes and payload_digest of the full payload, intact.

    What a revisit says of its payload is taken from its header; all else is counted from the bytes read.
    """
    chunks = read_chunks(spark, path, chunk).where("kind <> 'warcinfo'")
    alone = chunks.where("not segmented and last").drop("data")
    revisit = F.col("kind") == "revisit"
    digest, size = F.when(revisit, F.col("stated")).otherwise(F.col("sha1")), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("bytes"))
    same = F.coalesce((F.col("stated") == digest) & (F.coalesce("stated_bytes", size) == size), F.lit(True))
    alone = alone.select("record", "kind", "target", "refers", size.alias("payload_bytes"), digest.alias("payload_digest"), (F.col("intact") & same).alias("intact"))
    parts = chunks.where("segmented").repartition("record").sortWithinPartitions("record", "chunk")
    return alone.unionByName(parts.mapInArrow(carried, alone.schema))


def op11_warc(spark, sf_dir: str) -> DataFrame:
    """Archives of all pages, written and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return page_records(pages, f"{shared_dir(spark)}/llm/warc-{uuid.uuid4().hex}")


def page_records(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    rows = pages.select(named("page_id").alias("key"), named("url").alias("target"), named("html").cast("binary").alias("payload"))
    write_archives(rows, path, chunk, least)
    page = lambda name: F.nullif(F.split_part(name, F.lit(":"), F.lit(3)), F.lit("")).cast("long")
    read = read_records(pages.sparkSession, path, chunk)
    return read.select(
        page(F.col("record")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), page(F.col("refers")).alias("refers_to"),
        F.col("target").alias("url"), "intact",
    )
