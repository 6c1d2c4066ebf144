"""Text documents in shard files with an index, written through a Python data source.

Every task appends its documents to shards of at most ``shard_bytes`` (one longer document has a shard to itself) and
an index file of (keys, shard, start, bytes), so the number of files follows the bytes and not the documents, and any
document is read by its place. A job's files carry its name; when it commits, files that attempts without a commit
left are deleted and one small file that names the live indexes is replaced. A job that fails leaves a mark and then deletes
its files; a task that still runs looks for the mark around every file it makes, and takes its own away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructField, StructType

from foliospark.sinks.store import filesystem, names, put

SHARD_BYTES = 128 << 20
LIVE = "live.json"
FAILED = "_failed-"  # and the job's name
PLACE = "shard string, start long, bytes long"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]  # shards and the index, below the folder


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.limit = options["path"], int(options.get("shard_bytes", SHARD_BYTES))
        self.columns, self.overwrite, self.job = columns, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = filesystem(self.path)
        attempt = f"{self.job}-{uuid.uuid4().hex}"
        files.create_dir(f"{root}/shards")
        files.create_dir(f"{root}/indexes")
        shards, out, at, index = [], None, 0, []
        name = f"indexes/{attempt}.parquet"

        def stop_if_failed() -> None:
            if files.get_file_info(f"{root}/{FAILED}{self.job}").is_file:
                for made in [*shards, name]:
                    if files.get_file_info(f"{root}/{made}").is_file:
                        files.delete_file(f"{root}/{made}")
                raise RuntimeError("the export has failed in another task")

        for batch in iterator:
            *keys, text = batch.columns
            places = []
            for value in text:
                data = value.as_buffer() if value.is_valid else b""
                size = value.as_buffer().size if value.is_valid else 0
                if out is None or (at and at + size > self.limit):
                    if out is not None:
                        out.close()
                    stop_if_failed()
                    shards.append(f"shards/{attempt}-{len(shards)}.txt")
                    out, at = files.open_output_stream(f"{root}/{shards[-1]}"), 0
                    stop_if_failed()
                out.write(data)
                places.append((shards[-1], at, size))
                at += size
            columns = [*keys, *(pa.array([p[i] for p in places], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64())))]
            index.append(pa.table(columns, [*self.columns[:-1], "shard", "start", "bytes"]))
        if out is None:
            return Written([])
        out.close()
        stop_if_failed()
        pq.write_table(pa.concat_tables(index), f"{root}/{name}", filesystem=files)
        stop_if_failed()
        return Written([*shards, name])

    def commit(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        mine = {f for m in messages if m for f in m.files}
        before = [] if self.overwrite else live_indexes(self.path)
        put(files, f"{root}/{LIVE}", json.dumps(sorted(f for f in mine if f.startswith("indexes/")) + before).encode())
        self.clean(mine, self.overwrite)

    def abort(self, messages: list[Written | None]) -> None:
        files, root = filesystem(self.path)
        files.create_dir(root)
        put(files, f"{root}/{FAILED}{self.job}", b"")
        self.clean(set(), False)

    def clean(self, keep: set[str], others: bool) -> None:
        """Delete this job's files but those to keep, and other jobs' files if they are replaced."""
        files, root = filesystem(self.path)
        for folder in ("shards", "indexes"):
            for path in names(files, f"{root}/{folder}"):
                name = f"{folder}/{path.rsplit('/', 1)[1]}"
                if name not in keep and (others or name.startswith(f"{folder}/{self.job}")):
                    files.delete_file(path)


class TextShards(DataSource):
    """Sink ``text_shards`` with options path and shard_bytes; the last column is the text."""

    @classmethod
    def name(cls) -> str:
        return "text_shards"

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(dict(self.options), schema.names, overwrite)


def live_indexes(path: str) -> list[str]:
    files, root = filesystem(path)
    if f"{root}/{LIVE}" not in names(files, root):
        return []
    with files.open_input_stream(f"{root}/{LIVE}") as f:
        return json.loads(f.read())


def export(rows: DataFrame, path: str, text: str, *keys: str, append: bool = False, shard_bytes: int = SHARD_BYTES) -> None:
    """Write one document per row; the export replaces what the folder held unless it appends."""
    rows.sparkSession.dataSource.register(TextShards)
    out = rows.select(*keys, F.col(text)).write.format("text_shards").mode("append" if append else "overwrite")
    out.option("path", path).option("shard_bytes", shard_bytes).save()


def read_index(spark: SparkSession, path: str, keys_ddl: str) -> DataFrame:
    """(keys, shard, start, bytes) of every document that is live."""
    found = [f"{path}/{f}" for f in live_indexes(path)]
    ddl = f"{keys_ddl}, {PLACE}"
    return spark.read.schema(ddl).parquet(*found) if found else spark.createDataFrame([], ddl)


def read_place(path: str, shard: str, start: int, size: int) -> str:
    """One document by its place; nothing else of the shard is read."""
    files, root = filesystem(path)
    with files.open_input_file(f"{root}/{shard}") as f:
        f.seek(start)
        return f.read(size).decode()


def read_texts(index: DataFrame, path: str) -> DataFrame:
    """Index rows with their ``content``. Sort by shard and start before to read shards in order."""
    schema = StructType([*index.schema.fields, StructField("content", StringType())])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(path)
        name, f = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, texts = batch.slice(at, 64), []
                for row in part.select(["shard", "start", "bytes"]).to_pylist():
                    if row["shard"] != name:
                        name, f = row["shard"], files.open_input_file(f"{root}/{row['shard']}")
                    f.seek(row["start"])
                    texts.append(f.read(row["bytes"]).decode())
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], schema=arrow)

    return index.mapInArrow(read, schema)

