"""Secret scans over every version of every file, by an incremental ledger of blobs.

A version's content is addressed by its SHA-256. The ledger is a Parquet folder with one row per blob and
rule version that has been scanned: the spans found, or none. A scan reads the addresses, leaves out the
pairs the ledger has, scans each remaining blob once, appends the result as one new folder, and joins
the ledger back to all paths and versions. A run that breaks off leaves no committed folder, so the next
one scans its blobs again; readers take one row per blob and rule version.

Spans are code points [start, end) of the whole match, leftmost and non-overlapping within a kind. The
kinds ``assign``, ``access`` and ``hex`` are the base. ``pem``, ``jwt``, ``github`` and ``entropy`` are added beside them.

Defined cases: a null content is the empty blob, which has no spans. Equal contents are scanned once and
reported for each row, repeated rows included. An empty table gives no rows. Columns of ``versions`` stay as they are.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from foliospark.llm import common

RULE_VERSION = 1
BASE = ("assign", "access", "hex")
ADDED = ("pem", "jwt", "github", "entropy")
SPANS = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob binary, rule_version int, spans {SPANS}"

ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs [0-9a-f]+ that are long enough
PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----.*?-----END (?:[A-Z]+ )*PRIVATE KEY-----", re.S)
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
GITHUB = re.compile(r"gh[opsur]_[A-Za-z0-9]{36,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}")
BITS = 3.5  # of entropy per character


def random_looking(token: str) -> bool:
    """Digits, small and large letters, in even shares."""
    if not (any(c.isdigit() for c in token) and any(c.islower() for c in token) and any(c.isupper() for c in token)):
        return False
    return -sum(n / len(token) * math.log2(n / len(token)) for n in Counter(token).values()) >= BITS


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind in the order of BASE and ADDED."""
    found = []
    lower = text.lower()
    if any(word in lower for word in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "-----BEGIN" in text:
        found += [("pem", *m.span()) for m in PEM.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in JWT.finditer(text)]
    if "gh" in text:
        found += [("github", *m.span()) for m in GITHUB.finditer(text)]
    found += [("entropy", *m.span()) for m in TOKEN.finditer(text) if random_looking(m[0])]
    kinds = BASE + ADDED
    return sorted(found, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def scanner():
    """Column function text -> spans."""

    @pandas_udf(SPANS)
    def scan_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] for t in common.strings(texts)], dtype=object)

    return scan_text


def address(content: Column) -> Column:
    """Content address: the SHA-256 as 32 bytes; null as empty."""
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All committed rows of a ledger, none if it has no folder yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)


def scan(versions: DataFrame, ledger: str, content: str = "content", rule_version: int = RULE_VERSION) -> DataFrame:
    """``versions`` (any columns and a content) with ``row``, ``blob`` and ``spans``; new blobs enter the ledger."""
    spark = versions.sparkSession
    seen = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).select("blob")
    text = F.coalesce(common.named(content), F.lit(""))
    blobs = versions.select(address(common.named(content)).alias("blob"), text.alias("text")).dropDuplicates(["blob"])
    fresh = blobs.join(seen, "blob", "left_anti").select("blob", F.lit(rule_version).alias("rule_version"), scanner()("text").alias("spans"))
    fresh.write.parquet(f"{ledger}/run-{uuid.uuid4().hex}")
    known = read_ledger(spark, ledger).where(F.col("rule_version") == rule_version).dropDuplicates(["blob"]).select("blob", "spans")
    others = [c for c in versions.columns if c != content]
    paths = versions.select(F.struct(*[common.named(c) for c in others]).alias("row"), address(common.named(content)).alias("blob"))
    return paths.join(known, "blob")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, f"{common.shared_dir(spark)}/llm/ledger-{uuid.uuid4().hex}", "text")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), *[of(k) for k in BASE], F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )
