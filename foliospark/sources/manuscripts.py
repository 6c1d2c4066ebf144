"""Bulk readers for uploaded manuscript files."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HELD = 1 << 20  # bytes of files whose texts are held at once
DOCX_SCHEMA = "content string, error string"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_FALLBACK = "{http://schemas.openxmlformats.org/markup-compatibility/2006}Fallback"
_ALTERNATE = "{http://schemas.openxmlformats.org/markup-compatibility/2006}AlternateContent"
_SKIPPED = {_W + "del", _W + "instrText", _W + "pPr", _W + "rPr", _W + "delText"}
_FIXED_TEXT = {_W + "tab": "\t", _W + "noBreakHyphen": "‑", _W + "softHyphen": "­"}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Plain-text manuscripts, one row per file: path, file_name, size_bytes, content (UTF-8)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("value").alias("content"),
    )


def read_opaque(spark: SparkSession, path: str) -> DataFrame:
    """EPUB and PDF files by name and size; the bytes themselves are never read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{[eE][pP][uU][bB],[pP][dD][fF]}")
        .load(path)
        .select("path", F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("size_bytes"))
    )


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """Word files with their raw text."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][oO][cC][xX]").load(path)
    named = found.select(
        F.substring_index("path", "/", -1).alias("file_name"), F.col("length").alias("size_bytes"),
        F.col("content").alias("bytes"),
    )
    return extract_docx(named, "bytes")


def _raw_text(body: ET.Element) -> str:
    """Text below a node in document order; a stack instead of recursion, so depth has no limit."""
    out, stack = [], [body]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag == _W + "t":
            out.append(node.text or "")
        elif node.tag in _FIXED_TEXT:
            out.append(_FIXED_TEXT[node.tag])
        elif node.tag not in _SKIPPED:
            if node.tag == _ALTERNATE:
                fallback = node.find(_FALLBACK)
                node = ET.Element("none") if fallback is None else fallback
            if node.tag == _W + "p":
                stack.append("\n\n")
            stack.extend(reversed(node))
    return "".join(out)


def _main_part(archive: zipfile.ZipFile) -> str:
    """Name of the document part, as the package's relations tell; else the usual one."""
    try:
        relations = ET.fromstring(archive.read("_rels/.rels"))
    except (KeyError, ET.ParseError):
        return "word/document.xml"
    for relation in relations:
        if relation.get("Type", "").endswith("/officeDocument"):
            return relation.get("Target", "").lstrip("/")
    return "word/document.xml"


def docx_text(data: bytes | None) -> tuple[str | None, str | None]:
    """(text, None) or (None, reason). Each paragraph is followed by a blank line.

    Whatever is wrong with one file (no zip, a missing or damaged part, encryption, an unknown
    compression, no bytes) is that row's reason and never ends the job.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            body = ET.fromstring(archive.read(_main_part(archive))).find(_W + "body")
    except Exception as problem:  # the name goes into the row
        return None, type(problem).__name__
    return ("" if body is None else _raw_text(body)), None


def shares(batch: pd.DataFrame, column: str) -> Iterator[pd.DataFrame]:
    """A batch in shares of about HELD bytes (or characters) of a column; a larger value stands alone."""
    sizes = [len(v) if isinstance(v, (bytes, bytearray, memoryview, str)) else 0 for v in batch[column]]
    start = held = 0
    for i, size in enumerate(sizes):
        if held and held + size > HELD:
            yield batch.iloc[start:i].copy()
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield batch.iloc[start:].copy()


def extract_docx(df: DataFrame, bytes_column: str) -> DataFrame:
    """Replace a column of DOCX bytes by ``content`` and ``error``; one row in, one row out."""
    kept = [f for f in df.schema.fields if f.name != bytes_column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", " + DOCX_SCHEMA

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in shares(batch, bytes_column):
                texts = [docx_text(None if b is None else bytes(b)) for b in part.pop(bytes_column)]
                yield part.assign(content=[t for t, _ in texts], error=[e for _, e in texts])

    return df.mapInPandas(convert, schema)
