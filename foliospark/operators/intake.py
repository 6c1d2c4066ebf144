"""Manuscript intake: format, title, word count or estimate, placeholder and stored-file key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import extension, title_from_name, word_count
from foliospark.sources.dimensions import FORMATS, OPAQUE_FORMATS, TEXT_FORMATS

# Fixed value: bytes per word assumed for files whose text is not read.
BYTES_PER_WORD = 6


def estimated_words(size_bytes: Column | str) -> Column:
    """Size divided by six, rounded half up, in whole-number arithmetic."""
    size = F.col(size_bytes) if isinstance(size_bytes, str) else size_bytes
    return F.floor((size.cast("long") * 2 + BYTES_PER_WORD) / (2 * BYTES_PER_WORD)).cast("long")


def placeholder(ext: Column, file_name: Column | str) -> Column:
    """Text stored in place of a file that is kept unread."""
    return F.concat(F.lit("["), F.upper(ext), F.lit(" file uploaded - "), F.col(file_name), F.lit("]"))


def intake(manuscripts: DataFrame) -> DataFrame:
    """Add extension, format, title, staged text, word count, support flag and whether there is a text.

    Input: file_name, size_bytes, content, plus any other columns. A row-wise projection: no
    shuffle, and columns a caller does not select are never computed or read.
    """
    ext = extension("file_name")
    is_text = F.col("extension").isin(*TEXT_FORMATS)
    is_opaque = F.col("extension").isin(*OPAQUE_FORMATS)
    return (
        manuscripts.withColumn("extension", ext)
        .withColumn("file_format", F.concat(F.lit("."), F.col("extension")))
        .withColumn("title", title_from_name("file_name"))
        .withColumn("supported", F.col("extension").isin(*[f for f, _ in FORMATS]))
        .withColumn(
            "word_count",
            F.when(is_text, word_count("content")).when(is_opaque, estimated_words("size_bytes")).otherwise(F.lit(0).cast("long")),
        )
        .withColumn("has_text", F.when(is_text, F.col("size_bytes") > 0).otherwise(is_opaque))
        .withColumn(
            "content",
            F.when(is_text, F.col("content"))
            .when(is_opaque, placeholder(F.col("extension"), "file_name"))
            .otherwise(F.lit("")),
        )
    )


def stored_file_manifest(manuscripts: DataFrame) -> DataFrame:
    """Key and length of every file that is kept as raw bytes, one row per session and key."""
    ext = extension("file_name")
    return (
        manuscripts.filter(ext.isin(*OPAQUE_FORMATS))
        .select(
            "session_id",
            F.concat(F.col("session_id"), F.lit("/original."), ext).alias("blob_key"),
            F.col("size_bytes"),
            estimated_words("size_bytes").alias("estimated_words"),
            placeholder(ext, "file_name").alias("placeholder"),
        )
    )


def book_totals(counted: DataFrame, *groupings: str) -> DataFrame:
    """Sum of words and documents per book, a book being one value of each grouping column.

    Words are counted once per document before the rows are expanded for the groupings.
    """
    name = F.coalesce(*[F.concat(F.lit(g + ":"), F.col(g)) for g in groupings])
    return (
        counted.groupingSets([[F.col(g)] for g in groupings], *[F.col(g) for g in groupings])
        .agg(F.sum("word_count").alias("words"), F.count("*").alias("documents"))
        .select(name.alias("book_id"), "words", "documents")
    )
