"""What came back from the editor: JSON change lists, inline marks, structure, grouped results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.json_text import with_json
from foliospark.functions.marks import spans, without_marks
from foliospark.functions.paragraphs import structure_changes
from foliospark.sources.dimensions import CHANGE_TYPES

CHANGE = "struct<original:string,edited:string,reason:string,type:string>"
EDITORIAL = f"struct<editedText:string,changes:array<{CHANGE}>>"


def parse_editorial(df: DataFrame, answer: str = "answer", translated: str = "translated") -> DataFrame:
    """Add ``edited`` and ``changes``; anything unreadable keeps the translation and no changes."""
    return (
        with_json(df, "_p", answer, EDITORIAL)
        .withColumn("parsed", F.col("_p").isNotNull())
        .withColumn("edited", F.coalesce(F.nullif(F.col("_p.editedText"), F.lit("")), F.col(translated)))
        .withColumn("changes", F.coalesce(F.col("_p.changes"), F.array().cast(f"array<{CHANGE}>")))
        .drop("_p")
    )


def change_counts(parsed: DataFrame, *keys: str) -> DataFrame:
    """Changes per key and type; a type outside the agreed list is counted as not known."""
    each = parsed.select(*keys, F.explode("changes").alias("c"))
    kind = F.coalesce("c.type", F.lit(""))
    return (
        each.groupBy(*keys, kind.alias("change_type"))
        .agg(F.count("*").alias("changes"))
        .withColumn("known_type", F.col("change_type").isin(*CHANGE_TYPES))
    )


def mark_spans(df: DataFrame, text: str) -> DataFrame:
    """Add the marked phrases, their number and their share of the published text."""
    marked = df.withColumn("spans", spans(text)).withColumn("published", without_marks(text))
    old_chars = F.length(F.array_join("spans", ""))
    return (
        marked.withColumn("n_spans", F.size("spans").cast("long"))
        .withColumn("marked_chars", old_chars.cast("long"))
        .withColumn("published_chars", F.length("published").cast("long"))
    )


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def structure(text: Column) -> dict[str, Column]:
    """Counts that a faithful translation keeps."""
    plain = F.replace(text, F.lit("\n"), F.lit(""))
    return {
        "lines": (F.length(text) - F.length(plain) + 1).cast("long"),
        "blank_lines": _count(text, r"(?dm)^[ \t]*$"),
        "list_items": _count(text, r"(?dm)^[ \t]*(?:[-*•]|[0-9]+[.)])[ \t]"),
        "headings": _count(text, r"(?dm)^(?:#{1,6} |Chapter |CHAPTER )"),
    }


def structure_check(df: DataFrame, original: str, translated: str) -> DataFrame:
    """Line, blank-line, list-item and heading counts of both texts and whether they agree."""
    before, after = structure(F.col(original)), structure(F.col(translated))
    out = df
    for name in before:
        out = out.withColumn(f"{name}_before", before[name]).withColumn(f"{name}_after", after[name])
    same = F.lit(True)
    for name in before:
        same = same & (F.col(f"{name}_before") == F.col(f"{name}_after"))
    return out.withColumn("preserved", same)


def structure_losses(df: DataFrame, original: str, translated: str, *keys: str) -> DataFrame:
    """One row per difference in structure: keys, change, kind, place in the original, place in the translation.

    The paragraphs of both texts are aligned by kind and length, so the row says which one was lost, split or
    merged; ``structure_check`` only tells that the counts differ.
    """
    each = df.select(*keys, structure_changes(F.col(original), F.col(translated)).alias("_changes"))
    return each.select(*keys, F.inline("_changes"))


def results_by_order(files: DataFrame, value: str = "file_id") -> DataFrame:
    """Map language -> latest result per order.

    Repeated rows are folded per (order, language) first, so the list collected per order is at
    most as long as the order has languages.
    """
    latest = files.groupBy("order_id", "language").agg(
        F.max_by(value, F.struct("created_at", "file_id")).alias(value), F.count("*").alias("copies")
    )
    entry = F.struct(F.col("language"), F.struct(F.col(value), F.col("copies")).alias("result"))
    return latest.groupBy("order_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("results"))
