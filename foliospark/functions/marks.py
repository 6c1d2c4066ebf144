"""Inline editorial marks: ``[[ORIGINAL: old phrase]]new phrase``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import col

# Fixed value: the mark format.
MARK = r"(?s)\[\[ORIGINAL: (.*?)\]\]"
MARK_OPEN = "[[ORIGINAL: "
MARK_CLOSE = "]]"


def spans(text: Column | str) -> Column:
    """Array of the old phrases, in text order."""
    return F.regexp_extract_all(col(text), F.lit(MARK), 1)


def without_marks(text: Column | str) -> Column:
    """The text to publish: every mark removed, the new phrases kept."""
    return F.regexp_replace(col(text), MARK, "")
