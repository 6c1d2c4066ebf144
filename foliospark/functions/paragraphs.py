"""Paragraphs of a text and of its translation, side by side.

A paragraph is a line with the line breaks after it, so a text is exactly the paragraphs that it is cut into. Only
lengths and kinds go to Python for the alignment; the texts stay where they are and are cut by the places that come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.alignment import Bead, align

UNIT = r"[^\n]*\n+|[^\n]+"
# What a paragraph is, by its first characters.
KINDS = {"heading": r"^(?:#{1,6} |Chapter |CHAPTER )", "list item": r"^[ \t]*(?:[-*•]|[0-9]+[.)])[ \t]"}
PARAGRAPH = "paragraph"
NAMES = (PARAGRAPH, *KINDS)
WINDOW = "struct<a_start:int,a_chars:int,b_start:int,b_chars:int>"
CHANGE = "struct<change:string,kind:string,place:int,place_after:int>"


def units(text: Column) -> Column:
    """Per paragraph: all characters, characters without the line breaks, number of the kind. None for no text."""
    kind = lambda u: F.when(u.rlike(KINDS["heading"]), 1).when(u.rlike(KINDS["list item"]), 2).otherwise(0)
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0))
    return F.transform(found, lambda u: F.struct(F.length(u).alias("all"), F.length(F.rtrim(u, F.lit("\n"))).alias("bare"), kind(u).alias("kind")))


def shares(first: int, chars: int, k: int) -> list[tuple[int, int]]:
    """``k`` even parts of a stretch, as (start, chars)."""
    cuts = [chars * i // k for i in range(k + 1)]
    return [(first + x, y - x) for x, y in zip(cuts, cuts[1:])]


def windows_of(beads: list[Bead], a: list[int], b: list[int], size: int) -> Iterator[dict]:
    """Consecutive beads with at most ``size`` characters on either side; a larger bead is dealt out in even parts of both.

    Together the windows are both texts; there is one at least.
    """
    at_a = at_b = have_a = have_b = 0
    given = False

    def window(a_start: int, a_chars: int, b_start: int, b_chars: int) -> dict:
        return {"a_start": a_start, "a_chars": a_chars, "b_start": b_start, "b_chars": b_chars}

    for i0, i1, j0, j1 in beads:
        new_a, new_b = sum(a[i0:i1]), sum(b[j0:j1])
        if (have_a or have_b) and (have_a + new_a > size or have_b + new_b > size):
            yield window(at_a, have_a, at_b, have_b)
            at_a, at_b, have_a, have_b, given = at_a + have_a, at_b + have_b, 0, 0, True
        have_a, have_b = have_a + new_a, have_b + new_b
        k = -(-max(new_a, new_b) // size)
        if k > 1:
            for (x, n), (y, m) in zip(shares(at_a, have_a, k), shares(at_b, have_b, k)):
                yield window(x, n, y, m)
            at_a, at_b, have_a, have_b, given = at_a + have_a, at_b + have_b, 0, 0, True
    if have_a or have_b or not given:
        yield window(at_a, have_a, at_b, have_b)


def fields(rows, name: str) -> list[int]:
    return [int(r[name]) for r in rows]


def aligned_windows(original: Column, translated: Column, size: int) -> Column:
    """Places of the windows of both texts: array of (a_start, a_chars, b_start, b_chars), starts from 0."""

    @F.pandas_udf(f"array<{WINDOW}>")
    def cut(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            beads = align(fields(x, "bare"), fields(x, "kind"), fields(y, "bare"), fields(y, "kind"))
            out.append(list(windows_of(beads, fields(x, "all"), fields(y, "all"), size)))
        return pd.Series(out)

    return cut(units(original), units(translated))


def changes_of(a, b) -> Iterator[dict]:
    """What became of the paragraphs (all, bare, kind) of a text in another one, in order."""
    breaks = lambda u: int(u["all"]) - int(u["bare"])
    for i0, i1, j0, j1 in align(fields(a, "bare"), fields(a, "kind"), fields(b, "bare"), fields(b, "kind")):
        here = {"place": i0 + 1, "place_after": j0 + 1}
        if i0 == i1:
            yield here | {"change": "added", "kind": NAMES[int(b[j0]["kind"])], "place": i0}
            continue
        here["kind"] = NAMES[int(a[i0]["kind"])]
        if j0 == j1:
            yield here | {"change": "lost", "place_after": j0}
            continue
        if i1 - i0 > 1 or j1 - j0 > 1:
            yield here | {"change": "merged" if i1 - i0 > 1 else "split"}
        elif a[i0]["kind"] != b[j0]["kind"]:
            yield here | {"change": "retyped"}
        # Blank lines after it; the last paragraph of a text may end without any break.
        before, after = max(0, breaks(a[i1 - 1]) - 1), max(0, breaks(b[j1 - 1]) - 1)
        if before != after:
            yield here | {"change": "blank lines lost" if after < before else "blank lines added"}


def structure_changes(original: Column, translated: Column) -> Column:
    """Array of (change, kind, place, place_after): each paragraph, heading or list item that was lost, added, split,
    merged or became another kind, and lost or added blank lines after one. Places count paragraphs from 1;
    one that was lost or added stands behind the named place of the other text."""

    @F.pandas_udf(f"array<{CHANGE}>")
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([list(changes_of(x, y)) for x, y in zip(a, b)])

    return compare(units(original), units(translated))
