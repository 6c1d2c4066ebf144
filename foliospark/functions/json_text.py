"""Strict JSON parsing: one complete value, nothing after it, no quoting extensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.text import col, trim_all

_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
_END, _BROKEN = "end_of_text_mark", "broken_text"


def with_json(df: DataFrame, name: str, text: Column | str, ddl: str) -> DataFrame:
    """Add ``name``: ``text`` parsed as exactly one value of type ``ddl``, null when it is not.

    The built-in parser is lenient in two ways: it stops after the first value, and it skips a
    field it cannot read, even one with a syntax error, as if only its type were wrong. So a first
    pass checks the text alone, reading no field of an object. The value is put between an opening
    array and an end mark: two values give an array of two, trailing text hides the mark, and a
    syntax error fills the broken-text column. The second pass reads the fields; a field of another
    type is null.

    The one-item explodes are fences: without them the optimizer copies the parser into every
    expression and pushed-down filter that uses the result, and each copy parses the text again.
    """
    raw, held = f"_{name}", f"_{name}_text"
    df = df.withColumn(held, col(text))  # used three times below, computed once
    text = F.col(held)
    wrapped = F.concat(F.lit('{"v":['), text, F.lit(f'],"{_END}":true}}'))
    opening, shape = ("[", "array<string>") if ddl.startswith("array") else ("{", "struct<no_such_field:string>")
    check = F.from_json(
        wrapped, f"struct<v:array<{shape}>,{_END}:boolean,{_BROKEN}:string>",
        {**_OPTIONS, "columnNameOfCorruptRecord": _BROKEN},
    )
    checked = df.select("*", F.explode(F.array(check)).alias(raw))
    whole = (
        F.col(raw)[_END]
        & (F.size(F.col(raw)["v"]) == 1)
        & F.col(raw)[_BROKEN].isNull()
        & F.startswith(F.ltrim(text, F.lit(" \t\r\n")), F.lit(opening))
    )
    value = F.from_json(F.when(whole, text), ddl, _OPTIONS)
    return checked.select("*", F.explode(F.array(value)).alias(name)).drop(raw, held)


def strip_fences(text: Column | str) -> Column:
    """Remove code-fence marks around (or inside) a model answer, then trim."""
    bare = F.regexp_replace(col(text), "```json\n?", "")
    return trim_all(F.regexp_replace(bare, "```\n?", ""))
