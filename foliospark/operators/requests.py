"""Model request rows: which languages are still to do, and the text sent for each of them.

Everything is decided on narrow key columns first. The manuscript text joins last, once per order,
and is only then copied per language inside the same task, so it is shuffled a single time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.paragraphs import aligned_windows
from foliospark.functions.text import fallback
from foliospark.sources import dimensions as dims

MAPS, BITS = 2048, 32768  # bitmaps, and the bits that Spark gives each
OPAQUE = tuple("." + f for f in dims.OPAQUE_FORMATS)


@dataclass(frozen=True)
class RequestStyle:
    """How requests are cut and which genre stands in for a missing one.

    A window of None sends the whole text in one request. A number sends the text in consecutive
    windows of that many characters, so a long book becomes several requests and nothing is lost.
    """

    default_genre: str = "general"
    translate_window: int | None = None
    review_window: int | None = None


# The two request styles in use. WINDOWED is for a model with a short context.
WHOLE = RequestStyle()
WINDOWED = RequestStyle("romance", 50000, 25000)


def known_languages() -> Column:
    return F.array(*[F.lit(c) for c in dims.LANGUAGE_CODES])


def originals_per_order(originals: DataFrame) -> DataFrame:
    """Number of original files per order, the id of one, and whether one is kept unread.

    No text is touched, and an order with very many files leaves each task as one row.
    """
    return originals.groupBy("order_id").agg(
        F.count("*").alias("originals"),
        F.max("file_id").alias("original_id"),
        F.max(F.col("file_format").isin(*OPAQUE)).alias("opaque"),
        F.max("has_text").alias("filled"),
    )


def work_per_order(orders: DataFrame, originals: DataFrame, done: DataFrame) -> DataFrame:
    """One row per order with the languages still to do, or the reason nothing can be sent.

    orders: order_id, languages, ...; originals: file_id, order_id, file_format, has_text, content; done:
    order_id, language of finished translations (repeats allowed). All three meet on order_id. A
    ready order carries ``original_id``, the id of its only original file.
    """
    finished = done.groupBy("order_id").agg(F.collect_set("language").alias("_done"))
    joined = orders.join(originals_per_order(originals), "order_id", "left").join(finished, "order_id", "left")
    known = known_languages()
    wanted = F.array_intersect("languages", known)
    unknown = F.array_except("languages", known)
    pending = F.array_except(wanted, F.coalesce("_done", F.array().cast("array<string>")))
    reason = (
        F.when(F.col("originals").isNull(), F.lit("missing_original"))
        .when(F.col("originals") > 1, F.lit("ambiguous_original"))
        .when(F.col("opaque"), F.lit("opaque_source"))
        .when(~F.coalesce("filled", F.lit(False)), F.lit("empty_source"))
        .when(F.coalesce(F.size("languages"), F.lit(0)) == 0, F.lit("no_languages"))
        .when((F.size(wanted) == 0) & (F.size(unknown) > 0), F.lit("unknown_language"))
        .when(F.size(pending) == 0, F.lit("nothing_pending"))
    )
    return (
        joined.withColumn("pending", pending)
        .withColumn("unknown_languages", unknown)
        .withColumn("reason", reason)
        .drop("_done", "originals", "opaque", "filled")
    )


def unknown_languages(work: DataFrame) -> DataFrame:
    """One row per order and language code that no one translates, with its place in the order's list.

    An order may have such codes beside others that are translated, so they are no reason to hold it back.
    """
    each = work.select("order_id", "languages", F.explode("unknown_languages").alias("language"))
    position = F.array_position("languages", F.col("language")).cast("long")
    return each.select("order_id", "language", F.lit("unknown_language").alias("reason"), position.alias("position"))


def _per_language(rows: DataFrame) -> DataFrame:
    exploded = rows.select("*", F.explode("pending").alias("language")).drop("pending", "reason", "unknown_languages")
    return exploded.withColumn("position", F.array_position("languages", F.col("language")).cast("long"))


def pending_languages(work: DataFrame) -> DataFrame:
    """One row per order and language still to do, with its place in the order's language list."""
    return _per_language(work.filter(F.col("reason").isNull()))


def with_text(work: DataFrame, originals: DataFrame) -> DataFrame:
    """Ready orders with their manuscript text; the one wide join.

    It goes by file id, which is unique: the texts of an order that has too many of them spread
    over all tasks and drop out there. Texts that no ready order needs stay where they are, but for chance hits.
    """
    ready = work.filter(F.col("reason").isNull())
    texts = originals.select(F.col("file_id").alias("original_id"), "content")
    return ready.join(marked(texts, ready, "original_id"), "original_id")


def marked(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key's hash is among those of ``keys``, as told by a bitmap of 8 MB whatever the input."""
    bucket = F.pmod(F.xxhash64(key), F.lit(MAPS))
    bit = F.pmod(F.shiftrightunsigned(F.xxhash64(key), 16), F.lit(BITS))
    maps = keys.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", bucket).join(F.broadcast(maps), "_bucket")
    return found.filter(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8).cast("int") + 1)) != 0).drop("_bucket", "_map")


def with_language(rows: DataFrame) -> DataFrame:
    names = dims.languages(rows.sparkSession).select("language", "language_name", "language_setting")
    return rows.join(dims.constant(names), "language", "left")


def pieces(text: Column, size: int) -> Column:
    """Consecutive parts of ``size`` characters, cut in one pass; one empty part for empty text."""
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(parts)


def windows(text: Column, size: int | None) -> Column:
    """Array of (part, text) that covers the whole text in order; one empty part for empty text."""
    if size is None:
        return F.array(F.struct(F.lit(0).alias("part"), text.alias("text")))
    parts = F.coalesce(pieces(text, size), F.array(F.lit(None).cast("string")))
    return F.transform(parts, lambda t, i: F.struct(i.alias("part"), t.alias("text")))


def _slot(label: str, value: Column) -> Column:
    return F.concat(F.lit(label + ": "), F.coalesce(value, F.lit("")))


def translation_text(style: RequestStyle, text: Column) -> Column:
    """Request text of the first pass: role, language, rules, book facts, instructions, manuscript."""
    genre = fallback("genre", style.default_genre)
    instructions = F.when(
        fallback("special_instructions", F.lit(None)).isNotNull(),
        _slot("Instructions from the author", F.col("special_instructions")),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Translate this "), genre, F.lit(" manuscript into "), F.col("language_name"), F.lit(".")),
        _slot("Regional setting", F.col("language_setting")),
        F.lit("Keep paragraphs, blank lines, headings, lists, indentation and markers where they are."),
        F.lit("Keep the author's voice, tone, names and terms; use idioms a native reader would use."),
        _slot("Title", F.col("book_title")),
        _slot("Author", F.col("author_name")),
        _slot("Genre", genre),
        instructions,
        F.lit("Manuscript:"),
        text,
        F.lit("Answer with the translation only."),
    )


def editorial_text(style: RequestStyle, original: Column, translated: Column) -> Column:
    """Request text of the second pass; edits come back as inline marks."""
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("Edit this "), F.col("language_name"), F.lit(" translation of a "),
            fallback("genre", style.default_genre), F.lit(" book so that it reads naturally."),
        ),
        _slot("Regional setting", F.col("language_setting")),
        F.lit("Keep the tone of the original, the formatting and everything that is already right."),
        F.lit("Before each changed phrase put the old one as [[ORIGINAL: old phrase]]."),
        F.lit("Original:"),
        original,
        F.lit("Translation:"),
        translated,
        F.lit("Answer with the full edited translation."),
    )


def editorial_json_text(style: RequestStyle, original: Column, translated: Column) -> Column:
    """Second-pass request whose answer is a JSON object with the edited text and its changes."""
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("Edit this "), F.col("language_name"), F.lit(" translation of a "),
            fallback("genre", style.default_genre), F.lit(" book and explain every change."),
        ),
        F.lit("Original:"),
        original,
        F.lit("Translation:"),
        translated,
        F.lit('Answer with JSON: {"editedText": text, "changes": [{"original", "edited", "reason", "type"}]},'),
        F.lit("type being one of " + ", ".join(dims.CHANGE_TYPES) + "."),
    )


def translation_requests(work: DataFrame, originals: DataFrame, style: RequestStyle = WHOLE) -> DataFrame:
    """First-pass requests: one row per order, language and part."""
    return translation_parts(with_text(work, originals), style)


def translation_parts(texts: DataFrame, style: RequestStyle = WHOLE) -> DataFrame:
    """First-pass requests from rows of ``with_text``, without a shuffle."""
    texts = _per_language(texts)
    cut = texts.withColumn("_windows", windows(F.col("content"), style.translate_window)).withColumn("parts", F.size("_windows").cast("long"))
    parts = cut.drop("content").select("*", F.explode("_windows").alias("_w")).drop("_windows")
    return with_language(parts).select(
        "order_id", "original_id", "language", "position", F.col("_w.part").cast("long").alias("part"), "parts",
        translation_text(style, F.col("_w.text")).alias("request"),
    )


def editorial_requests(
    work: DataFrame, originals: DataFrame, translated: DataFrame, style: RequestStyle = WHOLE
) -> DataFrame:
    """Second-pass requests for finished first passes (original_id, language, translated).

    The manuscript and the translations meet on the original's id alone, which the manuscript is
    already partitioned by, so its text is not shuffled again per language. With a review window,
    the paragraphs of both texts are aligned and the windows are cut between them, so a request holds
    a stretch of the original and its own translation, and all requests together hold both texts.
    """
    return editorial_parts(with_translations(work, originals, translated), style)


def with_translations(work: DataFrame, originals: DataFrame, translated: DataFrame) -> DataFrame:
    """Ready orders with their manuscript text and its translations, so that the text is there once however many those are.

    A group holds the translations of one book, one per language.
    """
    each = translated.groupBy("original_id").agg(F.collect_list(F.struct("language", "translated")).alias("_translations"))
    return with_text(work, originals).join(each, "original_id")


def editorial_parts(both: DataFrame, style: RequestStyle = WHOLE) -> DataFrame:
    """Second-pass requests from rows of ``with_translations``, without a shuffle."""
    pending = F.filter("_translations", lambda t: F.array_contains("pending", t["language"]))
    both = with_language(both.select("*", F.inline(pending)).drop("_translations"))
    if style.review_window is None:
        return both.select(
            "order_id", "language", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("parts"), "translated",
            editorial_text(style, F.col("content"), F.col("translated")).alias("request"),
        )
    places = aligned_windows(F.col("content"), F.col("translated"), style.review_window)
    cut = lambda w, text, side: F.substring(text, w[f"{side}_start"] + 1, w[f"{side}_chars"])
    texts = lambda w, i: F.struct(i.cast("long").alias("part"), cut(w, "content", "a").alias("original"), cut(w, "translated", "b").alias("translated"))
    placed = both.withColumn("_places", places).withColumn("parts", F.size("_places").cast("long")).withColumn("_parts", F.transform("_places", texts))
    each = placed.drop("content", "translated", "_places").select("*", F.inline("_parts")).drop("_parts")
    return each.select(
        "order_id", "language", "part", "parts", "translated",
        editorial_json_text(style, F.col("original"), F.col("translated")).alias("request"),
    )
