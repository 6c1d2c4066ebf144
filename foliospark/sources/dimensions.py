"""Constant tables: price tiers, bundles, add-ons, vouchers, languages, markets, formats.

All of them are a handful of rows fixed in this file, so broadcasting them is safe at any scale.
Operators that accept a caller's own table instead leave the join strategy to Spark.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- Fixed values -------------------------------------------------------------------------
# (tier, most words, price per language)
TIERS = (("small", 30000, 150), ("medium", 80000, 350), ("large", 150000, 600))
# Largest book the price list advertises; longer books still get the last tier.
ADVERTISED_LIMIT = 150000
# (languages, percent off); more than four languages get the last discount.
BUNDLES = ((1, 0), (2, 12), (3, 25), (4, 37))
BUNDLE_MAX = 4
# (id, name, price, price with two or more languages)
ADDONS = (
    ("launch-pack", "Launch Strategy Pack", 29, 49),
    ("newsletter", "Newsletter Feature", 99, 99),
    ("author-list", "Author Network Blast", 149, 149),
    ("full-promo", "Full Promo Package", 249, 249),
)
# (code, discount, kind, description, max uses, expiry)
VOUCHERS = (
    ("LAUNCH20", 20, "percent", "20% off launch discount", None, None),
    ("FIRST50", 50, "fixed", "$50 off first order", None, None),
    ("FRIEND10", 10, "percent", "10% friend referral", None, None),
    ("AUTHOR25", 25, "percent", "25% author discount", None, None),
    ("BETA95", 95, "percent", "95% beta tester discount", None, None),
    ("TESTDRIVE", 95, "percent", "95% test discount", None, None),
)
# (code, name, regional setting used in requests, in our own words)
LANGUAGES = (
    ("es", "Spanish", "Spanish as read across Latin America, plain enough for Spain; address readers with tú."),
    ("fr", "French", "Present-day French of France, in short and clear phrases."),
    ("de", "German", "High German with sentences that are easy to follow."),
    ("pt", "Portuguese", "Portuguese as spoken in Brazil, clear to readers in Portugal."),
)
# (code, language, market, store domain)
MARKETS = (
    ("es", "Spanish", "Spain and Latin America", "amazon.es / amazon.com.mx"),
    ("fr", "French", "France and French-speaking countries", "amazon.fr"),
    ("de", "German", "Germany, Austria, and Switzerland", "amazon.de"),
    ("pt", "Portuguese", "Brazil and Portugal", "amazon.com.br"),
)
FORMATS = (("epub", "EPUB"), ("pdf", "PDF"), ("docx", "DOCX"), ("txt", "TXT"))
OPAQUE_FORMATS = ("epub", "pdf")
TEXT_FORMATS = ("txt", "docx")
CHANGE_TYPES = ("style", "dialogue", "cultural", "description", "grammar", "consistency")
# -------------------------------------------------------------------------------------------

LANGUAGE_CODES = tuple(row[0] for row in LANGUAGES)

_VOUCHER_SCHEMA = pa.schema([
    ("code", pa.string()), ("discount", pa.int32()), ("discount_kind", pa.string()),
    ("description", pa.string()), ("max_uses", pa.int64()), ("expires_at", pa.timestamp("us")),
])


def rows_table(spark: SparkSession, rows, names) -> DataFrame:
    """Local relation of a few constant rows, planned without any Python scan."""
    columns = [pa.array(list(values)) for values in zip(*rows)]
    return spark.createDataFrame(pa.table(dict(zip(names, columns))))


def tiers(spark: SparkSession) -> DataFrame:
    return rows_table(spark, TIERS, ("tier", "max_words", "base_price"))


def bundles(spark: SparkSession) -> DataFrame:
    return rows_table(spark, BUNDLES, ("bundle_size", "bundle_percent"))


def addons(spark: SparkSession) -> DataFrame:
    return rows_table(spark, ADDONS, ("addon_id", "addon_name", "price", "price_many"))


def vouchers(spark: SparkSession, rows=VOUCHERS) -> DataFrame:
    """Voucher table; pass ``rows`` of the same shape to test expiry and use limits."""
    columns = [pa.array(list(values), type=field.type) for values, field in zip(zip(*rows), _VOUCHER_SCHEMA)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=_VOUCHER_SCHEMA))


def languages(spark: SparkSession) -> DataFrame:
    return rows_table(spark, LANGUAGES, ("language", "language_name", "language_setting"))


def markets(spark: SparkSession) -> DataFrame:
    return rows_table(spark, MARKETS, ("language", "market_language", "market", "store_domain"))


def constant(df: DataFrame) -> DataFrame:
    """Broadcast hint for a table built from this file."""
    return F.broadcast(df)


def language_name(code):
    """Language name of a code, null when unknown; a folded constant map, so no join is needed."""
    pairs = [F.lit(v) for row in LANGUAGES for v in row[:2]]
    return F.try_element_at(F.create_map(*pairs), code)
