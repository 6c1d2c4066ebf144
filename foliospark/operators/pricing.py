"""Size tiers, bundle prices, add-ons and order quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.money import MONEY, lit_money, rounded
from foliospark.functions.text import col
from foliospark.sources import dimensions as dims


def tier_of(words: Column | str) -> Column:
    """Tier name of a word count; the last tier has no upper bound."""
    words = col(words)
    chosen = F.when(words.isNull(), F.lit(None).cast("string"))
    for name, limit, _ in dims.TIERS[:-1]:
        chosen = chosen.when(words <= limit, F.lit(name))
    return chosen.otherwise(F.lit(dims.TIERS[-1][0]))


def over_limit(words: Column | str) -> Column:
    return col(words) > dims.ADVERTISED_LIMIT


def assign_tier_by_bands(df: DataFrame, words: str, tiers=dims.TIERS, width: int = 10000) -> DataFrame:
    """Range lookup of the tier as an equi-join, for price lists longer than a ``when`` chain.

    Each tier is cut into bands of ``width`` words; a row joins its own band and then checks the
    exact bounds, so Spark plans a hash join instead of comparing every row with every tier.
    """
    rows, lower = [], -1
    for name, upper, base in tiers:
        last = name == tiers[-1][0]
        for band in range(max(lower, 0) // width, upper // width + 1):
            rows.append((band, name, base, lower, None if last else upper))
        lower = upper
    bands = dims.rows_table(df.sparkSession, rows, ("band", "tier", "base_price", "above", "up_to"))
    top = tiers[-1][1] // width
    band = F.least(F.floor(F.col(words) / width), F.lit(top)).cast("bigint")
    inside = (F.col(words) > F.col("above")) & (F.col("up_to").isNull() | (F.col(words) <= F.col("up_to")))
    keyed = df.withColumn("band", band).alias("d")
    return (
        keyed.join(dims.constant(bands).alias("b"), (F.col("d.band") == F.col("b.band")) & inside, "left")
        .drop("band", "above", "up_to")
    )


def language_count(languages: Column | str) -> Column:
    return F.coalesce(F.size(col(languages)), F.lit(0))


def addon_total(upsells: Column | str, languages: Column | str) -> Column:
    """Price of all add-ons of one order, straight from its array.

    An id that occurs twice is charged twice and an unknown id costs nothing. Occurrences are
    counted as the items that removing the id takes away, so there is no explode and no shuffle.
    """
    upsells, several = col(upsells), language_count(languages) > 1
    total = lit_money(0)
    for addon_id, _, price, price_many in dims.ADDONS:
        times = F.size(upsells) - F.size(F.array_remove(upsells, addon_id))
        total = total + F.coalesce(times, F.lit(0)) * F.when(several, price_many).otherwise(price)
    return total.cast(MONEY)


def addon_sales(orders: DataFrame) -> DataFrame:
    """Units and revenue per add-on. Few distinct ids, so the map-side sums do nearly all the work."""
    sold = orders.select(
        F.explode("upsells").alias("addon_id"), (language_count("languages") > 1).alias("several")
    )
    priced = sold.join(dims.constant(dims.addons(orders.sparkSession)), "addon_id", "left")
    price = F.coalesce(F.when(F.col("several"), F.col("price_many")).otherwise(F.col("price")), F.lit(0))
    return priced.groupBy("addon_id", "addon_name").agg(
        F.count("*").alias("units"), F.sum(price).alias("revenue")
    )


def quote(orders: DataFrame, words: str = "word_count") -> DataFrame:
    """Add tier, bundle discount, translation price, add-on total and grand total.

    Prices come from the tier and bundle tables by broadcast joins; the row count never changes
    and nothing is shuffled. Without a tier or a language the translation price is 0.00.
    """
    spark = orders.sparkSession
    sized = (
        orders.withColumn("tier", tier_of(words))
        .withColumn("n_languages", language_count("languages").cast("long"))
        .withColumn("bundle_size", F.least(F.col("n_languages"), F.lit(dims.BUNDLE_MAX)))
    )
    priced = sized.join(
        dims.constant(dims.tiers(spark).select("tier", "base_price")), "tier", "left"
    ).join(dims.constant(dims.bundles(spark)), "bundle_size", "left")
    list_price = (F.col("base_price") * F.col("n_languages")).cast(MONEY)
    kept = (F.lit(100) - F.col("bundle_percent")).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")
    return (
        priced.withColumn("list_price", F.coalesce(list_price, lit_money(0)))
        .withColumn("translation_price", F.coalesce(rounded(list_price * kept), lit_money(0)))
        .withColumn("addon_total", addon_total("upsells", "languages"))
        .withColumn("total", (F.col("translation_price") + F.col("addon_total")).cast(MONEY))
        .drop("bundle_size", "base_price")
    )


def bundle_savings(quoted: DataFrame) -> DataFrame:
    """What the bundle discount gave away, per number of languages."""
    return quoted.groupBy("n_languages").agg(
        F.count("*").alias("orders"),
        F.sum("list_price").alias("list_total"),
        F.sum("translation_price").alias("price_total"),
        F.sum(F.col("list_price") - F.col("translation_price")).alias("saved"),
    )


def price_points(charged: DataFrame) -> DataFrame:
    """Every distinct price the orders hit: tier, languages, add-ons and voucher with their counts."""
    return charged.groupBy("tier", "n_languages", "addon_total", "voucher_code").agg(
        F.count("*").alias("orders"),
        F.min("total").alias("total"),
        F.min("charged_cents").alias("charged_cents"),
        F.sum("charged_cents").alias("revenue_cents"),
    )
