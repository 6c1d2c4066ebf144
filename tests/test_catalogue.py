"""The whole price list: 3 sizes, 4 language counts, 16 add-on sets, 7 voucher states."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal as D
from itertools import combinations, product

from foliospark.operators import pricing, vouchers

WORDS = {"small": 20000, "medium": 65000, "large": 120000}
CODES = (None, "LAUNCH20", "FIRST50", "FRIEND10", "AUTHOR25", "BETA95", "TESTDRIVE")
ADDONS = ("launch-pack", "newsletter", "author-list", "full-promo")
LANGUAGES = ("es", "fr", "de", "pt")


def expected(tier, n, addons, code):
    price = D({"small": 150, "medium": 350, "large": 600}[tier] * n * (100 - (0, 12, 25, 37)[n - 1])) / 100
    cost = {"launch-pack": 49 if n > 1 else 29, "newsletter": 99, "author-list": 149, "full-promo": 249}
    total = price + sum(cost[a] for a in addons)
    percent = {"LAUNCH20": 20, "FRIEND10": 10, "AUTHOR25": 25, "BETA95": 95, "TESTDRIVE": 95}
    off = total * percent[code] / 100 if code in percent else min(D(50), total) if code else D(0)
    two = lambda x: x.quantize(D("0.01"), ROUND_HALF_UP)
    shown = max(total - two(off), D(1)) if code else total
    return two(total), two(off), two(shown), int(two(max(total - off, D(1))) * 100)


def test_all_price_points(spark):
    sets = [c for size in range(5) for c in combinations(ADDONS, size)]
    cases = list(product(WORDS, range(1, 5), sets, CODES))
    assert len(cases) == 1344
    rows = [(i, WORDS[t], list(LANGUAGES[:n]), list(a), c) for i, (t, n, a, c) in enumerate(cases)]
    df = spark.createDataFrame(
        rows, "i int, word_count bigint, languages array<string>, upsells array<string>, voucher_input string"
    )
    out = vouchers.apply_voucher(pricing.quote(df), dt.datetime(2024, 1, 1)).collect()
    assert len(out) == 1344
    for r in out:
        tier, n, addons, code = cases[r.i]
        assert r.tier == tier
        assert (r.total, r.discount_amount, r.shown_total, r.charged_cents) == expected(tier, n, addons, code), cases[r.i]
    # Every discount that ends in half a cent shows one cent less than it charges. Binary floating
    # point would hide some of these rows; exact decimals do not.
    assert sum(r.shown_total * 100 != r.charged_cents for r in out) == 96


def test_limits_and_expiry(spark):
    from foliospark.sources.dimensions import vouchers as voucher_table

    day = lambda n: dt.datetime(2024, 1, n)
    table = voucher_table(spark, [
        ("TWICE", 10, "percent", "", 2, None), ("OLD", 10, "percent", "", None, day(1)), ("FREE", 5, "fixed", "", None, day(9)),
    ])
    rows = [(i, D("100"), c, day(1 + i % 4)) for i, c in enumerate(["TWICE"] * 7 + ["OLD", "FREE", "twice", None])]
    orders = spark.createDataFrame(rows, "order_id int, total decimal(12,2), voucher_input string, created_at timestamp_ntz")
    applied = vouchers.apply_voucher(orders, day(5), vouchers=table)
    out = {r.order_id: r for r in vouchers.enforce_max_uses(applied, table, "order_id", "created_at").collect()}
    used = sorted((rows[i][3], i) for i in out if (rows[i][2] or "").upper() == "TWICE")
    for place, (_, i) in enumerate(used):
        assert out[i].reject_reason == (None if place < 2 else "used_up")
        assert out[i].charged_cents == (9000 if place < 2 else 10000)
    assert out[7].reject_reason == "expired" and out[7].charged_cents == 10000
    assert out[8].voucher_code == "FREE" and out[8].charged_cents == 9500
    assert len(out) == len(rows)
