"""URL verdicts: rules first, else the ratio of two character language models.

Rules name a host (its subdomains included) and the start of a path; the longest that fits decides. The
URLs that a rule allows or blocks train two variable-order Markov models over characters: counts of
every context of up to ``ORDER`` characters and what follows, over all such URLs. All counts stay in a Spark table;
prediction backs off from the longest seen context to shorter ones by interpolation (Witten-Bell
weights), down to a uniform character. A URL's score is the log-likelihood under the allowed model minus that under the
blocked one, per character. The threshold is calibrated: the score that best separates the two
sorts of training URLs (highest mean of both recalls, lowest such threshold).

Defined cases: a null URL or one without ``://`` has an empty host and path, no rule, and is scored as it
is (null as empty: score zero per character). The host keeps a port or user name. If either model has no URLs, every
score is zero and the verdict allow. Repeated rows get equal answers; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import stored

RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)
ORDER = 5
CHARACTERS = 256  # of the uniform model at the end
BINS = 4_000  # of the calibration, over -RANGE..RANGE
RANGE = 8.0
SALTS = 16  # copies of a gram's score, so that one in every URL is no single task
EDGE = "\x02"  # before a URL, and after it


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z in lower case, and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, start = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + start))
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def counts(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(accepted, context, next, n) over all URLs; each task adds up its own first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for accepted, some in batch.groupby("accepted"):
                seen = Counter()
                for url in some["url"]:
                    text = EDGE * order + url + EDGE
                    for i in range(order, len(text)):
                        for k in range(order + 1):
                            seen[text[i - k : i + 1]] += 1
                grams = list(seen)
                yield pd.DataFrame({"accepted": accepted, "context": [g[:-1] for g in grams], "next": [g[-1] for g in grams], "n": list(seen.values())})

    found = urls.select("accepted", "url").mapInPandas(run, "accepted boolean, context string, next string, n long")
    return found.groupBy("accepted", "context", "next").agg(F.sum("n").alias("n"))


class Model:
    """Next-character probabilities of a small table of counts in memory: what ``gram_scores`` does with joins."""

    def __init__(self, rows):
        self.next: dict[str, dict[str, int]] = {}
        for context, following, n in rows:
            self.next.setdefault(context, {})[following] = n
        self.total = {c: sum(f.values()) for c, f in self.next.items()}
        self.known: dict[tuple[str, str], float] = {}

    def probability(self, context: str, following: str) -> float:
        key = (context, following)
        p = self.known.get(key)
        if p is None:
            shorter = self.probability(context[1:], following) if context else 1 / CHARACTERS
            seen = self.next.get(context)
            if seen is None:
                p = shorter
            else:
                kinds, total = len(seen), self.total[context]
                p = (seen.get(following, 0) + kinds * shorter) / (total + kinds)
            if len(self.known) > 1 << 20:
                self.known.clear()
            self.known[key] = p
        return p

    def mean_log(self, url: str, order: int) -> float:
        text = EDGE * order + url + EDGE
        return sum(log(self.probability(text[i - order : i], text[i])) for i in range(order, len(text))) / (len(url) + 1)


def url_grams(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(k1, k2, gram, n): how often each context of ``order`` characters with its next one stands in a URL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = [Counter(t[i - order : i + 1] for i in range(order, len(t))) for t in (EDGE * order + url + EDGE for url in batch["url"])]
            sizes = [len(c) for c in seen]
            yield pd.DataFrame({
                "k1": np.repeat(batch["k1"].to_numpy(), sizes), "k2": np.repeat(batch["k2"].to_numpy(), sizes),
                "gram": [g for c in seen for g in c], "n": [n for c in seen for n in c.values()],
            })

    return urls.select("k1", "k2", "url").mapInPandas(run, "k1 long, k2 int, gram string, n long")


def gram_scores(counted: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, score): log of the allowed over the blocked probability of each gram's last character after the others.

    Lengths are joined one after another, each with the score of its grams without their first character.
    """
    sides = {"allowed": F.col("accepted"), "blocked": ~F.col("accepted")}
    have = [F.sum(F.when(is_own, F.col("n"))).alias(f"{side}_n") for side, is_own in sides.items()]
    pairs = counted.groupBy(F.concat("context", "next").alias("gram")).agg(*have)
    have = [x for side, own in sides.items() for x in (F.sum(F.when(own, F.col("n"))).alias(f"{side}_total"), F.count(F.when(own, 1)).alias(f"{side}_kinds"))]
    contexts = counted.groupBy("context").agg(*have)
    ends = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda k: F.substring("gram", F.lit(order + 2) - k, k)))
    needed = grams.select(ends.alias("gram")).distinct().select("gram", F.length("gram").alias("size"), F.expr("substring(gram, 1, length(gram) - 1)").alias("context"))
    known = stored(needed.join(pairs, "gram", "left").join(contexts, "context", "left"), "url-grams")
    before = None
    for size in range(1, order + 2):
        rows = known.where(F.col("size") == size).withColumn("end", F.substring("gram", 2, order + 1))
        if before is None:
            rows = rows.select("*", *[F.lit(1 / CHARACTERS).alias(f"{side}_shorter") for side in sides])
        else:
            rows = rows.join(before.select(F.col("gram").alias("end"), *[F.col(side).alias(f"{side}_shorter") for side in sides]), "end")
        p = []
        for side in sides:
            n, total, kinds, shorter = (F.col(f"{side}_{x}") for x in ("n", "total", "kinds", "shorter"))
            p.append(F.when(kinds > 0, (F.coalesce(n, F.lit(0)) + kinds * shorter) / (total + kinds)).otherwise(shorter).alias(side))
        before = rows.select("gram", *p)
    return before.select("gram", (F.log("allowed") - F.log("blocked")).alias("score"))


def scores(urls: DataFrame, known: DataFrame, order: int = ORDER) -> DataFrame:
    """(url, score) of each different URL: log-likelihood difference per character; zero if a side of ``known`` has no URLs."""
    counted = stored(counts(known, order), "url-counts")
    different = stored(urls.select("url").distinct().select("url", F.xxhash64("url").alias("k1"), F.hash("url").alias("k2")), "urls")
    if counted.where("context = ''").select("accepted").distinct().count() < 2:
        return different.select("url", F.lit(0.0).alias("score"))
    grams = url_grams(different.where("url <> ''"), order)
    found = gram_scores(counted, grams.select("gram").distinct(), order)
    found = found.select("gram", "score", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = grams.withColumn("salt", F.pmod("k1", F.lit(SALTS)).cast("int"))
    sums = salted.join(found, ["gram", "salt"]).groupBy("k1", "k2").agg(F.sum(F.col("n") * F.col("score")).alias("total"))
    score = F.coalesce(F.round(F.col("total") / (F.length("url") + 1), 12), F.lit(0.0))
    return stored(different.join(sums, ["k1", "k2"], "left").select("url", score.alias("score")), "url-scores")


def threshold(scores: DataFrame) -> float:
    """The best cut of (accepted, score): from a histogram of at most 2 * BINS counts."""
    at = F.floor((F.least(F.greatest(F.col("score"), F.lit(-RANGE)), F.lit(RANGE)) + RANGE) * (BINS / (2 * RANGE))).cast("int")
    table = np.zeros((2, BINS + 1))
    for accepted, b, n in scores.groupBy("accepted", at.alias("b")).count().collect():
        table[int(accepted), b] = n
    if not table.sum(1).all():
        return 0.0
    blocked_below = np.concatenate([[0], np.cumsum(table[0])[:-1]]) / table[0].sum()
    allowed_from = 1 - np.concatenate([[0], np.cumsum(table[1])[:-1]]) / table[1].sum()
    quality = np.round(blocked_below + allowed_from, 9)
    best = np.flatnonzero(quality == quality.max())
    return float((best[0] + best[-1]) / 2 * (2 * RANGE / BINS) - RANGE)


def judged(pages: DataFrame, rules=RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score, threshold of every row."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", rule(F.col("host"), F.col("path"), rules).alias("by"))
    known = rows.where("by is not null").select((F.col("by.verdict") == "allow").alias("accepted"), "url")
    by_url = scores(rows, known, order)
    cut = threshold(known.join(by_url, "url"))
    scored = rows.join(by_url, "url")
    by_score = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return scored.select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"), F.coalesce(F.col("by.verdict"), by_score).alias("verdict"), "score", F.lit(cut).alias("threshold"),
    )


def op10_urls(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
