"""Mixing to target weights: soft domain membership, then nonnegative rates by projected gradients.

Everything here is DataFrame functions. Domains are the label pairs (quality, toxic). A multinomial
naive Bayes model on hashed words, learnt from at most ``SAMPLE`` labelled rows (those with the
smallest hash of the id), gives each document a posterior over the domains. Its evidence is the mean
over the words, counted as at most ``EVIDENCE`` words, so long documents keep soft memberships.
Three shares of the whole text (signs, capitals, different words) come in as words, too.

Rates r >= 0 minimise sum_d (A_d - T_d)^2 / (2 s_d) + LAMBDA / 2 * sum_i n_i (r_i - 1)^2, where n_i are a
document's tokens, A_d = sum_i n_i p_id r_i its expected domain tokens, T_d the targets and s_d the
tokens a domain has, all as shares of the total. The gradient of a document needs only its own
posterior and the residuals A - T, one number per domain. So an iteration is one aggregation over the
documents; the rates follow row by row from the residuals so far and are never shuffled or collected.

Defined cases: null, empty and white-space texts have no tokens and the prior as posterior; their rate
follows the same rule. Labels other than 0 and 1 or null are left out; without labels the posterior
is uniform. A document labelled twice is learnt twice. Repeated rows get equal answers. Empty
tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm import common
from foliospark.llm.common import stored

DOMAINS = ("low", "low_toxic", "good", "good_toxic")  # 2 * quality + toxic
TARGETS = {"low": 0.05, "low_toxic": 0.0, "good": 0.9, "good_toxic": 0.05}  # shares of BUDGET
BUDGET = 1.0  # expected tokens, as a share of the tokens there are
SAMPLE = 20_000
BUCKETS = 4_096
EVIDENCE = 60
SHARE = 16  # each share of the text counts as one word in so many
LAMBDA = 0.01
STEPS = 20
TOLERANCE = 1e-5
LEAST = 1e-3  # smallest share by which a residual is scaled


def words(text: Column) -> Column:
    """The words in lower case: what stands between spaces, tabs and line ends. None for null."""
    text = F.lower(F.coalesce(text, F.lit("")))
    for blank in "\n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.filter(F.split(text, " "), lambda w: w != "")


def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def features(rows: DataFrame, *keep: str) -> DataFrame:
    """Kept columns, the buckets of the words, those of the three shares, and how often a share counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    hashed = rows.select(
        *keep, F.transform(words(F.col("text")), bucket).alias("buckets"),
        (F.length(F.regexp_replace(text, r"[\p{L}\s\p{N}]+", "")) / length).alias("signs"), (F.length(F.regexp_replace(text, r"\P{Lu}+", "")) / length).alias("capitals"),
    )
    different = F.size(F.array_distinct("buckets")) / F.greatest(F.size("buckets"), F.lit(1))
    shares = (("signs", F.col("signs")), ("capitals", F.col("capitals")), ("different", different))
    return hashed.select(
        *keep, "buckets", F.array(*[bucket(F.concat(F.lit(f"\x01{name}"), F.floor(part * 20).cast("string"))) for name, part in shares]).alias("shares"),
        (F.size("buckets") / SHARE + 1).cast("int").alias("times"),
    )


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and domain of at most ``sample`` rows."""
    pairs = labels.where(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    pairs = pairs.select("doc_id", (F.col("quality") * 2 + F.col("toxic")).cast("int").alias("domain")).distinct()
    return pairs.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)


def model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[list[float]], list[float]]:
    """Log probabilities [domain][bucket], BUCKETS of them for each domain, and log priors."""
    known = labelled(labels, sample)
    rows = features(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"), "domain")
    every = F.concat("buckets", F.flatten(F.array_repeat("shares", F.col("times"))))
    counts = rows.select("domain", F.explode(every).alias("bucket")).groupBy("domain", "bucket").agg(F.count("*").alias("n")).collect()
    table = [[1] * BUCKETS for _ in DOMAINS]  # one more than there are
    for domain, at, n in counts:
        table[domain][at] += n
    rows = {r[0]: r[1] for r in known.groupBy("domain").agg(F.count("*")).collect()}
    seen = sum(rows.values()) + len(DOMAINS)
    return [[math.log(n / sum(t)) for n in t] for t in table], [math.log((rows.get(d, 0) + 1) / seen) for d in range(len(DOMAINS))]


def constants(values: list[float]) -> Column:
    """An array of numbers as one constant; a literal for each would take the driver seconds."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def memberships(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens and the posterior p0, p1, ... No shuffle."""
    table, prior = model(docs, labels, sample)
    every = range(len(DOMAINS))

    def evidence(d: int) -> Column:
        # Against the first domain, whose evidence is zero, so one sum less.
        weights = constants([x - y for x, y in zip(table[d], table[0])])
        of_words = F.aggregate("buckets", F.lit(0.0), lambda total, b: total + F.get(weights, b))
        return of_words + F.aggregate("shares", F.lit(0.0), lambda total, b: total + F.get(weights, b)) * F.col("times")

    found = features(docs, "doc_id")
    n = F.size("buckets") + 3 * F.col("times")
    scale = F.when(F.size("buckets") == 0, 0).otherwise(F.least(n, F.lit(EVIDENCE))) / n
    scores = [F.lit(prior[0])] + [evidence(d) * scale + prior[d] for d in every[1:]]
    sums = found.select("doc_id", F.size("buckets").cast("long").alias("tokens"), *[s.alias(f"s{d}") for d, s in zip(every, scores)])
    top = F.greatest(*[f"s{d}" for d in every])
    raised = sums.select("doc_id", "tokens", *[F.exp(F.col(f"s{d}") - top).alias(f"e{d}") for d in every])
    total = sum(F.col(f"e{d}") for d in every)
    return raised.select("doc_id", "tokens", *[(F.col(f"e{d}") / total).alias(f"p{d}") for d in every])


def rate(residuals: list[list[float]], step: float) -> Column:
    """A document's rate after one projected step for each vector of scaled residuals."""
    r = F.lit(1.0)
    for residual in residuals:
        pull = sum(F.col(f"p{d}") * F.lit(step * x) for d, x in enumerate(residual))
        r = F.greatest(F.lit(0.0), r * F.lit(1 - step * LAMBDA) + F.lit(step * LAMBDA) - pull)
    return r


def fitted(members: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> Column:
    """The rate as an expression over a membership row."""
    every = range(len(DOMAINS))
    weight = F.col("tokens")
    first = members.agg(F.sum(weight), *[F.sum(weight * F.col(f"p{d}")) for d in every]).first()
    total = float(first[0] or 0)
    if not total:
        return F.lit(1.0)
    share = [max(float(x) / total, LEAST) for x in first[1:]]
    wanted = [targets[name] * budget for name in DOMAINS]
    step, past = 1 / (1 + LAMBDA), []
    have = [float(x) / total for x in first[1:]]
    for _ in range(STEPS):
        past.append([(a - t) / s for a, t, s in zip(have, wanted, share)])
        now = members.select(weight.alias("w"), rate(past, step).alias("r"), *[f"p{d}" for d in every])
        got = now.agg(*[F.sum(F.col("w") * F.col("r") * F.col(f"p{d}")) for d in every]).first()
        moved = max(abs(float(x) / total - a) for x, a in zip(got, have))
        have = [float(x) / total for x in got]
        if moved < TOLERANCE:
            break
    return rate(past, step)


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float = BUDGET) -> DataFrame:
    """One row per row of ``docs``: doc_id, tokens, the posterior by domain, and ``rate``, the expected uses."""
    members = stored(memberships(docs.select("doc_id", "text"), labels), "memberships")
    return members.select("doc_id", "tokens", *[F.col(f"p{d}").alias(f"p_{name}") for d, name in enumerate(DOMAINS)], fitted(members, targets, budget).alias("rate"))


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the rate at which each document is used."""
    return mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
