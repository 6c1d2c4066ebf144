"""Random texts against Python's own parser and plain loops."""

import json
import random

from foliospark.functions.json_text import with_json
from foliospark.functions.text import WHITESPACE, trim_all, word_count

NOISE = "{}[],:\"' \n0e-.tnx\\/*#"


def value(rng, depth=0):
    kind = rng.randrange(8)
    if kind == 0:
        return rng.choice([0, 1, -5, 3.5, 1e10, 123456789012])
    if kind == 1:
        return rng.choice([True, False, None])
    if kind == 2 and depth < 3:
        return [value(rng, depth + 1) for _ in range(rng.randrange(3))]
    if kind == 3 and depth < 3:
        return {rng.choice("abc"): value(rng, depth + 1) for _ in range(rng.randrange(3))}
    return "".join(rng.choice('ab "\\\n]}{[:,é') for _ in range(rng.randrange(6)))


def damaged(rng, text):
    for _ in range(rng.choice([0, 1, 1, 2])):
        at, kind = rng.randrange(len(text) + 1), rng.randrange(3)
        middle = "" if kind == 0 else rng.choice(NOISE) if kind == 1 else text[at : at + rng.randrange(5)]
        text = text[:at] + middle + text[at + (kind == 0) :]
    return text


def refuse(_):
    raise ValueError


def loaded(text):
    try:
        return json.loads(text, parse_constant=refuse)
    except ValueError:
        return None


def test_json_like_a_strict_parser(spark):
    rng = random.Random(11)
    texts = set()
    for _ in range(12000):
        whole = {rng.choice("abc"): value(rng) for _ in range(rng.randrange(1, 4))} if rng.random() < 0.9 else value(rng)
        texts.add(damaged(rng, json.dumps(whole, ensure_ascii=rng.random() < 0.5)))
    texts = sorted(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(8)
    objects = {r.i: r.p for r in with_json(df, "p", "t", "struct<a:string,b:string,c:array<string>>").collect()}
    lists = {r.i: r.p for r in with_json(df, "p", "t", "array<string>").collect()}
    good = 0
    for i, text in enumerate(texts):
        want = loaded(text)
        assert (objects[i] is not None) == isinstance(want, dict), text
        assert (lists[i] is not None) == isinstance(want, list), text
        if isinstance(want, dict):
            good += 1
            for field in "ab":
                if isinstance(want.get(field), str):
                    assert objects[i][field] == want[field], text
            assert (objects[i].c is None) == (not isinstance(want.get("c"), list)), text
    assert good > 3000


def test_words_and_trim(spark):
    rng = random.Random(12)
    alphabet = "ab\u0085é​" + WHITESPACE
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(12))) for _ in range(8000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", word_count("t").alias("n"), trim_all("t").alias("x")).collect():
        blank = "".join(" " if c in WHITESPACE else c for c in r.t)
        assert r.n == len([w for w in blank.split(" ") if w]) and r.x == r.t.strip(WHITESPACE)
