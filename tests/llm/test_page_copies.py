"""Templates of hosts whose pages are mostly copies."""

import random

from foliospark.llm import page_text as m


def test_copies_leave_the_template_alone(spark):
    rnd = random.Random(4)

    def page(i):
        return f"<body><article><p>Posted on our site</p><p>{' '.join(f'w{rnd.randrange(9999)}' for _ in range(30))}</p><p>Read the rules</p></article></body>"

    made = [(i, "http://a.org/", page(i)) for i in range(20)]

    def texts(rows):
        table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
        return {r.page_id: r.text for r in m.extracted(table).collect()}

    alone = texts(made)
    copied = texts(made + [(100 + i, "http://a.org/", made[i % 3][2]) for i in range(200)])
    assert all("site" not in t and "rules" not in t and len(t.split()) == 30 for t in copied.values())
    assert {i: copied[i] for i in alone} == alone and len(copied) == 220
