"""URL scores from joined counts against the model in memory, contexts seen once included."""

from math import isclose

from foliospark.llm import url_filter as m


def test_scores_use_every_context(spark):
    made = [(i, f"http://h{i % 7}.{'org' if i % 2 else 'com/de'}/{chr(97 + i % 26)}{i * i}é") for i in range(120)] + [(500, "http://new.net/Ünseen"), (501, ""), (502, "http://new.net/Ünseen")]
    rows = {r.page_id: r for r in m.judged(spark.createDataFrame(made, "page_id long, url string").repartition(3)).collect()}
    known = [(rows[i].verdict == "allow", u) for i, u in made if rows[i].rule]
    counted = m.counts(spark.createDataFrame(known, "accepted boolean, url string")).collect()
    pair = [m.Model([(r.context, r.next, r.n) for r in counted if r.accepted == side]) for side in (True, False)]
    assert len(rows) == len(made) and any(n == 1 for n in pair[0].total.values())
    for i, u in made:
        want = pair[0].mean_log(u, m.ORDER) - pair[1].mean_log(u, m.ORDER) if u else 0.0
        assert isclose(rows[i].score, want, abs_tol=1e-9), u
