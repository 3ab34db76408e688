import random

import numpy as np

from tariffloom.operators.retrieval import nearest


def test_more_than_ten_thousand_queries(spark):
    rng = random.Random(3)
    vector = lambda: [rng.randrange(-9, 10) / 4 for _ in range(3)]
    rows = [(i, vector()) for i in range(60)]
    asked = [(1000 + i, vector()) for i in range(10_050)]
    found = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(asked, "query_id long, embedding array<double>"), 3, block=2)
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r.place, r.vec_id, r.score))
    score = np.round(np.array([v for _, v in asked]) @ np.array([v for _, v in rows]).T, 6)
    assert len(got) == len(asked)
    for (q, _), s in zip(asked, score, strict=True):
        best = sorted(range(60), key=lambda i: (-s[i], i))[:3]
        assert sorted(got[q]) == [(p + 1, i, s[i]) for p, i in enumerate(best)]


def test_no_queries_or_no_rows(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    for rows, asked in ((some, some.limit(0)), (some.limit(0), some)):
        assert nearest(rows.withColumnRenamed("id", "vec_id"), asked.withColumnRenamed("id", "query_id"), 2).collect() == []
