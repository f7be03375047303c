import random

import pytest

from sessionloom.operators.runs import running_totals


@pytest.mark.parametrize("parts", [1, 3, 9])
def test_totals_over_keys_that_span_stretches(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i, rng.choice([None, 1, 2, 5])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v long")
    got = {r.i: (r.before, r.rank) for r in running_totals(df, ["k"], ["i"], {"before": "v", "rank": "1"}, parts).collect()}
    seen: dict = {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        total, n = seen.get(k, (0, 0))
        assert got[i] == (total, n)
        seen[k] = (total + (v or 0), n + 1)


def test_empty(spark):
    assert running_totals(spark.createDataFrame([], "k string, i int, v long"), ["k"], ["i"], {"b": "v"}).count() == 0
