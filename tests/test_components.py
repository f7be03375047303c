import random

import pyarrow as pa
import pytest

from sessionloom.operators import components as module
from sessionloom.operators.components import components


@pytest.mark.parametrize(("parts", "n"), [(1, 40), (4, 40), (4, 200)])
def test_components(spark, parts, n):
    rng = random.Random(n + parts)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2060)] + [(None, 3)]
    root = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    while any(root[a] != root[b] for a, b in edges if a in root and b in root):
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "a long, b long").repartition(parts)
    assert {r.node: r.root for r in components(df).collect()} == root
    assert components(df.limit(0)).count() == 0


def test_a_task_holds_no_more_than_its_forest(monkeypatch):
    monkeypatch.setattr(module, "HELD", 6)
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges[i : i + 4]], pa.int64()), pa.array([b for _, b in edges[i : i + 4]], pa.int64())], ["a", "b"]) for i in range(0, 50, 4)]
    (out,) = module._forest(batches)
    root = dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    up = lambda x: up(root[x]) if x in root else x
    least = {x: x for e in edges for x in e}
    while any(least[a] != least[b] for a, b in edges):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {x: up(x) for x in least} == least and all(r < n for n, r in root.items())
