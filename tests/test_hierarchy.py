import random

import pytest

from sessionloom.operators import hierarchy as hierarchy_module
from sessionloom.operators.hierarchy import descendants, hierarchy

SCHEMA = "node_id string, parent_id string"


def brute(links):
    out = {}
    for n in links:
        seen, at = [n], n
        while links.get(at) in links and links[at] not in seen:
            at = links[at]
            seen.append(at)
        nxt = links.get(at)
        if nxt in links:
            out[n] = ("cycle", -1, min(seen[seen.index(nxt):]), None)
        else:
            out[n] = (at, len(seen) - 1, None, seen[::-1])
    return out


def solved(spark, links, **more):
    rows = hierarchy(spark.createDataFrame(list(links.items()), SCHEMA), **more).collect()
    return {r.node_id: (r.root_id, r.depth, r.loop_id, r.path) for r in rows}


@pytest.mark.parametrize(("size", "last", "seed"), [(1000, 1000, 1), (15, 5, 2), (15, 1, 3), (6, 6, 4), (1000, 3, 5)])
def test_random_forests_at_any_fragment_size(spark, size, last, seed):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(70)]
    links = {n: rng.choice([None, "gone", *ids, *ids[:3], *ids]) for n in ids}
    for i in range(20, 45):  # a long chain, so that fragments must be crossed
        links[ids[i]] = ids[i - 1]
    assert solved(spark, links, fragment_rows=size, quotient_rows=last) == brute(links)


def test_one_parent_of_all_and_long_loop(spark):
    links = {f"c{i}": "hub" for i in range(40)} | {"hub": None} | {f"l{i:02d}": f"l{(i + 1) % 30:02d}" for i in range(30)} | {"tail": "l07"}
    assert solved(spark, links, fragment_rows=8, quotient_rows=4) == brute(links)


def test_nulls_repeats_empty_and_extra_columns(spark):
    t = spark.createDataFrame([("a", None, 1), ("a", "b", 2), ("b", None, 3), (None, "b", 4), ("c", "zz", 5), ("s", "s", 6)], SCHEMA + ", path int")
    rows = {r.node_id: r for r in hierarchy(t).collect()}
    assert set(rows) == {"a", "b", "c", "s"}
    assert (rows["a"].root_id, rows["a"].depth, rows["a"].path) == ("b", 1, ["b", "a"])
    assert (rows["c"].root_id, rows["c"].depth, rows["c"].dangling) == ("c", 0, True)
    assert (rows["s"].root_id, rows["s"].loop_id) == ("cycle", "s")
    assert hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0


def test_descendants(spark):
    t = hierarchy(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x")], SCHEMA))
    assert sorted(map(tuple, descendants(t).collect())) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]


def test_fragments_and_a_quotient_at_production_settings(spark, monkeypatch):
    levels = []
    contract = hierarchy_module._contract
    monkeypatch.setattr(hierarchy_module, "_contract", lambda paths: levels.append(1) or contract(paths))
    links = {f"n{i:02d}": f"n{(i * 7 + 3) % 60:02d}" if i else None for i in range(60)}
    assert solved(spark, links) == brute(links)
    assert len(levels) >= 2
