import base64

import numpy as np
import pytest

from sessionloom.llm.mixing import mixture, plan
from sessionloom.llm.packing import pack
from sessionloom.llm.tokens import TOKENIZER, measure


def plain_count(text):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return len(tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text))


@pytest.mark.parametrize("text", ["a  b", "a \n\n  b\n", "\n\n\n", " x", "tab\t\tx  　y", "重试  同步\n\n## T1 [10:00] User {#m}\n\nhi", "it's  we'll\n \n x"])
def test_cut_counts_are_those_of_the_public_pattern(text):
    assert measure(text)[0] == plain_count(text)


def test_turns():
    text = "head\n\n## T1 [10:00] User {#a}\n\nhello there\n\n## T2 [10:01] Assistant {#b}\n\nyes it is"
    tokens, segments, loss = measure(text)
    assert segments == 3 and 0 < loss < tokens and tokens == plain_count(text)
    assert measure(None) == measure("") == (0, 0, 0)


def test_packing_keeps_all_tokens_and_limits(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(t), int(1 + t // 40), int(t * rng.random())) for i, t in enumerate(rng.integers(0, 900, 400))] + [(7, 50, 1, 50), (None, 9, 1, 9), (900, 5, 300, 5)]
    packed = pack(spark.createDataFrame(rows, "doc_id long, tokens long, segments long, loss long"), [("a", 256), ("b", 1000)], group_items=128, density=(1 / 8, 0.8)).toPandas()
    for name, capacity in (("a", 256), ("b", 1000)):
        p = packed[packed.pack_name == name]
        want: dict = {}
        for d, t, _, _ in rows:
            if d is not None and t:
                want[d] = want.get(d, 0) + t
        assert p.groupby("doc_id").tokens.sum().to_dict() == want
        per = p.groupby("container_id")[["tokens", "segments", "loss_tokens"]].agg(["sum", "count"])
        assert (per[("tokens", "sum")] <= capacity).all()
        shared = per[per[("tokens", "count")] > 1]
        assert (shared[("segments", "sum")] <= -(-capacity // 8)).all() and (shared[("loss_tokens", "sum")] <= np.ceil(capacity * 0.8)).all()
        split = p[p.piece > 0].doc_id.unique()
        assert all(want[d] > capacity for d in split)


def test_limits_bind_and_part_empty_containers_are_opened_again(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(t), 12 if i % 3 == 0 else 1, 0 if i % 4 == 0 else int(t)) for i, t in enumerate(rng.integers(20, 300, 3000))]
    items = spark.createDataFrame(rows, "doc_id long, tokens long, segments long, loss long")
    filled = {}
    for group in (500, 10**6):
        p = pack(items, [("a", 1000)], group_items=group).toPandas()
        assert sorted(p.doc_id) == list(range(3000)) and (p.piece == 0).all()
        per = p.groupby("container_id")[["tokens", "segments", "loss_tokens"]].sum()
        room = np.ceil(1000 * np.array([1.5 * sum(r[2] for r in rows), 1.1 * sum(r[3] for r in rows)]) / sum(r[1] for r in rows))
        assert (per.tokens <= 1000).all() and (per.segments <= room[0]).all() and (per.loss_tokens <= room[1]).all()
        assert (per.segments > room[0] - 12).any() and (per.loss_tokens > 0.95 * room[1]).any()
        filled[group] = per.tokens.sum() / (1000 * len(per))
    assert filled[500] > filled[10**6] - 0.02 > 0.93


def test_packing_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, tokens long, segments long, loss long"), [("a", 8)]).count() == 0


def test_plan():
    total, give = plan({"a": 100, "b": 1000}, [("a", 0.5, 2), ("b", 0.4, 1), ("none", 0.1, 3)])
    assert give == pytest.approx({"a": 200, "b": 160}) and total == pytest.approx(360)
    assert plan({}, [("a", 1.0, 1)]) == (0.0, {})


def test_large_documents_do_not_end_a_share(spark):
    rows = [(i, "wide", 900) for i in range(40)] + [(100 + i, "wide", 15) for i in range(60)] + [(1000 + i, "even", 20) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    out, shares = mixture(docs, [("wide", 0.25, 1), ("even", 0.75, 1)], block=128)
    share = {r.source: r.reached_share for r in shares.collect()}
    assert share["wide"] == pytest.approx(0.25, abs=0.005)
    t = out.toPandas().sort_values(["source", "start"])
    for _, own in t.groupby("source"):
        assert (own.start.to_numpy()[1:] == (own.start + own.tokens).to_numpy()[:-1]).all()


def test_mixture_reaches_shares_and_caps(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "big" if i % 3 else "mid", int(t)) for i, t in enumerate(rng.integers(5, 60, 900))] + [(5000, "small", 30), (5001, "small", 40), (5002, None, 9), (5003, "big", 0), (5004, "other", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, tokens long")
    out, shares = mixture(docs, [("big", 0.6, 1), ("mid", 0.39, 3), ("small", 0.01, 8), ("void", 0.2, 2)], block=64)
    t = out.toPandas()
    uses = t.groupby(["source", "doc_id"]).size().groupby("source").max().to_dict()
    assert uses["big"] <= 1 and uses["mid"] <= 3 and uses["small"] <= 8
    share = {r.source: r.reached_share for r in shares.collect()}
    assert share["big"] == pytest.approx(0.6, abs=0.01) and share["small"] == pytest.approx(0.01, abs=0.002) and share["void"] == 0
    first = t[t.slot < t.slot.max() // 2].groupby("source").tokens.sum()
    assert first["big"] / first.sum() == pytest.approx(0.6, abs=0.05)
    assert not t.duplicated(["doc_id", "use"]).any()
    assert mixture(docs.limit(0), [("big", 1.0, 1)])[0].count() == 0
