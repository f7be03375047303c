import itertools

import numpy as np

from sessionloom.llm.conversations import _PAIRS, ROLES, clock_offsets, conversations

SES = "id string, role int"
MSG = "id string, session_id string, time_created long, time_updated long, data string, loaded_at timestamp, text string"
PRT = "id string, message_id string, session_id string, time_created long, time_updated long, data string, loaded_at timestamp"


def run(spark, sessions, messages, parts, **more):
    s = spark.createDataFrame([(x, 1) for x in sessions], SES)
    m = spark.createDataFrame([(i, ses, t, v, d, None, "clash") for i, ses, t, v, d in messages], MSG)
    p = spark.createDataFrame([(i, mid, ses, 1, v, d, None) for i, mid, ses, v, d in parts], PRT)
    verdicts, turns = conversations(s, m, p, **more)
    return {r.session_id: (r.reason, r.offset_ms) for r in verdicts.collect()}, [(r.session_id, r.turn_no, r.role, r.message_id, r.text) for r in turns.orderBy("session_id", "turn_no").collect()]


def user(i, s, t, v=1, role="user"):
    return (i, s, t, v, f'{{"role": "{role}"}}')


def bot(i, s, t, v=1):
    return user(i, s, t, v, "assistant")


def says(i, m, s, text, v=1):
    return (i, m, s, v, '{"type":"text","text":"%s"}' % text)


T0 = 1_770_000_000_000


def test_reasons(spark):
    messages = [
        user("a1", "ok", T0), bot("a2", "ok", T0 + 5), user("b1", "gone", T0), bot("b2", "gone", T0 + 1), user("c1", "bad", T0), ("c2", "bad", T0 + 1, 1, '{"role":"assistant"'),
        user("d1", "orphan", T0), bot("d2", "orphan", T0 + 1), user("e1", "empty", T0), bot("e2", "empty", T0 + 1), user("f1", "open", T0), bot("f2", "open", T0 + 1), user("f3", "open", T0 + 2), bot("g1", "nouser", T0),
        user("h1", None, T0), user("i1", "strings", T0), ("i2", "strings", T0 + 1, 1, '"{\\"role\\":\\"assistant\\"}"'), user("j1", "roles", T0, role=" USER "), user("j2", "roles", T0 + 1, role="Assistant"),
        user("k2", "seconds", T0 // 1000 + 60), bot("k1", "seconds", T0), bot("k3", "seconds", T0 + 90_000),
    ]
    parts = [says(f"p{i}", i, s, "x") for i, s, *_ in messages if s and s != "empty"]
    parts += [says("q1", "zz", "orphan", "x"), says("q2", "e1", "empty", "  "), ("q3", "e2", "empty", 1, '{"type":"step-start"}'), ("q4", "a2", "ok", 1, '{"type":"tool","tool":"bash","state":{"status":"completed"}}'), says("q5", "zz", None, "x")]
    verdicts, turns = run(spark, ["ok", "bad", "orphan", "empty", "open", "nouser", "strings", "roles", "seconds", "silent"], messages, parts)
    assert {s: r for s, (r, _) in verdicts.items()} == {"ok": None, "gone": "broken", "bad": "broken", "orphan": "broken", "empty": "empty", "open": "no_reply", "nouser": "no_reply", "strings": "broken", "roles": None, "seconds": None, "silent": "empty"}
    assert ("ok", 1, "assistant", "a2", "x\n[tool bash: completed]") in turns
    assert [t[3] for t in turns if t[0] == "seconds"] == ["k1", "k2", "k3"]


def test_rows_in_force_and_ties(spark):
    messages = [user("a1", "s", T0, 1), bot("a1", "s", T0, 0), bot("a2", "s", T0, 1), bot("a2", "s", T0, 1)]
    verdicts, turns = run(spark, ["s"], messages, [says("p1", "a1", "s", "old", 0), says("p1", "a1", "s", "new", 2), says("p2", "a2", "s", "re")])
    assert verdicts == {"s": (None, 0)} and [(t[2], t[4]) for t in turns] == [("user", "new"), ("assistant", "re")]


def test_a_clock_that_is_off_is_corrected(spark):
    # The assistant's clock is 50 s behind: its replies seem to come before the requests.
    messages = [m for k in range(4) for m in (user(f"m{2 * k}", "s", T0 + k * 60_000), bot(f"m{2 * k + 1}", "s", T0 + k * 60_000 + 20_000 - 50_000))]
    parts = [says(f"p{i}", i, "s", i) for i, *_ in messages]
    assert run(spark, ["s"], messages, parts)[0]["s"][0] == "no_reply"  # as the times are stated
    verdicts, turns = run(spark, ["s"], messages, parts, stated_order=False)
    assert verdicts["s"] == (None, 30_000) and [t[3] for t in turns] == [f"m{k}" for k in range(8)]


def test_clocks_that_no_offset_brings_together(spark):
    messages = [user("m0", "s", T0), bot("m1", "s", T0 - 90_000), user("m2", "s", T0 + 60_000), bot("m3", "s", T0 + 200_000), user("m4", "s", T0 + 180_000), bot("m5", "s", T0 + 500_000)]
    verdicts, turns = run(spark, ["s"], messages, [says(f"p{i}", i, "s", i) for i, *_ in messages])
    assert verdicts["s"][0] == "infeasible" and turns == []


def test_offsets_of_three_senders_have_the_least_squares():
    rng = np.random.default_rng(2)
    bounds, counts = np.full((60, len(_PAIRS)), np.nan), rng.integers(1, 6, (60, len(ROLES))).astype(float)
    for b in bounds:
        true = np.array([0, *rng.integers(-9, 9, 3)])
        for p, (i, j) in enumerate(_PAIRS):
            if rng.random() < 0.6:
                b[p] = true[i] - true[j] + rng.integers(0, 4)
    feasible, d = clock_offsets(bounds, counts)
    assert feasible.all()
    grid = np.array(list(itertools.product(range(-16, 17), repeat=3)))
    grid = np.concatenate([np.zeros((len(grid), 1)), grid], 1)
    for b, w, x in zip(bounds, counts, d, strict=True):
        ok = np.all([np.isnan(b[p]) | (grid[:, i] - grid[:, j] <= b[p]) for p, (i, j) in enumerate(_PAIRS)], axis=0)
        assert all(np.isnan(b[p]) or x[i] - x[j] <= b[p] for p, (i, j) in enumerate(_PAIRS))
        best = (w * grid[ok] ** 2).sum(1).min()
        assert (w * x**2).sum() <= best + w.sum() * 2 + 2 * (w * np.abs(x)).sum() ** 0.5 * 3  # whole ms cost a little
    loop = np.full((1, len(_PAIRS)), np.nan)
    for i, j, b in ((1, 2, -1), (2, 3, -1), (3, 1, 1)):
        loop[0, _PAIRS.index((i, j))] = b
    assert not clock_offsets(loop, np.ones((1, 4)))[0][0]


def test_a_tool_clock_that_is_off_is_found_through_the_assistant(spark):
    messages = [m for k in range(3) for m in (user(f"m{k}a", "s", T0 + k * 60_000), bot(f"m{k}b", "s", T0 + k * 60_000 + 9_000), user(f"m{k}c", "s", T0 + k * 60_000 - 20_000, role="tool"), bot(f"m{k}d", "s", T0 + k * 60_000 + 30_000))]
    parts = [says(f"p{i}", i, "s", i) for i, *_ in messages]
    s, m, p = (spark.createDataFrame(x, c) for x, c in (([("s", 1)], SES), ([(*x, None, "") for x in messages], MSG), ([(i, mid, ses, 1, v, d, None) for i, mid, ses, v, d in parts], PRT)))
    r = conversations(s, m, p)[0].collect()[0]
    # 6 d(assistant)**2 + 3 d(tool)**2 is least at (-9667, 19333), but no reply is earlier than 9 s after its request.
    assert (r.reason, r.offset_ms, r.system_ms, r.tool_ms) == (None, -9_000, 0, 20_000)


def test_empty_tables(spark):
    assert run(spark, [], [], []) == ({}, [])
