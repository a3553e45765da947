"""Published results that need no data set."""

import pytest

from gridwarden.operators import control as C


def commits(s, alive_at, rounds=60):
    st, out = C.begin(s), []
    for r in range(1, rounds + 1):
        st, c = C.step(s, st, r, alive_at(s, r))
        if c:
            out.append(c)
    return out, st


@pytest.mark.parametrize("n,rounds", [(10, 13), (14, 19), (20, 28), (30, 43), (50, 73), (70, 103), (100, 148)])
def test_quorum_latency(n, rounds):
    assert C.rounds_to_quorum(n) == rounds <= 3 * n


@pytest.mark.parametrize("n,rounds", [(10, 9), (14, 15), (20, 24), (30, 39), (50, 69), (70, 99), (100, 144)])
def test_detection_latency(n, rounds):
    assert C.detection_latency(n) == rounds


def test_live_run_switches_and_recovers():
    s = C.Settings(14, dwell=3, cooldown=2, decentralised=True)
    got, st = commits(s, lambda s, r: s.everyone if r < 10 or r >= 34 else s.everyone & ~2)
    assert [(c.round, c.mode) for c in got] == [(11, "gossip"), (44, "federated")]
    assert st.control_bytes > 0 and len(C.digest_hex(s, st)) == 8


def test_partial_membership_never_recovers():
    s = C.Settings(8, dwell=1, cooldown=1, decentralised=True)
    got, _ = commits(s, lambda s, r: s.everyone if r < 5 else s.everyone & ~4, 200)
    assert [c.mode for c in got] == ["gossip"]


def test_minority_cannot_reach_quorum():
    near, votes = C.neighbours("ring", 10), tuple(1 << i if i < 4 else 0 for i in range(10))
    for r in range(1, 100):
        votes = C.spread(votes, near, (1 << 10) - 1, r)
    assert max(v.bit_count() for v in votes) == 4


def test_witness_gate():
    s = C.Settings(6, decentralised=True, timeout=1, witnesses=2)
    near, st = s.near(), C.begin(s)
    alive = s.everyone & ~1
    m, sus = C.detect(s, near, st.misses, st.suspicions, 4, alive, alive)
    assert not any(C.knows(s, sus, i, 0) for i in range(1, 6))
    for r in range(1, 30):
        m, sus = C.detect(s, near, m, sus, r, alive, alive)
    assert C.agreement(s, sus, 0, alive) == 5


def test_cooldown_delays():
    s = C.Settings(5, dwell=1, cooldown=6)
    got, _ = commits(s, lambda s, r: s.everyone & ~1 if r in (3, 4, 6) else s.everyone, 20)
    assert [c.round for c in got] == [3, 9]


def test_switches_by_kind_are_steps_over_days(spark, sf):
    from gridwarden.plans import joined

    seen = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").filter("value > 60").collect():
        seen.setdefault(r.event_type, {}).setdefault(r.ts.day, set()).add(r.user_id % 14)
    want = []
    for kind, days in seen.items():
        s = C.Settings(14, dwell=3, cooldown=2)
        st = C.begin(s)
        for day in sorted(days):
            st, c = C.step(s, st, day, C.bits(days[day]))
            if c:
                want.append((kind, c.round, c.mode, c.reason, list(c.nodes)))
    got = [(r.scenario, r["round"], r["mode"], r.reason, r.nodes) for r in joined.switches_by_kind(spark, sf).collect()]
    assert sorted(got) == sorted(want) and want
