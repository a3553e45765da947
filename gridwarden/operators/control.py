"""Control plane: vote diffusion, peer failure detection, switching between federated and gossip.

A federation's state is one immutable record whose node sets are integers used as bit
sets, and ``step`` maps (state, round, reporting nodes) to (state, commit).  The same
function serves a batch fold over a table of rounds (``fold``) and the stateful
streaming operator of ``streaming.control``.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topology import neighbours

LONG_AGO = -(10**9)


def bits(nodes: Iterable[int]) -> int:
    out = 0
    for i in nodes:
        out |= 1 << i
    return out


def members(mask: int) -> list[int]:
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


@dataclass(frozen=True)
class Settings:
    nodes: int
    dwell: int = 3
    cooldown: int = 2
    quorum: int | None = None
    decentralised: bool = False
    topology: str = "ring"
    timeout: int = 2
    witnesses: int = 1

    @property
    def everyone(self) -> int:
        return (1 << self.nodes) - 1

    def near(self) -> list[list[int]]:
        return neighbours(self.topology, self.nodes)

    def needed(self, active: int) -> int:
        return self.quorum if self.quorum is not None else active // 2 + 1


@dataclass(frozen=True)
class State:
    mode: str = "federated"
    last_switch: int = LONG_AGO
    stable: int = 0
    believed: int = -1
    control_bytes: int = 0
    #: decentralised only: misses[i][k] of i's k-th neighbour; suspicions[i] = {target: observers}; votes[i]; own dwell
    misses: tuple[tuple[int, ...], ...] = ()
    suspicions: tuple[dict, ...] = field(default=(), hash=False)
    votes: tuple[int, ...] = ()
    settled: tuple[int, ...] = ()


@dataclass(frozen=True)
class Commit:
    round: int
    mode: str  # from the next round on
    reason: str
    nodes: tuple[int, ...]


def begin(s: Settings, mode: str = "federated") -> State:
    near = s.near()
    return State(mode=mode, believed=s.everyone, misses=tuple(tuple(0 for _ in x) for x in near), suspicions=tuple({} for _ in near), votes=(0,) * s.nodes, settled=(0,) * s.nodes)


def elected(round_: int, active: int) -> int | None:
    """The head of a round."""
    up = members(active)
    return up[(round_ - 1) % len(up)] if up else None


def spread(votes: tuple[int, ...], near: list[list[int]], active: int, round_: int) -> tuple[int, ...]:
    """The head takes over what its up neighbours have heard."""
    h = elected(round_, active)
    if h is None:
        return votes
    heard = votes[h]
    for j in near[h]:
        if active >> j & 1:
            heard |= votes[j]
    return votes[:h] + (heard,) + votes[h + 1 :]


def rounds_to_quorum(n: int, quorum: int | None = None, topology: str = "ring", most: int = 1000) -> int | None:
    """Rounds until every node has heard ``quorum`` votes after all have cast theirs in round 1."""
    need, near, everyone = quorum if quorum is not None else n // 2 + 1, neighbours(topology, n), (1 << n) - 1
    votes = tuple(1 << i for i in range(n))
    for r in range(1, most + 1):
        if min(v.bit_count() for v in votes) >= need:
            return r - 1
        votes = spread(votes, near, everyone, r)
    return None


def detect(s: Settings, near: list[list[int]], misses, suspicions, round_: int, alive: int, relays: int):
    """One round of timeouts and of suspicions passed to the head by the neighbours in ``relays``.

    What has been heard is never taken back, not even when a node returns.
    """
    misses, suspicions = list(misses), [dict(x) for x in suspicions]
    for i in members(alive):
        row = list(misses[i])
        for k, j in enumerate(near[i]):
            row[k] = 0 if alive >> j & 1 else row[k] + 1
            if row[k] >= s.timeout:
                suspicions[i][j] = suspicions[i].get(j, 0) | 1 << i
        misses[i] = tuple(row)
    h = elected(round_, alive)
    if h is not None:
        for j in near[h]:
            if relays >> j & 1:
                for target, who in suspicions[j].items():
                    suspicions[h][target] = suspicions[h].get(target, 0) | who
    return tuple(misses), tuple(suspicions)


def knows(s: Settings, suspicions, observer: int, target: int) -> bool:
    return suspicions[observer].get(target, 0).bit_count() >= s.witnesses


def agreement(s: Settings, suspicions, target: int, alive: int) -> int:
    """Alive nodes but the target that hold it to be down."""
    return sum(knows(s, suspicions, i, target) for i in members(alive) if i != target)


def detection_latency(n: int, timeout: int = 2, fail_at: int = 3) -> int | None:
    """Rounds from a failure of node n // 2 in a ring until all others know."""
    s = Settings(n, decentralised=True, timeout=timeout)
    near, st, down = s.near(), begin(s), n // 2
    misses, suspicions = st.misses, st.suspicions
    for r in range(1, 6 * n):
        alive = s.everyone if r < fail_at else s.everyone & ~(1 << down)
        misses, suspicions = detect(s, near, misses, suspicions, r, alive, s.everyone)
        if agreement(s, suspicions, down, alive) == (alive & ~(1 << down)).bit_count():
            return r - fail_at
    return None


def step(s: Settings, st: State, round_: int, reported: int) -> tuple[State, Commit | None]:
    """One observation: who reported in this round; a commit holds from the next round on."""
    return (_step_by_diffusion if s.decentralised else _step_by_tally)(s, st, round_, reported)


def _step_by_tally(s: Settings, st: State, r: int, reported: int) -> tuple[State, Commit | None]:
    lost = st.believed & ~reported
    st = replace(st, believed=reported)
    up, need, rested = reported.bit_count(), s.needed(reported.bit_count()), r - st.last_switch >= s.cooldown
    full = reported == s.everyone
    if st.mode == "federated":
        if not full and up >= need and rested:
            return replace(st, mode="gossip", last_switch=r, stable=0), Commit(r, "gossip", "node_failure", tuple(members(lost)))
        return st, None
    stable = st.stable + 1 if full and not lost else 0
    if stable >= s.dwell and full and up >= need and rested:
        return replace(st, mode="federated", last_switch=r, stable=0), Commit(r, "federated", "recovery", ())
    return replace(st, stable=stable), None


def _step_by_diffusion(s: Settings, st: State, r: int, alive: int) -> tuple[State, Commit | None]:
    near, none = s.near(), (0,) * s.nodes
    lost = st.believed & ~alive
    misses, suspicions = detect(s, near, st.misses, st.suspicions, r, alive, alive)
    h = elected(r, alive)
    cost = 0 if h is None else sum(alive >> j & 1 for j in near[h]) * 2 * -(-s.nodes // 8)
    st = replace(st, believed=alive, misses=misses, suspicions=suspicions, control_bytes=st.control_bytes + cost)
    rested = r - st.last_switch >= s.cooldown
    down = s.everyone & ~alive
    if st.mode == "federated":
        if rested and any(knows(s, suspicions, i, j) for j in members(down) for i in members(alive)):
            return replace(st, mode="gossip", last_switch=r, stable=0, votes=none), Commit(r, "gossip", "node_failure", tuple(members(down)))
        return st, None
    votes = list(none if lost else st.votes)
    settled = tuple(st.settled[i] + 1 if alive >> i & 1 and all(alive >> j & 1 for j in near[i]) else 0 for i in range(s.nodes))
    for i in members(alive):
        if settled[i] >= s.dwell:
            votes[i] |= 1 << i
    votes = spread(tuple(votes), near, alive, r)
    if rested and any(votes[i].bit_count() >= s.nodes for i in members(alive)):
        return replace(st, mode="federated", last_switch=r, stable=0, votes=none, settled=settled), Commit(r, "federated", "recovery", ())
    return replace(st, votes=votes, settled=settled), None


def digest_hex(s: Settings, st: State) -> str:
    """Vote bitmap and suspicion bitmap of the decentralised plane, low byte first."""
    voters = bits(i for i in range(s.nodes) if st.votes[i] >> i & 1)
    suspected = bits(j for j in range(s.nodes) if any(knows(s, st.suspicions, i, j) for i in members(st.believed)))
    size = -(-s.nodes // 8)
    return (voters.to_bytes(size, "little") + suspected.to_bytes(size, "little")).hex()


COMMITS = "scenario string, dwell int, round int, mode string, reason string, nodes array<int>"


def fold(observations: DataFrame, settings: Settings) -> DataFrame:
    """Commits of each (scenario, dwell): rows (scenario, dwell, round, reported array<int>), one federation each.

    A federation's rounds are a sequence by nature, so each is one group; federations run in
    parallel.
    """
    base = settings

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("round")
        s = replace(base, dwell=int(frame["dwell"].iloc[0]))
        st, out = begin(s), []
        for r, reported in zip(frame["round"], frame["reported"]):
            st, commit = step(s, st, int(r), bits(int(i) for i in reported))
            if commit:
                out.append((frame["scenario"].iloc[0], s.dwell, commit.round, commit.mode, commit.reason, list(commit.nodes)))
        return pd.DataFrame(out, columns=["scenario", "dwell", "round", "mode", "reason", "nodes"])

    return observations.groupBy("scenario", "dwell").applyInPandas(run, COMMITS)


def dwell_sweep(observations: DataFrame, settings: Settings) -> DataFrame:
    """(scenario, dwell, recovery_round or null, n_switches, flap): a flap is a recovery followed by another commit."""
    commits = fold(observations, settings)
    scenarios = observations.select("scenario", "dwell").distinct()
    per = commits.groupBy("scenario", "dwell").agg(
        F.min(F.when(F.col("reason") == "recovery", F.col("round"))).alias("recovery_round"), F.count("*").alias("n_switches"), F.max("round").alias("_last")
    )
    return scenarios.join(per, ["scenario", "dwell"], "left").select(
        "scenario", "dwell", "recovery_round", F.coalesce("n_switches", F.lit(0)).alias("n_switches"), F.coalesce(F.col("recovery_round") < F.col("_last"), F.lit(False)).alias("flap")
    )
