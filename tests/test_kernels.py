"""The kernels against exhaustive enumeration on seeded random graphs."""

from itertools import combinations

import numpy as np
import pytest

from severa.operators import kernels as k
from severa.operators import strategies as st


def make(seed, n=9, p=0.25, p_fixed=0.35, n_entries=3, n_targets=2, n_twins=2, most_free=11):
    rng = np.random.default_rng(seed)
    pairs = [(a, b) for a in range(n) for b in range(n) if a != b and rng.random() < p]
    free = {e: rng.random() >= p_fixed for e in pairs}
    nodes = rng.permutation(n)
    entries, targets = nodes[:n_entries], nodes[n_entries : n_entries + n_targets]
    for _ in range(n_twins):  # a node with another's fixed edges out
        a, b = rng.choice([x for x in range(n) if x not in targets], 2, replace=False)
        pairs = [e for e in pairs if e[0] != b] + [(b, y) for x, y in pairs if x == a and y != b]
        free |= {(x, y): False for x, y in pairs if x in (a, b)}
    pairs = sorted(set(pairs))
    loose = [e for e in pairs if free[e]]
    for i in rng.permutation(len(loose))[most_free:]:
        free[loose[i]] = False
    w, v = np.zeros(n), np.zeros(n)
    w[entries] = rng.choice([0.5, 1, 2], n_entries)
    v[targets] = rng.choice([1, 3, 5], n_targets)
    src, dst = (np.array([e[i] for e in pairs], np.int64) for i in (0, 1))
    return k.Net.of(n, src, dst, rng.integers(1, 5, len(pairs)), [free[e] for e in pairs], w, v)


def without(net, edges):
    there = net.whole()
    there[list(edges)] = False
    return there


def optimum(net, budget):
    loose = np.flatnonzero(net.free).tolist()
    return min(k.risk(net, without(net, c)) for r in range(len(loose) + 1) for c in combinations(loose, r) if net.cost[list(c)].sum() <= budget)


def separated(net, there, sources):
    ahead = k.forward(net, there)
    return not any(ahead.swept([s])[net.targets()].any() for s in sources)


@pytest.mark.parametrize("seed", range(40))
def test_gains(seed):
    net = make(seed, n=10, p=0.3, most_free=30)
    rng = np.random.default_rng(seed)
    there = ~(net.free & (rng.random(net.m) < 0.15))
    got, now = k.gains(net, there), k.risk(net, there)
    for e in np.flatnonzero(net.free & there):
        after = there.copy()
        after[e] = False
        assert got[e] == pytest.approx(now - k.risk(net, after))


@pytest.mark.parametrize("cells", [k.Gains.CELLS, 1])
@pytest.mark.parametrize("seed", range(40))
def test_gains_kept_up(seed, cells, monkeypatch):
    """Edges gone one by one, or some at once: what is kept up is what is found anew, also where only one tree is kept."""
    monkeypatch.setattr(k.Gains, "CELLS", cells)
    net = make(seed, n=14, p=0.12 + 0.01 * (seed % 15), n_targets=3, most_free=60)
    rng = np.random.default_rng(seed)
    kept, left = k.Gains(net), rng.permutation(np.flatnonzero(net.free)).tolist()
    while left:
        some = [left.pop() for _ in range(min(len(left), int(rng.integers(1, 4))))]
        kept.remove(some)
        assert kept.total == pytest.approx(k.gains(net, kept.there))


@pytest.mark.parametrize("seed", range(40))
def test_global_cut(seed):
    net = make(seed, most_free=10)
    value, cut, used = k.global_cut(net)
    assert value == net.cost[cut].sum() and net.free[cut].all()
    assert separated(net, without(net, cut), used)
    loose = np.flatnonzero(net.free).tolist()
    if len(used):
        assert value == min(net.cost[list(c)].sum() for r in range(len(loose) + 1) for c in combinations(loose, r) if separated(net, without(net, c), used))


@pytest.mark.parametrize("seed", range(40))
def test_reduction(seed):
    net = make(seed, most_free=8)
    r = k.reduce(net)
    rng = np.random.default_rng(seed)
    for budget in (1, 3, int(net.cost.sum()) // 2 + 1):
        assert optimum(r.net, budget) == pytest.approx(optimum(net, budget))
    for _ in range(10):
        gone = r.net.free & (rng.random(r.net.m) < 0.5)
        there = without(net, r.original(gone))
        assert k.risk(net, there) == pytest.approx(k.risk(r.net, ~gone))
        assert net.spent(there) == r.net.spent(~gone)


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("budget", [2, 5])
def test_strategies(seed, budget):
    net = make(seed)
    best = optimum(net, budget)
    for name, solve in st.STRATEGIES.items():
        there, notes = solve(net, budget)
        assert net.spent(there) <= budget, name
        assert k.risk(net, there) >= best - 1e-9, name
        if name == "C":
            assert notes["status"] == "optimal" and k.risk(net, there) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("budget", [0, 2, 5])
def test_bound(seed, budget):
    net = make(seed)
    low, share = k.lp_bound(net, budget)
    assert low <= optimum(net, budget) + 1e-6
    assert share.min() >= 0 and share.max() <= 1
    if budget == 0:
        assert low == pytest.approx(k.risk(net))


def test_search_limits():
    """Cut short, the search says so; limited by nodes, it says the same again."""
    net = make(4, n=12, p=0.35, most_free=30)
    few = [k.exact(net, 6, most_nodes=3) for _ in range(2)]
    assert few[0][1] == "feasible" and few[0][2] == few[1][2] and (few[0][0] == few[1][0]).all()
    assert k.exact(net, 6)[1] == "optimal"


@pytest.mark.parametrize("seed", range(30))
def test_hubs_as_edges_go(seed):
    """What is kept of hubs while edges go gives the hubs that are found anew, by plain sweeps."""
    net = make(seed, n=16, p=0.15, n_entries=4, n_targets=2, most_free=60)
    ahead, there = st.Ahead(net), net.whole()
    for e in np.random.default_rng(seed).permutation(np.flatnonzero(net.free)):
        reach = k.reached_by(net, there)
        score = {h: sum(net.w[s] for s in net.entries() if k.forward(net, there).swept([s])[h]) * sum(net.v[t] for t in reach if reach[t][h]) for h in range(net.n) if net.w[h] <= 0 and net.v[h] <= 0}
        best = sorted((h for h in score if score[h] > 0), key=lambda h: (-score[h], h))[:5]
        assert [h for h, _ in ahead.hubs(there, reach, 5)] == best
        there[e] = False


@pytest.mark.parametrize("seed", range(30))
def test_trimmed(seed):
    net = make(seed, n=14, p=0.2, n_entries=4, n_targets=3, most_free=60)
    there = ~(net.free & (np.random.default_rng(seed).random(net.m) < 0.7))
    want, now = there.copy(), k.risk(net, there)
    for e in sorted(np.flatnonzero(~there).tolist(), key=lambda e: (-net.cost[e], e)):
        want[e] = True
        want[e] = k.risk(net, want) <= now + 1e-9
    assert (st._trimmed(net, there) == want).all()


def test_without_hubs_only_single_edges_are_offered():
    net = k.Net.of(4, [0, 0, 1, 2], [1, 2, 3, 3], [0, 0, 1, 1], [False, False, True, True], [1, 0, 0, 0], [0, 0, 0, 7])
    assert k.risk(net, st.STRATEGIES["D-nohub"](net, 2)[0]) in (0, 7)
    assert st.cut_offers(net, net.whole(), 2, 7.0, {}, most_hubs=0, targets=False) == []
    assert len(st.cut_offers(net, net.whole(), 2, 7.0, {}, most_hubs=0)) == 1


def test_bound_is_tight_on_a_chain():
    net = k.Net.of(3, [0, 1], [1, 2], [4, 2], [True, True], [1, 0, 0], [0, 0, 10])
    assert k.lp_bound(net, 1)[0] == pytest.approx(5, rel=0.02)
    assert k.lp_bound(net, 2)[0] == pytest.approx(0, abs=0.2)


def relaxed(net, x):
    """The relaxation's value at removals x: an entry keeps of a target's value what its cheapest way leaves."""
    value = 0.0
    for t in net.targets():
        far = np.full(net.n, np.inf)
        far[t] = 0
        for _ in range(net.n):
            np.minimum.at(far, net.src, far[net.dst] + x)
        value += net.v[t] * (net.w * np.maximum(0, 1 - far)).sum()
    return value


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("share", [0.1, 0.5, 0.9])
def test_bound_is_near_a_point_of_the_relaxation(seed, share):
    net = make(seed, n=40, p=0.08, n_entries=8, n_targets=3, most_free=400)
    budget = max(1, int(share * k.global_cut(net)[0]))
    low, x = k.lp_bound(net, budget, tolerance=1e-4)
    fits = x * min(1.0, budget / max((x * net.cost).sum(), 1e-12))
    high = relaxed(net, fits)
    assert low <= high + 1e-6
    assert high - low <= 0.01 * k.risk(net)


def test_two_routes_have_no_gain_alone():
    net = k.Net.of(4, [0, 0, 1, 2], [1, 2, 3, 3], [0, 0, 1, 1], [False, False, True, True], [1, 0, 0, 0], [0, 0, 0, 7])
    assert (k.gains(net) == 0).all()
    assert st.greedy(net, 2).all()
    assert k.risk(net, st.hub_cut(net, 2)[0]) == 0


def grown_tree(seed, inward):
    rng = np.random.default_rng(seed)
    n = 11
    up = [int(rng.integers(0, i)) for i in range(1, n)]
    a, b = (np.arange(1, n), np.array(up)) if inward else (np.array(up), np.arange(1, n))
    root, many = np.zeros(n), np.zeros(n)
    root[0], many[:] = 2.0, rng.integers(0, 4, n)
    return k.Net.of(n, a, b, rng.integers(1, 5, n - 1), rng.random(n - 1) < 0.8, *((many, root) if inward else (root, many)))


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("inward", [False, True])
@pytest.mark.parametrize("budget", [0, 1, 4, 100])
def test_tree(seed, inward, budget):
    net = grown_tree(seed, inward)
    there, notes = st.tree(net, budget)
    assert notes["status"] == "optimal" and net.spent(there) <= budget
    assert k.risk(net, there) == pytest.approx(optimum(net, budget))


@pytest.mark.parametrize("seed", range(25))
@pytest.mark.parametrize("budget", [0, 2, 5, 100])
def test_subsets(seed, budget):
    net = make(seed, n_entries=1, n_targets=4)
    there, notes = st.subsets(net, budget)
    assert net.spent(there) <= budget
    if k.risk(net) > 0:
        assert notes["status"] == "optimal"
    assert k.risk(net, there) == pytest.approx(optimum(net, budget))


def test_tree_and_subsets_that_do_not_apply():
    net = k.Net.of(4, [0, 0, 1, 2, 3], [1, 2, 3, 3, 0], [1] * 5, [True] * 5, [1, 1, 0, 0], [0, 0, 0, 7])
    for solve in (st.tree, st.subsets):
        there, notes = solve(net, 9)
        assert there.all() and notes["status"] == "not applicable"
