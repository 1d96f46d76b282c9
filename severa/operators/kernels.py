"""Kernels on one graph in memory: what is inherently sequential runs here, one group of rows a call.

A Net holds columns. A removal is a boolean column over edges (True: still there). Spark runs these kernels in
grouped maps, many instances, budgets and strategies side by side; see severa.operators.runs.
"""

from __future__ import annotations

import time
from collections import deque
from dataclasses import dataclass

import numpy as np

TINY = 1e-9


@dataclass
class Net:
    n: int
    src: np.ndarray
    dst: np.ndarray
    cost: np.ndarray
    free: np.ndarray
    w: np.ndarray
    v: np.ndarray

    @staticmethod
    def of(n, src, dst, cost, free, w, v) -> Net:
        free = np.asarray(free, bool)
        return Net(int(n), np.asarray(src, np.int64), np.asarray(dst, np.int64), np.where(free, np.asarray(cost, np.int64), 0), free, np.asarray(w, float), np.asarray(v, float))

    @property
    def m(self) -> int:
        return len(self.src)

    def whole(self) -> np.ndarray:
        return np.ones(self.m, bool)

    def entries(self) -> np.ndarray:
        return np.flatnonzero(self.w > 0)

    def targets(self) -> np.ndarray:
        return np.flatnonzero(self.v > 0)

    def spent(self, there: np.ndarray) -> int:
        """The cost of the removed edges; an edge that can't be removed among them is an error."""
        gone = ~there
        if (gone & ~self.free).any():
            raise ValueError("an edge that can't be removed is among the removed")
        return int(self.cost[gone].sum())


class Adjacency:
    """Neighbours by node as slices of two columns: the neighbours and the edges."""

    def __init__(self, n: int, tail: np.ndarray, head: np.ndarray, edges: np.ndarray):
        order = np.argsort(tail[edges], kind="stable")
        self.edge = edges[order]
        self.next = head[self.edge]
        self.at = np.concatenate([[0], np.cumsum(np.bincount(tail[edges], minlength=n))])

    def swept(self, starts) -> np.ndarray:
        """The nodes that starts reach, themselves included, as a boolean column."""
        seen = np.zeros(len(self.at) - 1, bool)
        seen[starts] = True
        front = np.flatnonzero(seen)
        mark = np.empty(len(seen), np.int64)
        while len(front):
            lo, n = self.at[front], self.at[front + 1] - self.at[front]
            ends = np.cumsum(n)
            met = self.next[np.repeat(lo - ends + n, n) + np.arange(ends[-1])]
            met = met[~seen[met]]
            seen[met] = True
            turn = np.arange(len(met))
            mark[met] = turn  # of a node that was met several times the last one stays
            front = met[mark[met] == turn]
        return seen


def forward(net: Net, there: np.ndarray) -> Adjacency:
    return Adjacency(net.n, net.src, net.dst, np.flatnonzero(there))


def backward(net: Net, there: np.ndarray) -> Adjacency:
    return Adjacency(net.n, net.dst, net.src, np.flatnonzero(there))


def reached_by(net: Net, there: np.ndarray) -> dict[int, np.ndarray]:
    """By target, the nodes that reach it."""
    back = backward(net, there)
    return {int(t): back.swept([t]) for t in net.targets()}


def risk(net: Net, there: np.ndarray | None = None) -> float:
    there = net.whole() if there is None else there
    return float(sum(net.v[t] * net.w[mask].sum() for t, mask in reached_by(net, there).items()))


# ---------------------------------------------------------------- dominators and gains


def dominators(n: int, root: int, tail: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(immediate dominator by node, -1 where unreached; the reached nodes in reverse postorder) of a flow graph.

    The nearest common ancestor of the processed predecessors, in postorder numbers, until nothing moves (Cooper,
    Harvey and Kennedy).
    """
    out = Adjacency(n, tail, head, np.arange(len(tail)))
    ways, starts = out.next.tolist(), out.at.tolist()
    post = [-1] * n
    order: list[int] = []
    cursor = starts[:-1].copy()
    seen = [False] * n
    seen[root] = True
    stack = [root]
    while stack:
        u = stack[-1]
        if cursor[u] < starts[u + 1]:
            x = ways[cursor[u]]
            cursor[u] += 1
            if not seen[x]:
                seen[x] = True
                stack.append(x)
        else:
            post[u] = len(order)
            order.append(u)
            stack.pop()
    order.reverse()
    into = Adjacency(n, head, tail, np.arange(len(tail)))
    befores, marks = into.next.tolist(), into.at.tolist()
    idom = [-1] * n
    idom[root] = root
    moved = True
    while moved:
        moved = False
        for u in order[1:]:
            best = -1
            for p in befores[marks[u] : marks[u + 1]]:
                if idom[p] < 0:
                    continue
                if best < 0:
                    best = p
                    continue
                a, b = best, p
                while a != b:
                    if post[a] < post[b]:
                        a = idom[a]
                    else:
                        b = idom[b]
                best = a
            if best != idom[u]:
                idom[u] = best
                moved = True
    return np.array(idom), order


class _Tree:
    """A target's dominator tree over reversed edges, and what each node's only edge out of its subtree protects.

    An edge u -> x is on all ways of u's subtree if it is the only one to leave u for a node that u doesn't dominate.
    """

    def __init__(self, net: Net, t: int, edges: np.ndarray):
        self.t = t
        self.idom, order = dominators(net.n, t, net.dst[edges], net.src[edges])
        idom = self.idom
        self.alive = idom >= 0
        under = np.where(self.alive, net.w, 0.0)
        size = self.alive.astype(np.int64)
        for u in reversed(order[1:]):
            under[idom[u]] += under[u]
            size[idom[u]] += size[u]
        # preorder numbers of the tree: a subtree is a range
        first = np.zeros(net.n, np.int64)
        taken = np.zeros(net.n, np.int64)
        for u in order[1:]:
            p = idom[u]
            first[u] = first[p] + 1 + taken[p]
            taken[p] += size[u]
        here = edges[self.alive[net.src[edges]] & self.alive[net.dst[edges]]]
        u, x = net.src[here], net.dst[here]
        leaves = ~((first[x] >= first[u]) & (first[x] < first[u] + size[u]))
        alone = np.bincount(u[leaves], minlength=net.n) == 1
        bridge = here[leaves & alone[u] & (u != t)]
        bridge = bridge[net.free[bridge]]
        self.bridge = np.full(net.n, -1)
        self.bridge[net.src[bridge]] = bridge
        self.under, self.first, self.size = under, first, size
        self.ranked = np.array(order, np.int64)[np.argsort(first[order])]

    def add(self, net: Net, out: np.ndarray, sign: int) -> None:
        u = np.flatnonzero(self.bridge >= 0)
        out[self.bridge[u]] += sign * net.v[self.t] * self.under[u]


class Gains:
    """The exact drop in risk of every edge if it alone is removed (total), kept up as edges are removed.

    total is 0 for edges that are gone or can't be removed. A removal touches a target only if the edge is on a way
    to it. If the edge is the only way out of a subtree, and no edge leads into the subtree from elsewhere, the rest
    of the target's tree stays as it is and only loses that weight; else the tree is found anew. Up to CELLS cells of
    trees are kept; further targets' trees are found anew each time.
    """

    CELLS = 20_000_000

    def __init__(self, net: Net, there: np.ndarray | None = None):
        self.net = net
        self.there = net.whole() if there is None else there.copy()
        self.total = np.zeros(net.m)
        self.into = backward(net, net.whole())
        lit = forward(net, self.there).swept(net.entries())
        self.targets = [int(t) for t in net.targets() if lit[t]]
        kept = max(1, self.CELLS // max(1, net.n))
        self.kept: dict[int, _Tree] = {}
        self.rest = self.targets[kept:]
        for t in self.targets[:kept]:
            self.kept[t] = self._grown(t)
            self.kept[t].add(net, self.total, 1)
        self.beyond = self._beyond()
        self.total += self.beyond

    def _edges(self) -> np.ndarray:
        lit = forward(self.net, self.there).swept(self.net.entries())
        return np.flatnonzero(self.there & lit[self.net.src] & lit[self.net.dst])

    def _grown(self, t: int) -> _Tree:
        return _Tree(self.net, t, self._edges())

    def _beyond(self) -> np.ndarray:
        out = np.zeros(self.net.m)
        for t in self.rest:
            self._grown(t).add(self.net, out, 1)
        return out

    def remove(self, edges) -> None:
        for e in np.asarray(edges, np.int64).tolist():
            self.there[e] = False
            for t, tree in self.kept.items():
                u, x = self.net.src[e], self.net.dst[e]
                if u == t or not (tree.alive[u] and tree.alive[x]):
                    continue
                if tree.bridge[u] == e and self._pruned(tree, int(u)):
                    continue
                tree.add(self.net, self.total, -1)
                self.kept[t] = self._grown(t)
                self.kept[t].add(self.net, self.total, 1)
        if self.rest:
            self.total -= self.beyond
            self.beyond = self._beyond()
            self.total += self.beyond
        self.total[~self.there] = 0.0

    def _pruned(self, tree: _Tree, u: int) -> bool:
        """Takes u's subtree out of tree, if no edge leads into it from elsewhere; else False, and nothing is changed."""
        nodes = tree.ranked[tree.first[u] : tree.first[u] + tree.size[u]]
        nodes = nodes[tree.alive[nodes]]
        at, n = self.into.at[nodes], self.into.at[nodes + 1] - self.into.at[nodes]
        picks = np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        tails = self.into.next[picks]
        outside = tree.alive[tails] & ((tree.first[tails] < tree.first[u]) | (tree.first[tails] >= tree.first[u] + tree.size[u]))
        if (outside & self.there[self.into.edge[picks]]).any():
            return False
        value, lost = self.net.v[tree.t], tree.under[u]
        gone = nodes[tree.bridge[nodes] >= 0]
        self.total[tree.bridge[gone]] -= value * tree.under[gone]
        tree.bridge[nodes], tree.under[nodes], tree.alive[nodes] = -1, 0.0, False
        above = int(tree.idom[u])
        while above != tree.t:
            tree.under[above] -= lost
            if tree.bridge[above] >= 0:
                self.total[tree.bridge[above]] -= value * lost
            above = int(tree.idom[above])
        return True


def gains(net: Net, there: np.ndarray | None = None) -> np.ndarray:
    """The exact drop in risk of every edge if it alone is removed; 0 for edges that are gone or can't be."""
    return Gains(net, there).total


# ---------------------------------------------------------------- cuts


class _Flow:
    """Maximum flow by level graphs and blocking flows (Dinic), without recursion. Capacities are Python integers."""

    def __init__(self, n: int, tail: np.ndarray, head: np.ndarray, room: np.ndarray):
        """Arcs tail -> head with room; arc 2 i is the i-th, arc 2 i + 1 the way back."""
        ends = np.stack([tail, head], 1).ravel()
        order = np.argsort(ends, kind="stable")
        at = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
        arcs = order.tolist()
        self.out: list[list[int]] = [arcs[at[u] : at[u + 1]] for u in range(n)]
        self.to: list[int] = np.stack([head, tail], 1).ravel().tolist()
        self.room: list[int] = np.stack([room, np.zeros_like(room)], 1).ravel().tolist()

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for arc in self.out[u]:
                if self.room[arc] and level[self.to[arc]] < 0:
                    level[self.to[arc]] = level[u] + 1
                    queue.append(self.to[arc])
        return level

    def run(self, source: int, sink: int) -> int:
        total = 0
        while (level := self.levels(source))[sink] >= 0:
            cursor = [0] * len(self.out)
            path: list[int] = []
            u = source
            while True:
                if u == sink:
                    push = min(self.room[a] for a in path)
                    total += push
                    cut = 0
                    for i, a in enumerate(path):
                        self.room[a] -= push
                        self.room[a ^ 1] += push
                    cut = next(i for i, a in enumerate(path) if not self.room[a])
                    u = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while cursor[u] < len(self.out[u]):
                    arc = self.out[u][cursor[u]]
                    if self.room[arc] and level[self.to[arc]] == level[u] + 1:
                        break
                    cursor[u] += 1
                if cursor[u] < len(self.out[u]):
                    path.append(self.out[u][cursor[u]])
                    u = self.to[path[-1]]
                elif path:
                    arc = path.pop()
                    u = self.to[arc ^ 1]
                    cursor[u] += 1
                else:
                    break
        return total


def min_cut(net: Net, sources, sinks, there: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """(value, edges, sources that count): the cheapest removable edges between sources and sinks.

    Sources that are sinks, or that reach a sink along fixed edges alone, can't be protected and don't count. The
    edges are those that leave what the residual graph reaches from the sources: the cut nearest to the sources,
    the same for every maximum flow. No source that counts: value 0 and no edges.
    """
    return cut_on(net, sources, sinks, there)[:3]


def cut_on(net: Net, sources, sinks, there: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """min_cut, and the edges on ways from sources that count to sinks: as long as these are there and no source is
    added or lost, the cut is the same."""
    there = net.whole() if there is None else there
    sinks = np.asarray(sinks, np.int64)
    none = np.zeros(0, np.int64)
    if not len(sinks):
        return 0, none, none, none
    lost = backward(net, there & ~net.free).swept(sinks)
    sources = np.asarray(sources, np.int64)
    sources = sources[~lost[sources]]
    if not len(sources):
        return 0, none, none, none
    # only what lies on a way matters
    lit = forward(net, there).swept(sources) & backward(net, there).swept(sinks)
    edges = np.flatnonzero(there & lit[net.src] & lit[net.dst])
    endless = int(net.cost[net.free].sum()) + 1
    kept = np.flatnonzero(lit)
    n, new = len(kept), np.cumsum(lit) - 1
    src, dst, starts, ends = new[net.src[edges]], new[net.dst[edges]], new[sources[lit[sources]]], new[sinks[lit[sinks]]]
    tail = np.concatenate([src, np.full(len(starts), n), ends])
    head = np.concatenate([dst, starts, np.full(len(ends), n + 1)])
    room = np.concatenate([np.where(net.free[edges], net.cost[edges], endless), np.full(len(starts) + len(ends), endless)])
    flow = _Flow(n + 2, tail, head, room)
    value = flow.run(n, n + 1)
    near = np.array(flow.levels(n)[:n], np.int64) >= 0
    return value, edges[near[src] & ~near[dst]], sources, edges


def global_cut(net: Net, there: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    return min_cut(net, net.entries(), net.targets(), there)


# ---------------------------------------------------------------- reductions


def components(n: int, tail: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The smallest node of each node's strongly connected component: two sweeps over reversed finishing order."""
    out = Adjacency(n, tail, head, np.arange(len(tail)))
    ways, starts = out.next.tolist(), out.at.tolist()
    cursor, seen, order = starts[:-1].copy(), [False] * n, []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        stack = [root]
        while stack:
            u = stack[-1]
            if cursor[u] < starts[u + 1]:
                x = ways[cursor[u]]
                cursor[u] += 1
                if not seen[x]:
                    seen[x] = True
                    stack.append(x)
            else:
                order.append(u)
                stack.pop()
    back = Adjacency(n, head, tail, np.arange(len(tail)))
    ways, starts = back.next.tolist(), back.at.tolist()
    of = np.full(n, -1)
    for root in reversed(order):
        if of[root] >= 0:
            continue
        group, stack = [root], [root]
        of[root] = root
        while stack:
            u = stack.pop()
            for x in ways[starts[u] : starts[u + 1]]:
                if of[x] < 0:
                    of[x] = root
                    group.append(x)
                    stack.append(x)
        of[group] = min(group)
    return of


def settled(parent: np.ndarray) -> np.ndarray:
    """Every node's last parent, by doubling."""
    while (up := parent[parent]).tolist() != parent.tolist():
        parent = up
    return parent


@dataclass
class Reduced:
    """A reduced net; node: the reduced node of each original one (-1: gone); edge: likewise for edges."""

    net: Net
    node: np.ndarray
    edge: np.ndarray
    rounds: int = 0

    def original(self, gone: np.ndarray) -> np.ndarray:
        """The original edges that a removal of reduced edges (a boolean column, True: removed) stands for."""
        return np.flatnonzero((self.edge >= 0) & gone[np.maximum(self.edge, 0)]) if len(gone) else np.zeros(0, np.int64)


def contract(r: Reduced, rep: np.ndarray, keep: np.ndarray | None = None) -> Reduced:
    """r with node u merged into rep[u], and only the nodes keep.

    Weights and values add; parallel edges become one whose cost is the sum, fixed if any was; edges inside a merged
    node go. New nodes are numbered by their representatives.
    """
    net = r.net
    keep = np.ones(net.n, bool) if keep is None else keep
    names, at = np.unique(rep[keep], return_inverse=True)
    new = np.full(net.n, -1)
    new[keep] = at
    k = len(names)
    a, b = new[net.src], new[net.dst]
    stays = (a >= 0) & (b >= 0) & (a != b)
    pairs, of = np.unique(a[stays] * max(k, 1) + b[stays], return_inverse=True)
    edge = np.full(net.m, -1)
    edge[stays] = of
    m = len(pairs)
    fixed = np.bincount(of, weights=~net.free[stays], minlength=m) > 0
    cost = np.bincount(of, weights=net.cost[stays], minlength=m).astype(np.int64)
    w = np.bincount(at, weights=net.w[keep], minlength=k)
    v = np.bincount(at, weights=net.v[keep], minlength=k)
    made = Net.of(k, pairs // max(k, 1), pairs % max(k, 1), cost, ~fixed, w, v)
    through = lambda old, step: np.where(old >= 0, step[np.maximum(old, 0)], -1) if len(step) else old
    return Reduced(made, through(r.node, new), through(r.edge, edge), r.rounds)


def reduce(net: Net, rules=("R1", "R2", "R3", "R4")) -> Reduced:
    """A smaller net with the same optimum for every budget.

    R1 keeps nodes on ways from entries to targets. R2 merges what fixed edges connect strongly. R3 merges nodes that
    are no targets and whose edges out are all fixed and lead to the same nodes. R4 merges a node without weight and
    value into its only predecessor, or its only successor, if that edge is fixed. R2 to R4 repeat until none applies.
    """
    r = Reduced(net, np.arange(net.n), np.arange(net.m))
    if "R1" in rules:
        lit = forward(net, net.whole()).swept(net.entries()) & backward(net, net.whole()).swept(net.targets())
        r = contract(r, np.arange(net.n), lit)
    before = None
    while before != (r.net.n, r.net.m):
        before = r.net.n, r.net.m
        rounds = r.rounds + 1
        if "R2" in rules:
            fixed = ~r.net.free
            r = contract(r, components(r.net.n, r.net.src[fixed], r.net.dst[fixed]))
        if "R3" in rules:
            while (rep := twins(r.net)) is not None:
                r = contract(r, rep)
        if "R4" in rules:
            for inward in (True, False):
                r = contract(r, lone(r.net, inward))
        r.rounds = rounds
    return r


def twins(net: Net) -> np.ndarray | None:
    """Representatives by R3, or None if there are no twins."""
    loose = np.bincount(net.src[net.free], minlength=net.n) > 0
    may = (np.bincount(net.src, minlength=net.n) > 0) & ~loose & (net.v <= 0)
    rep, first = np.arange(net.n), {}
    out = forward(net, net.whole())
    for u in np.flatnonzero(may).tolist():
        rep[u] = first.setdefault(np.sort(out.next[out.at[u] : out.at[u + 1]]).tobytes(), u)
    return rep if (rep != np.arange(net.n)).any() else None


def lone(net: Net, inward: bool) -> np.ndarray:
    """Representatives by R4. All at once is safe: after R2 no fixed cycle is left, so chains end."""
    here, there = (net.dst, net.src) if inward else (net.src, net.dst)
    one = (np.bincount(here, minlength=net.n) == 1) & (net.w <= 0) & (net.v <= 0)
    e = np.flatnonzero(one[here] & ~net.free)
    parent = np.arange(net.n)
    parent[here[e]] = there[e]
    # without R2 a fixed cycle may be left: its smallest node stays
    for u in here[e].tolist():
        trail, x = {u}, int(parent[u])
        while parent[x] != x and x not in trail:
            trail.add(x)
            x = int(parent[x])
        if parent[x] != x and x in trail:
            parent[min(trail)] = min(trail)
    return settled(parent)


# ---------------------------------------------------------------- bounds and exact optimum


class _Sparse:
    """A sparse matrix as entries sorted by row and, again, by column; a product is a gather and sums of runs."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.shape = shape
        self.by_row = self._runs(rows, cols, values)
        self.by_column = self._runs(cols, rows, values)

    @staticmethod
    def _runs(key: np.ndarray, other: np.ndarray, values: np.ndarray):
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        return key[at], at, other[order], values[order]

    @staticmethod
    def _summed(runs, z: np.ndarray, n: int) -> np.ndarray:
        key, at, other, values = runs
        out = np.zeros(n)
        out[key] = np.add.reduceat(values * z[other], at)
        return out

    def times(self, z: np.ndarray) -> np.ndarray:
        return self._summed(self.by_row, z, self.shape[0])

    def transposed(self, d: np.ndarray) -> np.ndarray:
        return self._summed(self.by_column, d, self.shape[1])


def _scales(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Factors by row and column that bring a matrix's largest entries near 1 (Ruiz), then its norm to 1 at most (Pock and Chambolle)."""
    by_row, by_column = np.ones(shape[0]), np.ones(shape[1])

    def divide(row: np.ndarray, col: np.ndarray) -> None:
        for factor, by in ((by_row, row), (by_column, col)):
            factor /= np.sqrt(np.where(by > 0, by, 1.0))

    for _ in range(8):
        now = np.abs(values) * by_row[rows] * by_column[cols]
        row, col = np.zeros(shape[0]), np.zeros(shape[1])
        np.maximum.at(row, rows, now)
        np.maximum.at(col, cols, now)
        divide(row, col)
    now = np.abs(values) * by_row[rows] * by_column[cols]
    divide(np.bincount(rows, now, shape[0]), np.bincount(cols, now, shape[1]))
    return by_row, by_column


def lp_bound(net: Net, budget: int, there: np.ndarray | None = None, steps: int = 20_000, check: int = 40, tolerance: float = 1e-3) -> tuple[float, np.ndarray]:
    """(a certified lower bound on the risk within budget, fractional removals by edge).

    The relaxation: x in [0, 1] by removable edge, rho in [0, 1] by target and node that reaches it, rho(u) >= rho(next)
    - x, rho(target) = 1, cost x <= budget. Primal-dual steps (Chambolle and Pock) with the scaling, restarts from
    averages and primal weights of PDLP look for a saddle point, until primal and dual values are within tolerance of
    each other. The bound is the dual function at the best dual point met, which holds for any dual point >= 0, so
    also if steps run out first.
    """
    there = net.whole() if there is None else there
    lit = forward(net, there).swept(net.entries())
    cuttable = np.flatnonzero(there & net.free & lit[net.src])
    x_of = np.full(net.m, -1)
    x_of[cuttable] = np.arange(len(cuttable))
    n_vars, constant = len(cuttable), 0.0
    c, us, ys, xs, limits = [np.zeros(n_vars)], [], [], [], []
    for t, mask in reached_by(net, there).items():
        mask = mask & lit
        others = np.setdiff1d(np.flatnonzero(mask), [t])
        var = np.full(net.n, -1)
        var[others] = n_vars + np.arange(len(others))
        n_vars += len(others)
        c.append(net.v[t] * net.w[others])
        constant += net.v[t] * net.w[t] if lit[t] else 0.0
        e = np.flatnonzero(there & mask[net.src] & mask[net.dst] & (net.src != t))
        us.append(var[net.src[e]])
        ys.append(var[net.dst[e]])  # -1: the target, whose rho is 1
        xs.append(x_of[e])
        limits.append(np.where(net.dst[e] == t, -1.0, 0.0))
    k = sum(map(len, us))
    if budget <= 0 or not len(cuttable) or not k:
        return risk(net, there), np.zeros(net.m)
    # rows: rho(next) - x - rho(u) <= limit, then the budget
    u, y, x, limit = (np.concatenate(part) for part in (us, ys, xs, limits))
    on_y, on_x, paid = np.flatnonzero(y >= 0), np.flatnonzero(x >= 0), np.arange(len(cuttable))
    rows = np.concatenate([np.arange(k), on_y, on_x, np.full(len(paid), k)])
    cols = np.concatenate([u, y[on_y], x[on_x], paid])
    values = np.concatenate([-np.ones(k), np.ones(len(on_y)), -np.ones(len(on_x)), net.cost[cuttable].astype(float)])
    by_row, by_column = _scales(rows, cols, values, (k + 1, n_vars))
    matrix = _Sparse(rows, cols, values * by_row[rows] * by_column[cols], (k + 1, n_vars))
    h, c, top = np.append(limit, float(budget)) * by_row, np.concatenate(c) * by_column, 1.0 / by_column

    def judged(point):
        """(error, primal value, dual value, what rows are exceeded by) of z, Az, d and A'd."""
        z, az, d, atd = point
        over = float(np.linalg.norm(np.maximum(0.0, az - h)))
        primal, dual = constant + c @ z, constant - d @ h + np.minimum(0.0, (c + atd) * top).sum()
        return float(np.hypot(weight * over, primal - dual)), float(primal), float(dual), over

    weight = float(np.linalg.norm(c) / max(np.linalg.norm(h), TINY)) or 1.0
    point = (np.zeros(n_vars), np.zeros(k + 1), np.zeros(k + 1), np.zeros(n_vars))
    began, sums, n = point, tuple(np.zeros_like(part) for part in point), 0
    first = last = judged(point)[0]
    best, best_d, least, best_z = -np.inf, point[2], np.inf, point[0]
    for step in range(1, steps + 1):
        z, az, d, atd = point
        z = np.clip(z - 0.95 / weight * (c + atd), 0.0, top)
        ahead = matrix.times(z)
        d = np.maximum(0.0, d + 0.95 * weight * (2 * ahead - az - h))
        point = (z, ahead, d, matrix.transposed(d))
        for total, part in zip(sums, point):
            total += part
        n += 1
        if step % check:
            continue
        mean = tuple(total / n for total in sums)
        met = [(judged(p), p) for p in (point, mean)]
        for (_, primal, dual, over), p in met:
            if dual > best:
                best, best_d = dual, p[2]
            if (apart := abs(primal - dual) + over) < least:
                least, best_z = apart, p[0]
        (now, primal, dual, over), closer = min(met, key=lambda m: m[0][0])
        if abs(primal - dual) <= tolerance * max(1.0, abs(primal)) and over <= tolerance * max(1.0, float(np.linalg.norm(h))):
            break
        if now <= 0.2 * first or last < now <= 0.8 * first or n >= 0.36 * step:
            point = closer
            moved, turned = (float(np.linalg.norm(point[i] - began[i])) for i in (0, 2))
            if moved > TINY and turned > TINY:
                weight = float(np.sqrt(turned / moved * weight))
            began, sums, n = point, tuple(np.zeros_like(part) for part in point), 0
            first = last = judged(point)[0]
        else:
            last = now
    fractions = np.zeros(net.m)
    fractions[cuttable] = np.clip((best_z * by_column)[: len(cuttable)], 0.0, 1.0)
    # once more by itself, as averages carry rounding
    best = constant - best_d @ h + np.minimum(0.0, (c + matrix.transposed(best_d)) * top).sum()
    return max(0.0, float(best)), fractions


def exact(net: Net, budget: int, seconds: float | None = None, most_nodes: int | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, str, float]:
    """(edges still there, `optimal` or `feasible`, risk): branch and bound over removals.

    It runs to the proof unless it is given a limit: of nodes, with which reruns agree, or of seconds, with which they
    may not. A search that was cut short says `feasible`.

    A node's lower bound is the risk if every undecided edge it can pay for were gone. It branches on the undecided
    edge of greatest single gain, or that which most of the bound hangs on; the branch that removes comes first.
    """
    ends = None if seconds is None else time.monotonic() + seconds
    best_there = net.whole() if start is None else start.copy()
    best = risk(net, best_there)
    lit = forward(net, net.whole()).swept(net.entries()) & backward(net, net.whole()).swept(net.targets())
    undecided = net.free & lit[net.src] & lit[net.dst]
    stack = [(net.whole(), undecided, budget)]
    status, visited = "optimal", 0
    while stack:
        there, open_, left = stack.pop()
        visited += 1
        if (most_nodes is not None and visited > most_nodes) or (ends is not None and time.monotonic() > ends):
            status = "feasible"
            break
        open_ = open_ & (net.cost <= left)
        low = risk(net, there & ~open_)
        if low >= best - TINY:
            continue
        here = risk(net, there)
        if here < best - TINY:
            best, best_there = here, there
        if not open_.any():
            continue
        if int(net.cost[open_].sum()) <= left:  # all of it can go
            if low < best - TINY:
                best, best_there = low, there & ~open_
            continue
        g = np.where(open_, gains(net, there), -1.0)
        if g.max() > 0:
            e = int(np.argmax(g / np.maximum(net.cost, 1)))
        else:  # no edge helps alone: take one on a way that is left
            live = forward(net, there).swept(net.entries()) & backward(net, there).swept(net.targets())
            ways = np.flatnonzero(open_ & live[net.src] & live[net.dst])
            if not len(ways):
                continue
            e = int(ways[np.argmin(net.cost[ways])])
        rest = open_.copy()
        rest[e] = False
        stack.append((there, rest, left))
        gone = there.copy()
        gone[e] = False
        stack.append((gone, rest, left - int(net.cost[e])))
    return best_there, status, best
