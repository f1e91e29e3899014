"""Robust-pruned neighbour graphs of unit vectors, and range search on them. Runs inside tasks, on one shard at a time."""

from __future__ import annotations

import numpy as np


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to `degree` of its candidates: the nearest one is kept and drops those that are
    alpha times nearer to it than to the node, and so on. -1 fills the rest. Distance is 1 - cosine."""
    c = x[candidates]
    far = 1 - np.einsum("bcd,bd->bc", c, x[nodes])
    far[candidates == nodes[:, None]] = np.inf
    order = np.argsort(far, axis=1, kind="stable")
    rows = np.arange(len(nodes))[:, None]
    candidates, far, c = candidates[rows, order], far[rows, order], c[rows, order]
    between = 1 - np.matmul(c, c.transpose(0, 2, 1))
    alive = np.isfinite(far)
    out = np.full((len(nodes), degree), -1, np.int64)
    for k in range(degree):
        best = alive.argmax(axis=1)
        some = alive[rows[:, 0], best]
        if not some.any():
            break
        out[some, k] = candidates[rows[:, 0], best][some]
        alive &= ~(alpha * between[rows[:, 0], best] <= far)
        alive[rows[:, 0], best] = False
    return out


def build(x: np.ndarray, degree: int = 16, near: int = 40, wild: int = 16, alpha: float = 1.2, seed: int = 7) -> tuple[list[np.ndarray], int]:
    """(neighbours of each node, medoid). Candidates are the nearest nodes, some random ones and the medoid; edges go both
    ways; nodes the medoid does not reach are tied to the nearest one that it does."""
    n = len(x)
    medoid = int(np.argmax(x @ x.mean(axis=0)))
    rng = np.random.default_rng(seed)
    out = []
    for a in range(0, n, 256):
        nodes = np.arange(a, min(n, a + 256))
        sims = x[nodes] @ x.T
        top = np.argpartition(-sims, min(near, n - 1), axis=1)[:, : near + 1]
        extra = rng.integers(0, n, (len(nodes), wild))
        both = np.sort(np.concatenate([top, extra, np.full((len(nodes), 1), medoid)], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = nodes[:, None].repeat(both.shape[1] - 1, 1)[both[:, 1:] == both[:, :-1]]
        out.append(robust_prune(x, nodes, both, degree, alpha))
    graph = np.concatenate(out)
    src, slot = np.nonzero(graph >= 0)
    edges = np.unique(np.concatenate([src * n + graph[src, slot], graph[src, slot] * n + src]))
    src, dst = edges // n, edges % n
    # At most 4 * degree edges a node, nearest first, but every node keeps the ones that lead to it from its nearest degree / 2.
    sims = np.einsum("ij,ij->i", x[src], x[dst])
    keep = (_place(src, sims) < 4 * degree) | (_place(dst, sims) < degree // 2)
    src, dst = src[keep], dst[keep]
    lists = np.split(dst, np.searchsorted(src, np.arange(1, n)))
    reached = np.zeros(n, bool)
    frontier = [medoid]
    while True:
        reached[frontier] = True
        while len(frontier):
            frontier = np.unique(np.concatenate([lists[i] for i in frontier])).astype(np.int64)
            frontier = frontier[~reached[frontier]]
            reached[frontier] = True
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return lists, medoid
        there = np.flatnonzero(reached)
        best = [there[int(np.argmax(x[there] @ x[i]))] for i in rest[:1]]
        lists[best[0]] = np.append(lists[best[0]], rest[0])
        lists[rest[0]] = np.append(lists[rest[0]], best[0])
        frontier = rest[:1]


def _place(group: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Rank of each entry in its group, most similar first."""
    order = np.lexsort((-sims, group))
    sorted_group = group[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_group[1:] != sorted_group[:-1]])) if len(group) else np.zeros(0, np.int64)
    rank = np.empty(len(group), np.int64)
    rank[order] = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return rank


def padded(lists: list[np.ndarray]) -> np.ndarray:
    width = max((len(v) for v in lists), default=0)
    out = np.full((len(lists), max(1, width)), -1, np.int64)
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def range_search(x: np.ndarray, graph: np.ndarray, medoid: int, queries: np.ndarray, own: np.ndarray, floor: float, beam: int, slack: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with cosine >= floor that the search meets.

    Greedy search from the medoid, and from the query's own node where it has one (own >= 0), with a list of `beam` candidates;
    then the range expands: neighbours of every node within the floor less a slack are looked at until none is new.
    """
    found = []
    for a in range(0, len(queries), 256):
        q, mine = queries[a : a + 256], own[a : a + 256]
        rows = np.arange(len(q))
        seen = np.zeros((len(q), len(x)), bool)
        ids = np.full((len(q), beam), -1, np.int64)
        sims = np.full((len(q), beam), -np.inf)
        done = np.zeros((len(q), beam), bool)
        met_q, met_n, met_s = [], [], []

        def look(who: np.ndarray, nodes: np.ndarray) -> np.ndarray:
            """Cosines of nodes not seen before; the others and fillers get -inf."""
            ok = (nodes >= 0) & ~seen[who[:, None], nodes]
            i, j = np.nonzero(ok)
            n = nodes[i, j]
            # A node may stand twice in a row of one step: the first place counts.
            key, first = np.unique(who[i] * len(x) + n, return_index=True)
            i, j, n = i[first], j[first], n[first]
            seen[who[i], n] = True
            s = np.einsum("ij,ij->i", q[who[i]], x[n])
            out = np.full(nodes.shape, -np.inf)
            out[i, j] = s
            good = s >= floor - slack
            met_q.append(who[i][good])
            met_n.append(n[good])
            met_s.append(s[good])
            return out

        live, new = rows, np.stack([np.full(len(q), medoid), mine], axis=1)
        while len(live):
            s = look(live, new)
            every, all_s = np.concatenate([ids[live], new], axis=1), np.concatenate([sims[live], s], axis=1)
            flags = np.concatenate([done[live], np.zeros(s.shape, bool)], axis=1)
            top = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            r = np.arange(len(live))[:, None]
            ids[live], sims[live], done[live] = every[r, top], all_s[r, top], flags[r, top]
            todo = ~done[live] & np.isfinite(sims[live])
            live = live[todo.any(axis=1)]
            if len(live):
                slot = (~done[live] & np.isfinite(sims[live])).argmax(axis=1)
                done[live, slot] = True
                new = graph[ids[live, slot]]
        i, n, s = np.concatenate(met_q), np.concatenate(met_n), np.concatenate(met_s)
        while len(i):
            hit = s >= floor
            found.append(np.stack([i[hit] + a, n[hit]]))
            met_q, met_n, met_s = [], [], []
            for b in range(0, len(i), 8192):
                # One row per query and step keeps look() simple: pairs of one query are spread over rows.
                look(i[b : b + 8192], graph[n[b : b + 8192]])
            i, n, s = np.concatenate(met_q), np.concatenate(met_n), np.concatenate(met_s)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(found, axis=1))
