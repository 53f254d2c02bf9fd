"""Measures of one small graph, in numpy. A graph is arrays of source and target numbers (0..n-1) and strengths."""

from __future__ import annotations

import heapq

import numpy as np


def collapse(n: int, source: np.ndarray, target: np.ndarray, strength: np.ndarray, reciprocal: str = "later_node") -> np.ndarray:
    """Symmetric weights: reciprocal arcs summed, or (`later_node`) the arc leaving the later node replaces the other."""
    w = np.zeros((n, n))
    if reciprocal == "sum":
        np.add.at(w, (source, target), strength)
        w = w + w.T
    else:
        w[source, target] = strength
        there = np.zeros((n, n), dtype=bool)
        there[source, target] = True
        w = np.tril(np.where(there, w, w.T))
        w = w + np.tril(w, -1).T
    np.fill_diagonal(w, 0.0)
    return w


def largest_component(w: np.ndarray) -> np.ndarray:
    """Nodes of the largest component with an edge in it; of equals, the one with the earliest node."""
    left, best = set(range(len(w))), []
    for start in range(len(w)):
        if start not in left:
            continue
        seen, stack = {start}, [start]
        while stack:
            for v in np.flatnonzero(w[stack.pop()]):
                if v not in seen:
                    seen.add(int(v))
                    stack.append(int(v))
        left -= seen
        if len(seen) > len(best):
            best = sorted(seen)
    return np.array(best, dtype=np.int64)


def flow_scores(h: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Current-flow betweenness of a connected graph's nodes from its weights and the pseudo-inverse of its Laplacian.

    For each edge, the current through it for a unit from s to t is F[s] - F[t] with
    F = w * (row i - row j) of the pseudo-inverse; a node carries half of what its edges
    carry over all pairs of which it is no end.
    """
    n = len(h)
    i, j = np.nonzero(np.triu(h))
    flow = h[i, j][:, None] * (inverse[i] - inverse[j])
    # Sum of |F[s] - F[t]| over pairs, and over the pairs that i or j end, from the sorted values.
    total = np.sort(flow, axis=1) @ (2 * np.arange(n) - n + 1)
    score = np.zeros(n)
    edge = np.arange(len(i))
    for end in (i, j):
        np.add.at(score, end, (total - np.abs(flow - flow[edge, end][:, None]).sum(axis=1)) / 2)
    return score * (2.0 / ((n - 1) * (n - 2)))


def current_flow(w: np.ndarray) -> dict[int, float]:
    """Normalised current-flow betweenness on the largest component of symmetric weights; none for fewer than three nodes."""
    return FlowSeries().step(w)


class FlowSeries:
    """current_flow() of graphs that follow one another, each a little different from the one before.

    While the largest component keeps its nodes and few edges change, the Laplacian's
    pseudo-inverse is brought up to date by one change of rank one for each changed edge:
    stronger edges first, so that the graph stays connected in between. Else, and after
    `renew` graphs, so that rounding doesn't add up, it is worked out anew.
    """

    def __init__(self, renew: int = 32):
        self.renew, self.age = renew, 0
        self.nodes = np.zeros(0, dtype=np.int64)
        self.weights = self.inverse = np.zeros((0, 0))

    def step(self, w: np.ndarray) -> dict[int, float]:
        nodes = largest_component(w)
        if len(nodes) < 3:
            self.nodes = np.zeros(0, dtype=np.int64)
            return {}
        h = w[np.ix_(nodes, nodes)]
        if not self._updated(nodes, h):
            self.inverse, self.age = np.linalg.pinv(np.diag(h.sum(axis=1)) - h), 0
        self.nodes, self.weights = nodes, h
        return {int(v): float(x) for v, x in zip(nodes, flow_scores(h, self.inverse))}

    def _updated(self, nodes: np.ndarray, h: np.ndarray) -> bool:
        if not np.array_equal(nodes, self.nodes) or self.age >= self.renew:
            return False
        change = h - self.weights
        i, j = np.nonzero(np.triu(change))
        # An inversion costs about as much as so many changes.
        if len(i) > len(nodes) // 4:
            return False
        for k in np.argsort(-change[i, j], kind="stable"):
            a, b, by = i[k], j[k], change[i[k], j[k]]
            column = self.inverse[:, a] - self.inverse[:, b]
            below = 1.0 + by * (column[a] - column[b])
            if below < 1e-9:
                return False
            self.inverse = self.inverse - np.outer(column, column) * (by / below)
        self.age += 1
        return True


def shortest(n: int, arcs: list[list[tuple[int, float]]], start: int) -> tuple[np.ndarray, list[list[int]], list[int]]:
    """(distances, all predecessors on shortest paths, nodes in order of distance); costs tie only when exactly equal."""
    distance, before, done, order = np.full(n, np.inf), [[] for _ in range(n)], [False] * n, []
    distance[start], heap = 0.0, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if done[u]:
            continue
        done[u] = True
        order.append(u)
        for v, cost in arcs[u]:
            if d + cost < distance[v]:
                distance[v], before[v] = d + cost, [u]
                heapq.heappush(heap, (d + cost, v))
            elif d + cost == distance[v]:
                before[v].append(u)
    return distance, before, order


def arc_lists(n: int, source: np.ndarray, target: np.ndarray, cost: np.ndarray) -> list[list[tuple[int, float]]]:
    arcs: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for s, t, c in zip(source.tolist(), target.tolist(), cost.tolist()):
        arcs[s].append((t, c))
    return arcs


def betweenness(n: int, source: np.ndarray, target: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Directed betweenness by dependency accumulation, divided by (n - 1)(n - 2)."""
    arcs, score = arc_lists(n, source, target, distance), np.zeros(n)
    for s in range(n):
        _, before, order = shortest(n, arcs, s)
        paths, share = np.zeros(n), np.zeros(n)
        paths[s] = 1.0
        for v in order[1:]:
            paths[v] = sum(paths[u] for u in before[v])
        for v in reversed(order[1:]):
            for u in before[v]:
                share[u] += paths[u] / paths[v] * (1 + share[v])
            score[v] += share[v]
    return score / ((n - 1) * (n - 2)) if n > 2 else score


def pagerank(n: int, source: np.ndarray, target: np.ndarray, strength: np.ndarray, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> np.ndarray | None:
    """Weighted PageRank by power iteration; None if it doesn't settle."""
    if not n:
        return np.zeros(0)
    out = np.zeros((n, n))
    np.add.at(out, (source, target), strength)
    total = out.sum(axis=1)
    loose = total == 0
    out[~loose] /= total[~loose, None]
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        after = damping * (x @ out + x[loose].sum() / n) + (1 - damping) / n
        if np.abs(after - x).sum() < n * tolerance:
            return after
        x = after
    return None


def path_share(n: int, source: np.ndarray, target: np.ndarray, distance: np.ndarray, broker: int, a: int, b: int) -> float:
    """Mean over both directions of the share of shortest a-b paths with the broker strictly inside; a direction without a path doesn't count."""
    arcs, shares = arc_lists(n, source, target, distance), []
    for s, t in ((a, b), (b, a)):
        reach, before, order = shortest(n, arcs, s)
        if not np.isfinite(reach[t]):
            continue
        every, through = np.zeros(n), np.zeros(n)
        every[s] = 1.0
        for v in order[1:]:
            every[v] = sum(every[u] for u in before[v])
            through[v] = sum(every[u] if u == broker and u != s else through[u] for u in before[v])
        shares.append(float(through[t] / every[t]) if every[t] else 0.0)
    return float(np.mean(shares)) if shares else 0.0
