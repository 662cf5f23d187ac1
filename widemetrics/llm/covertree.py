"""Exact inner-product search with a cover tree of the queries and one of the data."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Each level's covering radius is the one above over this.
BASE = 1.5
#: Nodes of at most so many points are not divided.
LEAF = 48


@dataclass
class Node:
    """A centre (one of the points), the radius that covers its points, and where they lie."""

    centre: np.ndarray
    radius: float
    begin: int
    end: int
    children: list[Node] = field(default_factory=list)
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def grown(points: np.ndarray) -> tuple[Node, np.ndarray]:
    """The tree over the points, and the order in which its nodes hold them.

    A node's points are covered greedily by balls of the next smaller radius:
    around its own centre, then around the point farthest from it that is left.
    So centres of one level lie farther apart than the radius of that level.
    """
    order = np.empty(len(points), np.int64)

    def node(own: np.ndarray, centre: int, distance: np.ndarray, begin: int) -> Node:
        radius = float(distance.max()) if len(own) else 0.0
        made = Node(points[centre], radius, begin, begin + len(own))
        if len(own) <= LEAF or radius == 0:
            order[begin : begin + len(own)] = own
            return made
        left, at = np.arange(len(own)), begin
        reach, far = distance, centre
        while len(left):
            near = reach <= radius / BASE
            near[reach == 0] = True
            child = node(own[left[near]], far, reach[near], at)
            at = child.end
            made.children.append(child)
            left = left[~near]
            if len(left):
                far = own[left[np.argmax(distance[left])]]
                reach = np.linalg.norm(points[own[left]] - points[far], axis=1)
        made.centres = np.stack([c.centre for c in made.children])
        made.radii = np.array([c.radius for c in made.children])
        return made

    all_points = np.arange(len(points))
    return node(all_points, 0, np.linalg.norm(points - points[0], axis=1), 0), order


class Best:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k = k
        self.scores: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        #: What a score must reach to count; known from elsewhere or the kth here.
        self.worst = np.full(n, -np.inf) if floor is None else floor.astype(np.float64)

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """scores of the queries (rows) with the candidates ids; a query's own id is left out."""
        good = (scores.astype(np.float64) >= self.worst[queries][:, None]) & (ids[None, :] != own[queries][:, None])
        for row in np.flatnonzero(good.any(axis=1)):
            hit = np.flatnonzero(good[row])
            value = scores[row, hit]
            if len(hit) > self.k:
                least = np.partition(value, len(hit) - self.k)[len(hit) - self.k]
                hit = hit[value >= least]
            q = int(queries[row])
            held = self.scores[q] + [(-int(scores[row, i]), int(ids[i])) for i in hit]
            held.sort()
            self.scores[q] = held[: self.k]
            if len(held) >= self.k:
                self.worst[q] = max(self.worst[q], -held[self.k - 1][0])


def searched(
    queries: np.ndarray, query_ids: np.ndarray, tree: Node, points: np.ndarray, ids: np.ndarray,
    k: int, floor: np.ndarray | None = None, exact=None,
) -> Best:
    """The best k points for each query, both trees walked together.

    points and ids are in the tree's order. For a node of queries (centre q,
    radius s) and one of points (centre p, radius r) no product exceeds
    q.p + |q| r + |p| s + r s; the pair is left out if that is below the worst
    kth score of all the queries in the node. Scores are exact(queries, points),
    by default float products, which are exact below 2**53.
    """
    exact = exact or (lambda a, b: a @ b.T)
    query_tree, order = grown(queries)
    queries, own = queries[order], query_ids[order]
    best = Best(len(queries), k, None if floor is None else floor[order])

    def visit(q: Node, p: Node) -> None:
        worst = best.worst[q.begin : q.end].min()
        nodes = p.children or [p]
        centres = p.centres if p.children else p.centre[None, :]
        radii = p.radii if p.children else np.array([p.radius])
        norms = np.linalg.norm(centres, axis=1)
        bound = centres @ q.centre + np.linalg.norm(q.centre) * radii + (norms + radii) * q.radius
        # Also what rounding may take where large terms cancel.
        bound += 1e-9 * (1 + np.abs(bound)) + 1e-12 * (np.linalg.norm(q.centre) + q.radius) * (norms + radii)
        plain: list[Node] = []
        for i in np.argsort(-bound):
            if bound[i] < worst:
                break
            if nodes[i].children:
                for part in q.children or [q]:
                    visit(part, nodes[i])
                worst = best.worst[q.begin : q.end].min()
            else:
                plain.append(nodes[i])
                if sum(x.end - x.begin for x in plain) >= 512:
                    compare(q, plain)
                    plain = []
                    worst = best.worst[q.begin : q.end].min()
        if plain:
            compare(q, plain)

    def compare(q: Node, nodes: list[Node]) -> None:
        at = np.concatenate([np.arange(n.begin, n.end) for n in nodes])
        rows = np.arange(q.begin, q.end)
        best.offer(rows, exact(queries[rows], points[at]), ids[at], own)

    if len(queries) and len(points):
        visit(query_tree, tree)
    back = Best(len(queries), k)
    for i, place in enumerate(order):
        back.scores[place], back.worst[place] = best.scores[i], best.worst[i]
    return back
