"""A prefix tree over sets, searched for those that overlap enough with a set."""

from __future__ import annotations

import numpy as np


#: Ranks of a node at most, so that a search can end within a long run.
RUN = 64

#: Ranks times queries of one walk, at most.
CELLS = 1 << 21


class Ranks:
    """One order for the members of all sets of a group: the most frequent first."""

    def __init__(self, sets: list[np.ndarray]):
        members = np.concatenate(sets)
        found, place, times = np.unique(members, return_inverse=True, return_counts=True)
        order = np.lexsort((found, -times))
        rank = np.empty(len(found), np.int32)
        rank[order] = np.arange(len(found))
        self.size = len(found)
        ends = np.cumsum([len(s) for s in sets])
        self.sets = [np.sort(part) for part in np.split(rank[place.ravel()], ends[:-1])]


class Trie:
    """Sets as paths of ascending ranks; sets that begin alike share nodes.

    A node holds a run of ranks. With it are kept how many ranks lie on the
    path to its end, and the sizes of the smallest and largest set below.
    """

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">i4").tobytes())
        begin, end, source, parent, members = [0], [0], [order[0]], [-1], [[]]
        stack = [0]
        last = None
        for i in order:
            own, shared = sets[i], 0
            if last is not None:
                n = min(len(own), len(last))
                differs = np.flatnonzero(own[:n] != last[:n])
                shared = int(differs[0]) if len(differs) else n
            while end[stack[-1]] > shared:
                node = stack.pop()
                if begin[node] < shared:
                    # Only its first part is shared: a node of its own between the two.
                    begin.append(begin[node])
                    end.append(shared)
                    source.append(source[node])
                    parent.append(parent[node])
                    members.append([])
                    begin[node], parent[node] = shared, len(begin) - 1
                    stack.append(len(begin) - 1)
            for at in range(shared, len(own), RUN):
                begin.append(at)
                end.append(min(at + RUN, len(own)))
                source.append(i)
                parent.append(stack[-1])
                members.append([])
                stack.append(len(begin) - 1)
            members[stack[-1]].append(i)
            last = own
        n = len(begin)
        self.end = np.array(end)
        self.members = members
        self.runs = [sets[s][b:e] for s, b, e in zip(source, begin, end)]
        self.children: list[list[int]] = [[] for _ in range(n)]
        for node in range(1, n):
            self.children[parent[node]].append(node)
        self.least = np.full(n, np.iinfo(np.int64).max)
        self.most = np.zeros(n, np.int64)
        below, todo = [], [0]
        while todo:
            node = todo.pop()
            below.append(node)
            todo += self.children[node]
        for node in reversed(below):
            own = [len(sets[i]) for i in members[node]]
            lows = own + [int(self.least[c]) for c in self.children[node]]
            highs = own + [int(self.most[c]) for c in self.children[node]]
            self.least[node], self.most[node] = min(lows), max(highs)

    def similar(self, asked: list[np.ndarray], ranks: int, percent: int) -> list[tuple[int, int]]:
        """(set, query) of all pairs whose Jaccard similarity is percent or more.

        The queries walk the tree together. At a node each has its overlap with
        the path so far, which all sets below share; it goes on only if, with
        all ranks still to come, some size of a set below could be enough.
        """
        found: list[tuple[int, int]] = []
        many = max(1, CELLS // max(1, ranks))
        for first in range(0, len(asked), many):
            own = asked[first : first + many]
            sizes = np.array([len(q) for q in own])
            has = np.zeros((ranks, len(own)), np.uint8)
            has[np.concatenate(own), np.repeat(np.arange(len(own)), sizes)] = 1
            # How many of each query's ranks are no larger than a rank.
            passed = np.cumsum(has, axis=0, dtype=np.int32)
            todo = [(0, np.arange(len(own)), np.zeros(len(own), np.int64))]
            while todo:
                node, alive, overlap = todo.pop()
                run = self.runs[node]
                size = sizes[alive]
                to_come = size
                if len(run):
                    overlap = overlap + has[run].sum(axis=0, dtype=np.int32)[alive]
                    to_come = size - passed[run[-1]][alive]
                depth, least, most = self.end[node], self.least[node], self.most[node]
                # The size below that leaves most room: no larger than the query can still match.
                best = np.minimum(np.maximum(depth + to_come, least), most)
                hope = overlap + np.minimum(to_come, best - depth)
                able = hope * (100 + percent) >= percent * (size + best)
                able &= (most * 100 >= percent * size) & (least * percent <= 100 * size)
                if not able.any():
                    continue
                alive, overlap = alive[able], overlap[able]
                if self.members[node]:
                    enough = 100 * overlap >= percent * (size[able] + depth - overlap)
                    hits = (alive[enough] + first).tolist()
                    found += [(i, j) for i in self.members[node] for j in hits]
                todo += [(child, alive, overlap) for child in self.children[node]]
        return found


def links(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """Pairs (i in left, j in right) of sets at least percent alike, none of them empty; with
    right None, pairs i < j within left."""
    both = left + (right or [])
    if not left or right == [] or not any(map(len, both)):
        return []
    ranks = Ranks(both)
    tree = Trie(ranks.sets[: len(left)])
    if right is None:
        return [(i, j) for i, j in tree.similar(ranks.sets, ranks.size, percent) if i < j]
    return tree.similar(ranks.sets[len(left) :], ranks.size, percent)
