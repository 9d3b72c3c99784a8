"""A hierarchical navigable small-world graph of unit vectors, built and searched many rows at a time."""

from __future__ import annotations

import numpy as np

#: Links of a node above the ground level, links on it, beam while building, rows inserted or searched at once, nodes of a row's beam opened at once.
LINKS, GROUND, BUILD_BEAM, ROWS, OPENED = 12, 24, 48, 256, 4


def levels(n: int) -> np.ndarray:
    """A geometric level for each of ``n`` rows, drawn by the row's number."""
    x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    u = ((x >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.floor(-np.log(u) / np.log(LINKS)).astype(np.int64)


def beam(queries: np.ndarray, vectors: np.ndarray, links: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` nodes found most alike, best first, and their products; -1 where fewer were found.

    ``entries``: a row of nodes to begin from for each query, -1 for none. All
    queries advance together: each opens the best nodes of its beam that are
    not yet open and keeps the best of what it has seen.
    """
    n, rows = len(queries), np.arange(len(queries))[:, None]
    seen = np.zeros((n, len(links) + 1), bool)  # the last column stands for no node
    seen[:, -1] = True
    known, product = np.full((n, width), -1), np.full((n, width), -np.inf, np.float32)
    opened = np.zeros((n, width), bool)
    fresh = np.sort(entries, axis=1)
    while True:
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        new = ~seen[rows, fresh]
        seen[rows, fresh] = True
        if not new.any():
            break
        value = np.full(fresh.shape, -np.inf, np.float32)
        at, place = np.nonzero(new)
        value[at, place] = np.einsum("ij,ij->i", queries[at], vectors[fresh[at, place]])
        known, product, opened = np.hstack([known, fresh]), np.hstack([product, value]), np.hstack([opened, np.zeros_like(new)])
        best = np.argpartition(-product, width - 1, axis=1)[:, :width]
        known, product, opened = known[rows, best], product[rows, best], opened[rows, best]
        waiting = np.where(opened | ~np.isfinite(product), -np.inf, product)
        few = min(OPENED, width)
        top = np.argpartition(-waiting, few - 1, axis=1)[:, :few]
        live = np.isfinite(waiting[rows, top])
        opened[rows, top] |= live
        fresh = np.where(live[:, :, None], links[np.where(live, known[rows, top], 0)], -1).reshape(n, -1)
        fresh.sort(axis=1)
    order = np.argsort(-product, axis=1, kind="stable")
    known, product = known[rows, order], product[rows, order]
    return np.where(np.isfinite(product), known, -1), product


def chosen(found: np.ndarray, product: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates of each row (best first) up to ``most`` that are nearer to it than to one chosen before; free places go to the nearest others."""
    n, wide = found.shape
    x = vectors[np.maximum(found, 0)]
    between = x @ x.transpose(0, 2, 1)
    there, taken, closest = found >= 0, np.zeros((n, wide), bool), np.full((n, wide), -np.inf, np.float32)
    for k in range(wide):
        take = there[:, k] & (product[:, k] > closest[:, k]) & (taken.sum(axis=1) < most)
        taken[:, k] = take
        closest[take] = np.maximum(closest[take], between[take, k])
    order = np.argsort(np.where(taken, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(np.where(there, found, -1), order, axis=1)


class SmallWorld:
    """Nodes are numbered from the highest level down: ``order`` has the row of ``vectors`` for each node, ``links[l]`` the links of the nodes on level l."""

    def __init__(self, vectors: np.ndarray, order: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.order, self.links = vectors, order, links

    @classmethod
    def build(cls, rows: np.ndarray) -> SmallWorld:
        """The graph of float32 unit vectors; the same rows give the same graph."""
        level = levels(len(rows))
        order = np.argsort(-level, kind="stable")
        level, vectors = level[order], np.ascontiguousarray(rows[order])
        high = int(level[0]) if len(rows) else -1
        graph = cls(vectors, order, [np.full((int((level >= k).sum()), GROUND if k == 0 else LINKS), -1, np.int32) for k in range(high + 1)])
        a = 1
        while a < len(rows):
            b = min(len(rows), a + min(ROWS, a))  # no more at once than are there to link with
            graph.insert(a, b, level)
            a = b
        return graph

    def insert(self, a: int, b: int, level: np.ndarray) -> None:
        """Link nodes a to b - 1 with those before them and among themselves."""
        queries = self.vectors[a:b]
        among = queries @ queries.T
        np.fill_diagonal(among, -np.inf)
        start = np.zeros((b - a, 1), np.int64)
        for k in range(len(self.links) - 1, -1, -1):
            links = self.links[k]
            here = level[a:b] >= k
            if len(links) <= 1 or a == 0:
                continue
            before = links[:a]
            width = min(BUILD_BEAM if here.any() else 1, a)
            found, product = beam(queries, self.vectors, before, start, width)
            start = found[:, :1].copy()
            if not here.any():
                continue
            # the nearest of the rows that are inserted with it
            near = np.where(here[None, :], among, -np.inf)[here]
            some = min(LINKS, near.shape[1])
            by = np.argpartition(-near, some - 1, axis=1)[:, :some]
            value = np.take_along_axis(near, by, axis=1)
            found = np.hstack([found[here], np.where(np.isfinite(value), by + a, -1)])
            product = np.hstack([np.where(found[:, :width] >= 0, product[here], -np.inf), value])
            best = np.argsort(-product, axis=1, kind="stable")
            found, product = np.take_along_axis(found, best, axis=1), np.take_along_axis(product, best, axis=1)
            nodes = np.flatnonzero(here) + a
            out = chosen(found, product, self.vectors, LINKS)
            links[nodes, : out.shape[1]] = out
            self.link_back(links, np.repeat(nodes, out.shape[1]), out.ravel())

    def link_back(self, links: np.ndarray, new: np.ndarray, to: np.ndarray) -> None:
        """Nodes ``to`` also link to those that chose them; where there is no room the choice is made anew."""
        new, to = new[to >= 0], to[to >= 0]
        most = links.shape[1]
        order = np.argsort(to, kind="stable")
        new, to = new[order], to[order]
        at, first, count = np.unique(to, return_index=True, return_counts=True)
        # a node that many chose at once meets them in turns of as many as it has links
        for turn in range(0, int(count.max(initial=0)), most):
            now = count > turn
            nodes = at[now]
            place = first[now][:, None] + turn + np.arange(most)
            more = np.where(np.arange(most)[None, :] + turn < count[now][:, None], new[np.minimum(place, len(new) - 1)], -1)
            full = np.hstack([links[nodes], more])
            full.sort(axis=1)
            full[:, 1:][full[:, 1:] == full[:, :-1]] = -1
            size = (full >= 0).sum(axis=1)
            easy = size <= most
            if easy.any():
                links[nodes[easy]] = -np.sort(-full[easy], axis=1)[:, :most]
            for s in range(0, int((~easy).sum()), ROWS):
                some, cand = nodes[~easy][s : s + ROWS], full[~easy][s : s + ROWS]
                value = np.where(cand >= 0, np.einsum("ij,ikj->ik", self.vectors[some], self.vectors[np.maximum(cand, 0)]), -np.inf)
                best = np.argsort(-value, axis=1, kind="stable")
                links[some] = chosen(np.take_along_axis(cand, best, axis=1), np.take_along_axis(value, best, axis=1), self.vectors, most)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes (-1 for none) and products of the best ``width`` found for each query."""
        start = np.zeros((len(queries), 1), np.int64)
        for k in range(len(self.links) - 1, 0, -1):
            start, _ = beam(queries, self.vectors, self.links[k], start, 1)
        return beam(queries, self.vectors, self.links[0], start, min(width, len(self.vectors)))
