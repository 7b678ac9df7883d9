"""A hierarchical navigable small-world graph over the vectors of one shard, in flat arrays.

Points are in order of their level, highest first, so the points of a level are a prefix of all; links[l] is an array of a row of
neighbours for each of them, filled up with -1. Likeness is the inner product; to be a nearness, vectors are of one length
(see lengthened() in neighbours.py).

Points are inserted in batches that at most double the graph. All points of a batch walk down the levels in step, with a beam
of `reach` candidates on the levels where they are to be linked; members of one batch see each other exactly. Of the
candidates a point links to those that are nearer to it than to any neighbour chosen before, then to the nearest of the rest
up to a bound, and a neighbour with too many links chooses among them in the same way."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

LOW = np.float32(-np.inf)


def _chosen(vectors: np.ndarray, ids: np.ndarray, likeness: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (-1: none), the neighbours: those nearer to the row's point than to any chosen before, then the
    nearest others, up to `most`; filled up with -1."""
    order = np.argsort(-likeness, axis=1, kind="stable")
    ids, likeness = np.take_along_axis(ids, order, 1), np.take_along_axis(likeness, order, 1)
    own = vectors[ids]
    each = own @ own.transpose(0, 2, 1)
    n, m = ids.shape
    nearest = np.full((n, m), LOW)  # likeness of each candidate to the chosen one that is nearest to it
    chosen, count = np.zeros((n, m), bool), np.zeros(n, np.int64)
    for j in range(m):
        good = (ids[:, j] >= 0) & (likeness[:, j] > nearest[:, j]) & (count < most)
        chosen[:, j] = good
        count += good
        np.maximum(nearest, np.where(good[:, None], each[:, j], LOW), out=nearest)
    rank = np.where(chosen, 0, np.where(ids >= 0, 1, 2)) * m + np.arange(m)
    first = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(ids, first, 1)
    return out if m >= most else np.pad(out, ((0, 0), (0, most - m)), constant_values=-1)


class Graph:
    """vectors: float32, a row a point, in the order in which points are to be inserted but for their levels."""

    def __init__(self, vectors: np.ndarray, width: int = 16, reach: int = 64, seed: int = 42, batch: int = 512):
        n = len(vectors)
        draw = np.random.default_rng(seed).random(n)
        level = np.floor(-np.log(1 - draw) / math.log(width)).astype(np.int64)
        self.order = np.argsort(-level, kind="stable")
        self.vectors, self.width = np.ascontiguousarray(vectors[self.order]), width
        top = int(level.max(initial=0))
        self.links = [np.full((int((level >= k).sum()), width * (1 if k else 2)), -1, np.int32) for k in range(top + 1)]
        at = 0
        while at < n:
            upto = min(n, at + min(batch, max(32, at)))
            self._insert(at, upto, reach)
            at = upto

    def _insert(self, at: int, upto: int, reach: int) -> None:
        new = np.arange(at, upto)
        own = self.vectors[new]
        near = np.zeros((len(new), 1), np.int32) if at else np.empty((len(new), 0), np.int32)
        for level in range(len(self.links) - 1, -1, -1):
            links = self.links[level]
            there = min(at, len(links))
            mine = int(np.clip(len(links) - at, 0, len(new)))  # the batch's first are on this level
            if there:
                found = np.concatenate([part for _, part, _ in self._walk(links, own, near, reach if mine else 1)])
                near = found
            if mine:
                ids = near[:mine] if there else np.empty((mine, 0), np.int32)
                both = np.concatenate((ids, np.broadcast_to(new[:mine].astype(np.int32), (mine, mine))), axis=1) if mine <= reach else self._with_batch(ids, new[:mine], own[:mine], reach)
                like = self._likeness(both, own[:mine])
                like[both == new[:mine, None]] = LOW
                both = np.where(both == new[:mine, None], -1, both)
                links[new[:mine]] = np.pad(_chosen(self.vectors, both, like, self.width), ((0, 0), (0, links.shape[1] - self.width)), constant_values=-1)
                self._link_back(links, new[:mine])

    def _with_batch(self, ids: np.ndarray, new: np.ndarray, own: np.ndarray, reach: int) -> np.ndarray:
        """ids and the nearest `reach` of the batch itself."""
        like = own @ own.T
        np.fill_diagonal(like, LOW)
        k = min(reach, len(new) - 1)
        best = np.argpartition(-like, k - 1, axis=1)[:, :k]
        return np.concatenate((ids, new[best].astype(np.int32)), axis=1)

    def _likeness(self, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = (self.vectors[ids] @ of[:, :, None])[:, :, 0]
        out[ids < 0] = LOW
        return out

    def _link_back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Each neighbour of the new points links to them too."""
        most = links.shape[1]
        source, target = np.repeat(new, most), links[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        like = np.einsum("nd,nd->n", self.vectors[source], self.vectors[target])
        order = np.lexsort((-like, target))
        source, target = source[order], target[order]
        of, first, counts = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, counts)
        rows = np.repeat(np.arange(len(of)), counts)
        near = rank < most
        incoming = np.full((len(of), most), -1, np.int32)
        incoming[rows[near], rank[near]] = source[near]
        both = np.sort(np.concatenate((links[of], incoming), axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1  # two new points can have chosen each other
        both = -np.sort(-both, axis=1)
        few = (both >= 0).sum(axis=1) <= most
        links[of[few]] = both[few][:, :most]
        if not few.all():
            many = both[~few]
            for k in range(0, len(many), 512):
                ids, rows = many[k : k + 512], of[~few][k : k + 512]
                links[rows] = _chosen(self.vectors, ids, self._likeness(ids, self.vectors[rows]), most)

    def _walk(self, links: np.ndarray, queries: np.ndarray, near: np.ndarray, reach: int, wide: int = 4) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Best-first search on one level from the points in near, for slices of the queries: slice, ids and likenesses of the
        `reach` best found (-1: fewer), in no order."""
        step = max(1, min(512, (16 << 20) // max(1, len(links))))
        for start in range(0, len(queries), step):
            part = slice(start, min(len(queries), start + step))
            yield part, *self._walk_all(links, queries[part], near[part], reach, min(wide, reach))

    def _walk_all(self, links: np.ndarray, queries: np.ndarray, near: np.ndarray, reach: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(queries)
        seen = np.zeros((n, len(links)), np.int32)
        once = 0  # marks of points seen are told apart, so a point that two candidates lead to is taken once
        ids, like = np.full((n, max(reach, near.shape[1])), -1, np.int32), np.full((n, max(reach, near.shape[1])), LOW)
        ids[:, : near.shape[1]] = near
        like[:, : near.shape[1]] = self._likeness(near, queries)
        known = np.nonzero(near >= 0)
        seen[known[0], near[known]] = -1
        if ids.shape[1] > reach:
            best = np.argpartition(-like, reach - 1, axis=1)[:, :reach]
            ids, like = np.take_along_axis(ids, best, 1), np.take_along_axis(like, best, 1)
        open_ = ids >= 0
        marks = seen.reshape(-1)
        live = np.arange(n)  # queries with an open candidate
        while len(live):
            waiting = np.where(open_[live], like[live], LOW)
            if wide < reach:
                pick = np.argpartition(-waiting, wide - 1, axis=1)[:, :wide]
            else:
                pick = np.broadcast_to(np.arange(reach), (len(live), reach))
            real = np.take_along_axis(waiting, pick, 1) > LOW
            at = np.take_along_axis(ids[live], pick, 1)
            open_[live[:, None], pick] = False
            rows, cols = np.nonzero(real)
            next_ = links[at[rows, cols]]
            query = np.repeat(live[rows], links.shape[1])
            next_ = next_.ravel()
            good = next_ >= 0
            query, next_ = query[good], next_[good]
            flat = query * len(links) + next_
            flat = flat[marks[flat] == 0]
            own = np.arange(once + 1, once + 1 + len(flat), dtype=np.int32)
            once += len(flat)
            marks[flat] = own
            flat = flat[marks[flat] == own]
            query, next_ = flat // len(links), flat % len(links)
            value = np.einsum("nd,nd->n", self.vectors[next_], queries[query])
            better = value > like.min(axis=1)[query]
            query, next_, value = query[better], next_[better], value[better]
            if len(query):
                which, first, counts = np.unique(query, return_index=True, return_counts=True)
                col = np.arange(len(query)) - np.repeat(first, counts)
                row = np.repeat(np.arange(len(which)), counts)
                m = int(counts.max())
                more, more_like = np.full((len(which), m), -1, np.int32), np.full((len(which), m), LOW)
                more[row, col], more_like[row, col] = next_, value
                all_ids, all_like = np.concatenate((ids[which], more), axis=1), np.concatenate((like[which], more_like), axis=1)
                all_open = np.concatenate((open_[which], more >= 0), axis=1)
                best = np.argpartition(-all_like, reach - 1, axis=1)[:, :reach]
                ids[which], like[which], open_[which] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_like, all_open))
            live = np.flatnonzero(open_.any(axis=1))
        return ids, like

    def search(self, queries: np.ndarray, reach: int) -> Iterator[tuple[slice, np.ndarray]]:
        """Slices of the queries and the points found for them (-1: fewer than `reach`), as numbers of the vectors given at first."""
        near = np.zeros((len(queries), 1), np.int32)
        for links in self.links[:0:-1]:
            near = np.concatenate([ids for _, ids, _ in self._walk(links, queries, near, 1)])
        back = np.append(self.order, -1)
        for part, ids, _ in self._walk(self.links[0], queries, near, reach):
            yield part, back[ids]
