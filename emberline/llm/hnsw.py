"""A navigable small-world graph in layers over one shard of vectors, built and searched in batches with numpy."""

from __future__ import annotations

import numpy as np

DEGREE = 16
BUILD_BEAM = 64
FIRST = 512
BATCH = 512
CELLS = 24_000_000  # visited flags held at once


def unit(raw: np.ndarray) -> np.ndarray:
    return (raw / np.linalg.norm(raw, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """Layer 0 links every vector to at most 2 * DEGREE others, each higher layer 1 in DEGREE of those below to DEGREE.

    Levels are drawn from a hash of the position, so a graph is the same whenever it is built from the same rows.
    """

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None):
        self.x = vectors
        n = len(vectors)
        draw = np.random.default_rng(7).random(n)
        self.level = np.minimum(np.floor(-np.log(np.maximum(draw, 1e-12)) / np.log(DEGREE)), 8).astype(int)
        self.top = int(self.level.max(initial=0))
        self.entry = int(self.level.argmax()) if n else -1
        self.links = links or [np.full((n, DEGREE * (2 if i == 0 else 1)), -1, np.int32) for i in range(self.top + 1)]
        if links is None and n:
            self._build()

    def _build(self) -> None:
        # the entry point goes first, then position order; batches never outgrow what is already linked
        order = np.concatenate([[self.entry], np.delete(np.arange(len(self.x)), self.entry)])
        done = min(FIRST, len(order))
        for layer in range(self.top + 1):
            there = order[:done][self.level[order[:done]] >= layer]
            self._connect(there, np.broadcast_to(there, (len(there), len(there))), layer)
        while done < len(order):
            batch = order[done : done + min(BATCH, done)]
            start = np.full((len(batch), 1), self.entry, np.int32)
            for layer in range(self.top, -1, -1):
                start, _ = self.beam(self.x[batch], start, layer, BUILD_BEAM if layer <= self.level[batch].max() else 1)
                at = self.level[batch] >= layer
                if at.any():
                    among = batch[at]
                    self._connect(among, np.hstack([start[at], np.broadcast_to(among, (len(among), len(among)))]), layer)
            done += len(batch)
        self._adopt()

    def _adopt(self, spare: int = 8) -> None:
        """Nodes that hardly anything links to on layer 0 get spare links from their nearest neighbours with room."""
        links = self.links[0]
        known = np.bincount(links[links >= 0], minlength=len(links))
        extra, used = np.full((len(links), spare), -1, np.int32), np.zeros(len(links), int)
        for node in np.flatnonzero(known < 3):
            for host in links[node][links[node] >= 0]:
                if known[node] >= 3:
                    break
                if used[host] < spare:
                    extra[host, used[host]] = node
                    used[host] += 1
                    known[node] += 1
        self.links[0] = np.hstack([links, extra])

    def _connect(self, nodes: np.ndarray, candidates: np.ndarray, layer: int) -> None:
        """Link nodes to a diverse choice of their candidates, and those back to them."""
        if len(nodes) < 1:
            return
        links = self.links[layer]
        for i in range(0, len(nodes), 128):
            links[nodes[i : i + 128]] = self._choose(nodes[i : i + 128], candidates[i : i + 128], links.shape[1])
        source = np.repeat(nodes, links.shape[1])
        target = links[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        hit, first, count = np.unique(target, return_index=True, return_counts=True)
        for i in range(0, len(hit), 128):
            some = hit[i : i + 128]
            back = np.full((len(some), int(count[i : i + 128].max())), -1, np.int32)
            for j, (a, c) in enumerate(zip(first[i : i + 128], count[i : i + 128])):
                back[j, :c] = source[a : a + c]
            links[some] = self._choose(some, np.hstack([links[some], back]), links.shape[1])

    def _choose(self, nodes: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
        """Per node the candidates nearer to it than to any one chosen before; room left is filled with the nearest."""
        sims = np.einsum("bd,bkd->bk", self.x[nodes], self.x[candidates]) if candidates.size < 2_000_000 else self.x[nodes] @ self.x[candidates[0]].T
        sims[(candidates < 0) | (candidates == nodes[:, None])] = -2
        # a candidate listed twice counts once
        order = np.argsort(candidates, axis=1, kind="stable")
        again = np.zeros_like(sims, bool)
        in_order = np.take_along_axis(candidates, order, 1)
        np.put_along_axis(again, order[:, 1:], in_order[:, 1:] == in_order[:, :-1], 1)
        sims[again] = -2
        best = np.argsort(-sims, axis=1, kind="stable")[:, : 3 * most]
        ids, near = np.take_along_axis(candidates, best, 1), np.take_along_axis(sims, best, 1)
        valid = near > -2
        own = self.x[ids]
        between = np.matmul(own, own.transpose(0, 2, 1))
        kept = np.zeros_like(valid)
        closest = np.full(near.shape, -2, np.float32)  # to anything kept so far
        for j in range(ids.shape[1]):
            take = valid[:, j] & (near[:, j] > closest[:, j]) & (kept.sum(1) < most)
            kept[take, j] = True
            closest[take] = np.maximum(closest[take], between[take, j])
        rank = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)
        return np.hstack([out, np.full((len(nodes), most - out.shape[1]), -1)]).astype(np.int32) if out.shape[1] < most else out.astype(np.int32)

    def beam(self, queries: np.ndarray, start: np.ndarray, layer: int, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of the best ``width`` nodes a beam search reaches, best first, -1 and -2 where fewer."""
        parts = [self._beam(queries[i : i + rows], start[i : i + rows], layer, width, step) for rows in [max(1, min(256, CELLS // len(self.x)))] for i in range(0, len(queries), rows)]
        return np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])

    def _beam(self, queries, start, layer, width, step):
        b, links = len(queries), self.links[layer]
        seen = np.zeros((b, len(self.x) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        ids = np.full((b, width + start.shape[1]), -1, np.int32)
        ids[:, : start.shape[1]] = start
        row = np.arange(b)[:, None]
        sims = np.full(ids.shape, -2, np.float32)
        sims[:, : start.shape[1]] = np.where(start >= 0, np.einsum("bd,bkd->bk", queries, self.x[start]), -2)
        seen[row, start] = True
        open_ = ids >= 0
        ids, sims, open_ = _best(ids, sims, open_, width)
        live = np.arange(b)
        step = min(step, width)
        while len(live):
            score = np.where(open_[live], sims[live], -3)
            pick = np.argpartition(-score, step - 1, axis=1)[:, :step] if score.shape[1] > step else np.broadcast_to(np.arange(score.shape[1]), score.shape)
            good = np.take_along_axis(score, pick, 1) > -3
            going = good.any(1)
            live, pick, good = live[going], pick[going], good[going]
            if not len(live):
                break
            at = live[:, None]
            nodes = np.where(good, ids[at, pick], -1)
            open_[at, pick] = False
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near = np.where(seen[at, near], -1, near)
            seen[at, near] = True
            fresh = np.where(near >= 0, np.einsum("bd,bkd->bk", queries[live], self.x[near]), -2)
            ids[live], sims[live], open_[live] = _best(np.hstack([ids[live], near]), np.hstack([sims[live], fresh]), np.hstack([open_[live], near >= 0]), width)
        return ids, sims

    def within(self, queries: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) index pairs of similarity ``least`` or more (float32) that the search reaches.

        A beam that fills up with such nodes is doubled, so a query's matches are never cut at the beam's width.
        """
        if not len(self.x) or not len(queries):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        start = np.full((len(queries), 1), self.entry, np.int32)
        for layer in range(self.top, 0, -1):
            start, _ = self.beam(queries, start, layer, 4)
        left, out = np.arange(len(queries)), []
        while len(left):
            ids, sims = self.beam(queries[left], start[left], 0, min(width, len(self.x)))
            full = (sims[:, -1] >= least) & (width < len(self.x))
            q, at = np.nonzero((sims >= least) & ~full[:, None])
            out.append((left[q], ids[q, at]))
            left, width = left[full], 2 * width
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]).astype(np.int64)


def _best(ids, sims, open_, width):
    if sims.shape[1] > width:
        order = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        ids, sims, open_ = (np.take_along_axis(a, order, 1) for a in (ids, sims, open_))
    order = np.argsort(-sims, axis=1, kind="stable")
    return tuple(np.take_along_axis(a, order, 1) for a in (ids, sims, open_))
