"""A hierarchical navigable small-world graph over unit vectors, built and searched in batches with numpy."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np

#: Links of a node on upper layers (twice as many on the lowest), beam while building, nodes a step expands, vectors a batch.
LINKS, BUILD_BEAM, STRIDE, BATCH = 8, 32, 4, 512


class Graph:
    """`links[0]` has a row for every node; an upper layer has rows for its own nodes, found through `row`."""

    def __init__(self, vectors: np.ndarray, level: np.ndarray, links: list[np.ndarray], row: list[np.ndarray], entry: int):
        self.vectors, self.level, self.links, self.row, self.entry = vectors, level, links, row, entry

    @classmethod
    def build(cls, vectors: np.ndarray, draws: np.ndarray) -> Graph:
        """`draws` in (0, 1] set the levels. Nodes join in order; the first batch is linked exactly, the others are searched."""
        n = len(vectors)
        level = np.minimum(np.floor(-np.log(draws) / np.log(LINKS)).astype(np.int64), 8)
        links, row = [], []
        for layer in range(int(level.max()) + 1):
            own = level >= layer
            r = np.full(n, -1, np.int32)
            r[own] = np.arange(own.sum(), dtype=np.int32)
            row.append(r)
            links.append(np.full((int(own.sum()), LINKS * (2 if layer == 0 else 1)), -1, np.int32))
        g = cls(vectors, level, links, row, 0)
        at = 0
        while at < n:
            new = np.arange(at, min(n, at + min(BATCH, max(64, at))))
            g._insert(new, at)
            top = new[np.argmax(level[new])]
            if not at or level[top] > level[g.entry]:
                g.entry = int(top)
            at = int(new[-1]) + 1
        g._reach_all()
        return g

    def _insert(self, new: np.ndarray, size: int) -> None:
        q = self.vectors[new]
        among = q @ q.T
        start = np.full(len(new), self.entry)
        for layer in range(len(self.links) - 1, -1, -1):
            who = self.level[new] >= layer
            ids = sims = None
            if size and layer <= self.level[self.entry]:
                ids, sims = self._search(q, start, layer, BUILD_BEAM if layer == 0 or who.any() else 1)
                start = ids[:, 0]
            if not who.any():
                continue
            mine, peers = np.flatnonzero(who), new[who]
            s = among[np.ix_(mine, mine)].copy()
            np.fill_diagonal(s, -2)
            k = min(BUILD_BEAM, len(mine))
            near = np.argpartition(-s, k - 1, 1)[:, :k]
            cand, value = peers[near], np.take_along_axis(s, near, 1)
            if ids is not None:
                cand, value = np.hstack([cand, ids[who]]), np.hstack([value, sims[who]])
            self._link(layer, peers, np.where(value > -2, cand, -1), value)

    def _diverse(self, owner: np.ndarray, cand: np.ndarray, value: np.ndarray, most: int) -> np.ndarray:
        """For each owner up to `most` of its candidates, nearest first, passing over those nearer to one already taken; places
        left are filled with the nearest passed over."""
        order = np.argsort(-value, 1, kind="stable")
        cand, value = np.take_along_axis(cand, order, 1), np.take_along_axis(value, order, 1)
        v = self.vectors[cand]
        between = v @ v.transpose(0, 2, 1)
        n, k = cand.shape
        taken = np.zeros((n, k), bool)
        for j in range(k):
            near = np.where(taken, between[:, j], -2).max(1)
            taken[:, j] = (cand[:, j] >= 0) & (value[:, j] > near) & (taken.sum(1) < most)
        rank = np.where(taken, 0, np.where(cand >= 0, 1, 2)) * (k + 1) + np.arange(k)
        pick = np.argsort(rank, 1)[:, :most]
        out = np.take_along_axis(cand, pick, 1)
        if out.shape[1] < most:
            out = np.hstack([out, np.full((n, most - out.shape[1]), -1, out.dtype)])
        return out

    def _link(self, layer: int, nodes: np.ndarray, cand: np.ndarray, value: np.ndarray) -> None:
        table, row = self.links[layer], self.row[layer]
        most = table.shape[1]
        chosen = self._diverse(nodes, cand, value, most)
        table[row[nodes]] = chosen
        # links back: what a node has and what it is offered compete again
        back, to = np.repeat(nodes, most), chosen.ravel()
        back, to = back[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        back, to = back[order], to[order]
        ends, first, count = np.unique(to, return_index=True, return_counts=True)
        for lot in range(0, len(ends), 256):
            e, f, c = ends[lot : lot + 256], first[lot : lot + 256], count[lot : lot + 256]
            offered = np.full((len(e), int(c.max())), -1, np.int64)
            at = np.repeat(np.arange(len(e)), c)
            offered[at, np.arange(len(at)) - np.repeat(np.cumsum(c) - c, c)] = back[np.concatenate([np.arange(a, a + b) for a, b in zip(f, c)])]
            both = np.sort(np.hstack([table[row[e]], offered]), 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            sims = np.einsum("ijk,ik->ij", self.vectors[both], self.vectors[e])
            sims[(both < 0) | (both == e[:, None])] = -2
            both[sims == -2] = -1
            if both.shape[1] > 4 * BUILD_BEAM:  # a hub: its nearest are enough to choose from
                near = np.argpartition(-sims, 4 * BUILD_BEAM - 1, 1)[:, : 4 * BUILD_BEAM]
                both, sims = np.take_along_axis(both, near, 1), np.take_along_axis(sims, near, 1)
            table[row[e]] = self._diverse(e, both, sims, most)

    def _reached(self) -> np.ndarray:
        """Which nodes the links of the lowest layer lead to from the entry."""
        seen = np.zeros(len(self.vectors), bool)
        edge = np.array([self.entry])
        while len(edge):
            seen[edge] = True
            edge = np.unique(self.links[0][edge])
            edge = edge[(edge >= 0) & ~seen[np.maximum(edge, 0)]]
        return seen

    def _reach_all(self) -> None:
        """In a dense cluster, links back may all have been given up for others: such nodes get one more, from the nearest reached
        node that has the fewest of these, and the table as many columns as that takes."""
        more: dict[int, list[int]] = {}
        seen = self._reached()
        while not seen.all():
            lost = np.flatnonzero(~seen)
            lot = lost[:BATCH]
            near = self._search(self.vectors[lot], np.full(len(lot), self.entry), 0, BUILD_BEAM)[0][:, :LINKS]
            for x, ids in zip(lot.tolist(), near.tolist()):
                y = min((i for i in ids if i >= 0), key=lambda i: len(more.get(i, ())))
                more.setdefault(y, []).append(x)
            extra = np.full((len(self.vectors), max(map(len, more.values()))), -1, np.int32)
            for y, xs in more.items():
                extra[y, : len(xs)] = xs
            self.links[0] = np.hstack([self.links[0][:, : 2 * LINKS], extra])
            seen = self._reached()

    def _search(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The best `beam` nodes of a layer for each query, best first (-1 and -2 where fewer were met)."""
        n, m = len(self.vectors), len(q)
        table, row = self.links[layer], self.row[layer]
        ids = np.full((m, beam), -1, np.int64)
        sims = np.full((m, beam), -2.0)
        ids[:, 0] = start
        sims[:, 0] = np.einsum("ij,ij->i", q, self.vectors[start])
        opened = np.zeros((m, beam), bool)
        met = np.zeros((m, n), bool)
        met[np.arange(m), start] = True
        live = np.arange(m)
        while len(live):
            todo = np.where(opened[live], -2, sims[live])
            w = min(STRIDE, beam)
            pick = np.argpartition(-todo, w - 1, 1)[:, :w] if beam > w else np.tile(np.arange(beam), (len(live), 1))
            real = np.take_along_axis(todo, pick, 1) > -2
            go = real.any(1)
            live, pick, real = live[go], pick[go], real[go]
            if not len(live):
                break
            opened[live[:, None], pick] |= real
            from_ = np.where(real, ids[live[:, None], pick], -1)
            next_ = np.where(from_[:, :, None] >= 0, table[row[np.maximum(from_, 0)]], -1).reshape(len(live), -1)
            next_ = np.sort(next_, 1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            who, col = np.nonzero(next_ >= 0)
            node = next_[who, col]
            unmet = ~met[live[who], node]
            who, col, node = who[unmet], col[unmet], node[unmet]
            met[live[who], node] = True
            found = np.full(next_.shape, -2.0)
            found[who, col] = np.einsum("ij,ij->i", q[live[who]], self.vectors[node])
            all_sims = np.hstack([sims[live], found])
            all_ids = np.hstack([ids[live], next_])
            all_open = np.hstack([opened[live], np.zeros(next_.shape, bool)])
            best = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
            sims[live] = np.take_along_axis(all_sims, best, 1)
            ids[live] = np.take_along_axis(all_ids, best, 1)
            opened[live] = np.take_along_axis(all_open, best, 1)
        order = np.argsort(-sims, 1, kind="stable")
        sims = np.take_along_axis(sims, order, 1)
        return np.where(sims > -2, np.take_along_axis(ids, order, 1), -1), sims

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        start = np.full(len(q), self.entry)
        for layer in range(int(self.level[self.entry]), 0, -1):
            start = self._search(q, start, layer, 1)[0][:, 0]
        return self._search(q, start, 0, beam)

    def within(self, q: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) of what the search finds at `least` similarity, some queries at a time; where a beam is full of such
        nodes, it is doubled."""
        n, todo = len(self.vectors), np.arange(len(q))
        while len(todo):
            beam, again = min(beam, n), []
            lot = max(1, min(BATCH, 20_000_000 // (n + 200 * beam)))
            for at in range(0, len(todo), lot):
                who = todo[at : at + lot]
                ids, sims = self.search(q[who], beam)
                full = (sims[:, -1] >= least) & (beam < n)
                again.append(who[full])
                a, b = np.nonzero((sims >= least) & ~full[:, None])
                yield who[a], ids[a, b]
            todo, beam = np.concatenate(again), 2 * beam

    def _audits(self, q: np.ndarray, own: np.ndarray, least: float, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which queries, how many exact links each has besides itself) for those with 1 to 3 links, 4 to 15, 16 to 63 and so on, up
        to `most` each (an eighth from 64 on); `own` has the queries' places in the graph, or -1."""
        n = np.zeros(0, np.int64)
        while len(n) < len(q) and ((n > 0) & (n < 4)).sum() < most:
            lot = slice(len(n), len(n) + BATCH)
            n = np.concatenate([n, (q[lot] @ self.vectors.T >= least).sum(1) - (own[lot] >= 0)])
        band = np.log2(np.maximum(n, 1)).astype(np.int64) // 2
        for b in np.unique(band[n > 0]).tolist():
            who = np.flatnonzero((n > 0) & (band == b))[: most if b < 3 else max(1, most // 8)]
            yield who, n[who]

    def _mean_recall(self, q: np.ndarray, own: np.ndarray, links: np.ndarray, least: float, beam: int) -> float:
        found = np.zeros(len(q), np.int64)
        for a, b in self.within(q, least, beam):
            np.add.at(found, a, b != own[a])
        return float(np.minimum(found / links, 1).mean())

    def audited_beam(self, least: float, beam: int, recall: float, most: int, guests: np.ndarray | None = None) -> int:
        """Widen the beam until the search finds `recall` of the exact links of a vector on average, matches with itself left out,
        among sampled vectors of few links as among those of many, and among the graph's own as among `guests` from elsewhere."""
        n = len(self.vectors)
        own = np.linspace(0, n - 1, min(n, 16 * most)).astype(np.int64)
        asked = [(self.vectors[own], own)]
        if guests is not None:
            asked.append((guests, np.full(len(guests), -1)))
        for q, at in asked:
            for who, links in self._audits(q, at, least, most):
                while beam < n and self._mean_recall(q[who], at[who], links, least, beam) < recall:
                    beam *= 2
        return beam

    def tobytes(self, ids: np.ndarray) -> bytes:
        buf = io.BytesIO()
        parts = {f"links{k}": x for k, x in enumerate(self.links)} | {f"row{k}": x for k, x in enumerate(self.row)}
        np.savez(buf, ids=ids, vectors=self.vectors, level=self.level, entry=self.entry, **parts)
        return buf.getvalue()

    @classmethod
    def frombytes(cls, data: bytes) -> tuple[Graph, np.ndarray]:
        z = np.load(io.BytesIO(data))
        layers = sum(k.startswith("links") for k in z.files)
        g = cls(z["vectors"], z["level"], [z[f"links{k}"] for k in range(layers)], [z[f"row{k}"] for k in range(layers)], int(z["entry"]))
        return g, z["ids"]
