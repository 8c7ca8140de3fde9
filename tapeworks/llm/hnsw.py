"""A hierarchical navigable small-world graph over unit vectors, built and searched inside one task."""

from __future__ import annotations

import io
import math
from heapq import heappop, heappush

import numpy as np

#: Links of a node on upper levels; twice as many on the lowest, where lists are cut back when they hold twice that.
LINKS, BUILD_BEAM = 12, 40


class Graph:
    """``vectors``: rows of length 1 in double precision; ``chances``: a number in (0, 1] for each, from which its level comes."""

    def __init__(self, vectors: np.ndarray, chances: np.ndarray):
        self.vectors, self.beam = vectors, 32
        self.levels = (-np.log(chances) / math.log(LINKS)).astype(int)
        self.links: list[dict[int, list[int]]] = [{} for _ in range(int(self.levels.max(initial=0)) + 1)]
        self.entry = -1
        self.seen, self.stamp = np.zeros(len(vectors), np.int32), 0
        for node in range(len(vectors)):
            self._insert(node)

    def _near(self, x: np.ndarray, entries: list[tuple[float, int]], beam: int, level: int) -> list[tuple[float, int]]:
        """Up to ``beam`` (similarity, node) on a level, the most similar first."""
        self.stamp += 1
        seen, stamp, vectors, links = self.seen, self.stamp, self.vectors, self.links[level]
        seen[[v for _, v in entries]] = stamp
        todo, best = [], []
        for s, v in entries:
            heappush(todo, (-s, v))
            heappush(best, (s, v))
        while todo:
            s, node = heappop(todo)
            if len(best) >= beam and -s < best[0][0]:
                break
            near = np.array(links[node], np.int64)
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            for s, v in zip((vectors[near] @ x).tolist(), near.tolist(), strict=True):
                if len(best) < beam or s > best[0][0]:
                    heappush(todo, (-s, v))
                    heappush(best, (s, v))
                    if len(best) > beam:
                        heappop(best)
        return sorted(best, reverse=True)

    def _chosen(self, near: list[tuple[float, int]], most: int) -> list[int]:
        """Nodes that are nearer to the new one than to those chosen before them, then the nearest of the others."""
        nodes = [v for _, v in near]
        if len(nodes) <= most:
            return nodes
        x = self.vectors[nodes]
        between = x @ x.T
        picked: list[int] = []
        closest = np.full(len(nodes), -2.0)
        for i, (s, _) in enumerate(near):
            if closest[i] < s:
                picked.append(i)
                np.maximum(closest, between[i], out=closest)
                if len(picked) == most:
                    break
        taken = set(picked)
        picked += [i for i in range(len(nodes)) if i not in taken][: most - len(picked)]
        return [nodes[i] for i in picked]

    def _insert(self, node: int) -> None:
        x, level = self.vectors[node], int(self.levels[node])
        if self.entry < 0:
            for at in range(level + 1):
                self.links[at][node] = []
            self.entry = node
            return
        top = int(self.levels[self.entry])
        near = [(float(self.vectors[self.entry] @ x), self.entry)]
        for at in range(top, level, -1):
            near = self._near(x, near[:1], 1, at)
        for at in range(min(level, top), -1, -1):
            most = LINKS * (2 if at == 0 else 1)
            near = self._near(x, near, BUILD_BEAM, at)
            own = self._chosen(near, LINKS)
            links = self.links[at]
            links[node] = list(own)
            for v in own:
                links[v].append(node)
                if len(links[v]) > 2 * most:
                    others = links[v]
                    similar = self.vectors[others] @ self.vectors[v]
                    links[v] = self._chosen(sorted(zip(similar.tolist(), others, strict=True), reverse=True), most)
        for at in range(top + 1, level + 1):
            self.links[at][node] = []
        if level > top:
            self.entry = node

    def search(self, x: np.ndarray, least: float) -> np.ndarray | None:
        """Nodes found with a similarity of ``least``. The beam is widened until it holds others too; None if it would take an eighth of the nodes."""
        if self.entry < 0:
            return np.zeros(0, np.int64)
        beam = self.beam
        near = [(float(self.vectors[self.entry] @ x), self.entry)]
        for at in range(int(self.levels[self.entry]), 0, -1):
            near = self._near(x, near[:1], 1, at)
        while beam < max(256, len(self.vectors) // 8):
            found = self._near(x, near, beam, 0)
            if len(found) < beam or found[-1][0] < least - 0.01:
                return np.array(sorted(v for s, v in found if s >= least), np.int64)
            beam *= 4
        return None

    def within(self, x: np.ndarray, least: float) -> np.ndarray:
        """``search``, or all nodes compared."""
        found = self.search(x, least)
        return np.flatnonzero(self.vectors @ x >= least) if found is None else found

    def audit(self, least: float, recall: float, sample: int) -> None:
        """Widen the beam until searches find ``recall`` of what comparing all finds, or it takes all nodes.

        Asked are up to ``sample`` nodes that are linked with others, out of 16 times as many; a node itself is left
        out, and recall is the mean over nodes, so that a large group does not hide what is lost elsewhere.
        """
        tried = np.unique(np.linspace(0, len(self.vectors) - 1, min(16 * sample, len(self.vectors))).astype(int)) if len(self.vectors) else []
        asked: list[tuple[int, np.ndarray]] = []
        for low in range(0, len(tried), sample):
            part = tried[low : low + sample]
            alike = self.vectors @ self.vectors[part].T >= least
            alike[part, np.arange(len(part))] = False
            asked += [(int(i), np.flatnonzero(alike[:, k])) for k, i in enumerate(part) if alike[:, k].any()]
        asked = asked[:: max(1, len(asked) // sample)][:sample]
        while asked and self.beam < len(self.vectors):
            if np.mean([len(np.intersect1d(self.within(self.vectors[i], least), true)) / len(true) for i, true in asked]) >= recall:
                return
            self.beam *= 2

    def dump(self) -> bytes:
        out = io.BytesIO()
        parts = {"vectors": self.vectors, "levels": self.levels, "at": np.array([self.entry, self.beam])}
        for k, links in enumerate(self.links):
            nodes = sorted(links)
            parts[f"nodes{k}"] = np.array(nodes, np.int32)
            parts[f"sizes{k}"] = np.array([len(links[v]) for v in nodes], np.int32)
            parts[f"links{k}"] = np.array([u for v in nodes for u in links[v]], np.int32)
        np.savez(out, **parts)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Graph:
        self, parts = cls.__new__(cls), np.load(io.BytesIO(data))
        self.vectors, self.levels = parts["vectors"], parts["levels"]
        self.entry, self.beam = map(int, parts["at"])
        self.links = []
        for k in range(int(self.levels.max(initial=0)) + 1):
            lists = np.split(parts[f"links{k}"], np.cumsum(parts[f"sizes{k}"])[:-1])
            self.links.append(dict(zip(parts[f"nodes{k}"].tolist(), (x.tolist() for x in lists), strict=True)))
        self.seen, self.stamp = np.zeros(len(self.vectors), np.int32), 0
        return self
