"""Min-cost flow on small networks: counts of cells, not records."""

from __future__ import annotations

import heapq


class Flow:
    """Successive shortest paths with potentials; arcs carry whole numbers and each path carries all it can."""

    def __init__(self) -> None:
        self.to: list[int] = []
        self.cap: list[int] = []
        self.cost: list[float] = []
        self.out: dict[int, list[int]] = {}
        self.names: dict[object, int] = {}

    def node(self, name: object) -> int:
        n = self.names.setdefault(name, len(self.names))
        self.out.setdefault(n, [])
        return n

    def arc(self, a: object, b: object, cap: int, cost: float = 0.0) -> int:
        """The number of the arc; ``sent`` gives what it carries."""
        u, v = self.node(a), self.node(b)
        k = len(self.to)
        for x, y, c, w in ((u, v, int(cap), cost), (v, u, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.cap.append(c)
            self.cost.append(w)
        return k

    def sent(self, k: int) -> int:
        return self.cap[k ^ 1]

    def run(self, source: object, sink: object, most: int, stop: float | None = None) -> int:
        """Send up to ``most`` units at the least cost; with ``stop``, only along paths that cost less than it."""
        s, t = self.node(source), self.node(sink)
        high = self._first(s)
        done = 0
        while done < most:
            dist, via = {s: 0.0}, {}
            queue = [(0.0, s)]
            while queue:
                d, u = heapq.heappop(queue)
                if d > dist[u] + 1e-12:
                    continue
                for k in self.out[u]:
                    v = self.to[k]
                    if self.cap[k] > 0 and v in high:
                        w = d + max(0.0, self.cost[k] + high[u] - high[v])
                        if w < dist.get(v, float("inf")) - 1e-12:
                            dist[v], via[v] = w, k
                            heapq.heappush(queue, (w, v))
            if t not in dist:
                break
            far = max(dist.values())
            for v in high:
                high[v] += dist.get(v, far)
            if stop is not None and high[t] - high[s] >= stop:
                break
            path, v = [], t
            while v != s:
                path.append(via[v])
                v = self.to[via[v] ^ 1]
            step = min([most - done, *(self.cap[k] for k in path)])
            for k in path:
                self.cap[k] -= step
                self.cap[k ^ 1] += step
            done += step
        return done

    def _first(self, s: int) -> dict[int, float]:
        """Least costs from s where arcs may cost less than nothing (no cycle does before anything is sent)."""
        high = {s: 0.0}
        for _ in range(len(self.names)):
            moved = False
            for u in list(high):
                for k in self.out[u]:
                    if self.cap[k] > 0 and high[u] + self.cost[k] < high.get(self.to[k], float("inf")) - 1e-12:
                        high[self.to[k]] = high[u] + self.cost[k]
                        moved = True
            if not moved:
                break
        return high
