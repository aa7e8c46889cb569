"""Label-setting searches over one network in arrays: shortest-path trees, loads, route sets, hyperpaths.

These run once per origin or destination, or a few origins, inside Arrow batches; the network reaches them as a broadcast of bounded,
checked size. Ties between equal costs fall to the edge that comes first by (a_node, b_node, link_id, direction).
"""

from __future__ import annotations

import heapq

import numpy as np


#: Origins that best search together, edges of a pass (both bound what a pass touches), rounds after which a search is left to
#: the heap, and edges into a node beyond which it is from the start.
ORIGINS_AT_ONCE = 16
EDGES_AT_ONCE = 4096
MOST_ROUNDS = 64
MOST_RANKS = 64


class Network:
    """Forward star of directed edges; ``nodes`` holds ids by index, edges are in order of (a, b, link, direction)."""

    def __init__(self, a, b, link, direction, cost, fields: dict[str, np.ndarray], centroids, blocked: bool):
        a, b, link, direction = (np.asarray(x, np.int64) for x in (a, b, link, direction))
        by = np.lexsort((direction, link, b, a))
        self.link, self.direction, self.cost = link[by], direction[by], np.asarray(cost, float)[by]
        self.fields = {k: np.asarray(v, float)[by] for k, v in fields.items()}
        self.nodes = np.unique(np.concatenate([a, b, np.asarray(centroids, np.int64)]))
        self.tail, self.head = np.searchsorted(self.nodes, a[by]), np.searchsorted(self.nodes, b[by])
        self.first = np.searchsorted(self.tail, np.arange(len(self.nodes) + 1))
        self.is_centroid = np.isin(self.nodes, np.asarray(centroids, np.int64))
        self.blocked = blocked
        self._lists = self._ranks = None

    def index(self, node: int) -> int:
        at = int(np.searchsorted(self.nodes, node))
        return at if at < len(self.nodes) and self.nodes[at] == node else -1

    def lists(self):
        """Plain lists, which a heap loop reads faster than arrays."""
        if self._lists is None:
            self._lists = self.first.tolist(), self.head.tolist(), self.cost.tolist(), self.is_centroid.tolist()
        return self._lists

    def tree(self, origin: int, cost: list[float] | None = None, target: int = -1) -> tuple[list[float], list[int], list[int]]:
        """(distance, edge into, settled order) from a node's index; edges of infinite cost are not used. With a target
        the search ends when that is settled."""
        first, head, base, centroid = self.lists()
        cost = base if cost is None else cost
        far = [np.inf] * len(self.nodes)
        into = [-1] * len(self.nodes)
        done = bytearray(len(self.nodes))
        far[origin] = 0.0
        heap = [(0.0, origin)]
        order = []
        while heap:
            d, n = heapq.heappop(heap)
            if done[n]:
                continue
            done[n] = 1
            order.append(n)
            if n == target:
                break
            if self.blocked and centroid[n] and n != origin:
                continue
            for e in range(first[n], first[n + 1]):
                m = head[e]
                x = d + cost[e]
                if x < far[m]:
                    far[m] = x
                    into[m] = e
                    heapq.heappush(heap, (x, m))
        return far, into, order

    def ranks(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tails, heads, costs) of usable edges in sets that hold a head once: its first edges, its second, and so on.
        Empty where rounds over whole sets are no way to search: costs below zero, or too many edges into a node."""
        if self._ranks is None:
            own = np.flatnonzero((self.cost < np.inf) & ~(self.blocked & self.is_centroid[self.tail]))
            own = own[np.argsort(self.head[own], kind="stable")]
            rank = np.arange(len(own)) - np.searchsorted(self.head[own], self.head[own])
            most = int(rank.max(initial=-1)) + 1
            sets = [own[rank == k] for k in range(most)] if most <= MOST_RANKS and not (self.cost < 0).any() else []
            self._ranks = [(self.tail[es], self.head[es], self.cost[es]) for es in sets]
        return self._ranks

    def costs(self, origins: list[int]) -> np.ndarray:
        """The distances that ``tree`` gives, a row an origin and a column a node. The origins, best ``ORIGINS_AT_ONCE`` of
        them, go together through rounds over all edges, each a handful of passes over arrays. A network on which that
        does not end within ``MOST_ROUNDS`` rounds is searched origin by origin, from then on."""
        far = self._rounds(origins) if self.ranks() else None
        if far is not None:
            return np.ascontiguousarray(far.T)
        self._ranks = []
        return np.array([self.tree(o)[0] for o in origins]).reshape(len(origins), len(self.nodes))

    def _rounds(self, origins: list[int]) -> np.ndarray | None:
        far = np.full((len(self.nodes), len(origins)), np.inf)
        for k, o in enumerate(origins):
            far[o, k] = 0.0
            for e in range(self.first[o], self.first[o + 1]):  # a centroid's own edges, which no other search may use
                if self.cost[e] < far[self.head[e], k]:
                    far[self.head[e], k] = self.cost[e]
        part = np.empty((EDGES_AT_ONCE, len(origins)))
        for _ in range(MOST_ROUNDS):
            better = False
            for tails, heads, cost in self.ranks():
                for at in range(0, len(tails), EDGES_AT_ONCE):
                    cut = slice(at, at + EDGES_AT_ONCE)
                    to = heads[cut]
                    if to[-1] - to[0] + 1 == len(to):  # nodes that follow one another need no copy
                        to = slice(to[0], to[-1] + 1)
                    new = np.take(far, tails[cut], axis=0, out=part[: len(tails[cut])], mode="clip")
                    new += cost[cut, None]
                    old = far[to]
                    better = better or bool((new < old).any())
                    far[to] = np.minimum(new, old, out=new)
            if not better:
                return far
        return None

    def path(self, into: list[int], target: int) -> list[int]:
        out = []
        tail = self.tail
        while into[target] >= 0:
            out.append(into[target])
            target = int(tail[into[target]])
        return out[::-1]

    def skims(self, into: list[int], order: list[int]) -> dict[str, np.ndarray]:
        """Sums of the fields along the tree, infinite where it does not reach."""
        out = {k: np.full(len(self.nodes), np.inf) for k in self.fields}
        for k, values in self.fields.items():
            own = out[k]
            own[order[0]] = 0.0
            for n in order[1:]:
                own[n] = own[self.tail[into[n]]] + values[into[n]]
        return out

    def load(self, into: list[int], order: list[int], at: np.ndarray) -> np.ndarray:
        """Edge loads of demand at nodes (index by column of cores): each node passes what it holds up its tree."""
        out = np.zeros((len(self.head), at.shape[1]))
        held = at.copy()
        for n in reversed(order[1:]):
            if held[n].any():
                out[into[n]] += held[n]
                held[self.tail[into[n]]] += held[n]
        return out


def link_penalisation(net: Network, origin: int, target: int, max_routes: int, max_depth: int, max_misses: int, penalty: float) -> list[tuple[int, ...]]:
    """Distinct routes from repeated shortest paths whose edges' costs are multiplied, compounding."""
    cost = net.cost.tolist()
    found: dict[tuple[int, ...], None] = {}
    misses = depth = 0
    while (not max_routes or len(found) < max_routes) and (not max_depth or depth < max_depth) and misses <= max_misses:
        depth += 1
        _, into, _ = net.tree(origin, cost, target)
        route = tuple(net.path(into, target))
        if not route:
            break
        for e in route:
            cost[e] *= penalty
        if route in found:
            misses += 1
        found[route] = None
    return list(found)


def bfs_link_elimination(net: Network, origin: int, target: int, max_routes: int, max_depth: int, max_misses: int, penalty: float, seed: int) -> list[tuple[int, ...]]:
    """Distinct routes by breadth-first search over sets of banned edges; with a penalty other than 1, edges used at a
    depth cost more at the next. The queue is shuffled, by the seed, once the set could be filled from it."""
    rng = np.random.RandomState(seed % (2**32))
    base = net.cost.tolist()
    queue: list[frozenset[int]] = [frozenset()]
    visited: set[frozenset[int]] = set()
    found: dict[tuple[int, ...], None] = {}
    misses = depth = 0
    full = lambda: bool(max_routes) and len(found) >= max_routes
    while queue and misses <= max_misses and not full() and (not max_depth or depth < max_depth):
        depth += 1
        if max_routes and len(queue) + len(found) >= max_routes:
            rng.shuffle(queue)
        after: list[frozenset[int]] = []
        next_base = list(base)
        for banned in queue:
            cost = list(base)
            for e in banned:
                cost[e] = np.inf
            _, into, _ = net.tree(origin, cost, target)
            route = tuple(net.path(into, target))
            visited.add(banned)
            if route:
                for e in route:
                    if penalty != 1.0:
                        next_base[e] *= penalty
                    wider = banned | {e}
                    if wider not in visited:
                        after.append(wider)
                if route in found:
                    misses += 1
                found[route] = None
            if misses > max_misses or full():
                break
        queue, base = after, next_base
    return list(found)


def hyperpath(tail, head, time, freq, n_nodes: int, target: int, demand: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    """Optimal strategies to one destination: (volume by edge, expected time by node).

    Edges are taken in order of u(head) + time; one that can still shorten the wait at its tail joins the strategy.
    Demand then flows down the strategy in the opposite order, split by frequency.
    """
    time = np.maximum(np.asarray(time, float), 1e-12)
    freq = np.clip(np.asarray(freq, float), 1e-20, 1e20)
    tail, head = np.asarray(tail), np.asarray(head)
    by_head = np.argsort(head, kind="stable")
    first = np.searchsorted(head[by_head], np.arange(n_nodes + 1))
    u, f = np.full(n_nodes, np.inf), np.zeros(n_nodes)
    u[target] = 0.0
    key = np.full(len(tail), np.inf)
    heap: list[tuple[float, int]] = []

    def relax(node):
        for e in by_head[first[node] : first[node + 1]].tolist():
            if not scanned[e] and u[node] + time[e] < key[e]:
                key[e] = u[node] + time[e]
                heapq.heappush(heap, (key[e], e))

    scanned = np.zeros(len(tail), bool)
    relax(target)
    chosen: list[int] = []
    while heap:
        k, e = heapq.heappop(heap)
        if scanned[e] or k > key[e]:
            continue
        scanned[e] = True
        i = int(tail[e])
        if u[i] >= k and i != target:
            waited = f[i] * u[i] if f[i] > 0 else (1.0 if np.isinf(u[i]) else 0.0)
            if np.isinf(u[i]) and f[i] == 0:
                waited = 1.0
            u[i] = (waited + freq[e] * k) / (f[i] + freq[e])
            f[i] += freq[e]
            chosen.append(e)
            relax(i)
    volume = np.zeros(len(tail))
    at = np.zeros(n_nodes)
    reached = False
    for node, d in demand.items():
        if np.isfinite(u[node]):
            at[node] += d
            reached = True
    if reached:
        for e in sorted(chosen, key=lambda e: (-key[e], e)):
            v = at[tail[e]] * freq[e] / max(f[tail[e]], 1e-20)
            volume[e] = v
            at[head[e]] += v
    return volume, u


HEURISTICS = ("haversine", "equirectangular")
EARTH = 6_371_000.0


def straight_distances(lon: np.ndarray, lat: np.ndarray, target: int, heuristic: str = "haversine") -> np.ndarray:
    """Metres from all nodes to one, along great circles or, faster and somewhat less true, on a plane at its latitude."""
    if heuristic not in HEURISTICS:
        raise ValueError(f"unknown heuristic {heuristic}; there are {', '.join(HEURISTICS)}")
    x, y = np.radians(lon), np.radians(lat)
    dx, dy = x - x[target], y - y[target]
    if heuristic == "equirectangular":
        return EARTH * np.hypot(dx * np.cos((y + y[target]) / 2), dy)
    return 2 * EARTH * np.arcsin(np.sqrt(np.sin(dy / 2) ** 2 + np.cos(y) * np.cos(y[target]) * np.sin(dx / 2) ** 2))


def least_cost_per_metre(net: Network, lon: np.ndarray, lat: np.ndarray) -> float:
    """The greatest factor by which straight distances never exceed costs."""
    x, y = np.radians(lon), np.radians(lat)
    dx, dy = x[net.head] - x[net.tail], y[net.head] - y[net.tail]
    far = 2 * EARTH * np.arcsin(np.sqrt(np.sin(dy / 2) ** 2 + np.cos(y[net.tail]) * np.cos(y[net.head]) * np.sin(dx / 2) ** 2))
    own = far > 0
    return float((net.cost[own] / far[own]).min()) if own.any() else 0.0


def a_star(net: Network, origin: int, target: int, x: np.ndarray, y: np.ndarray, scale: float, heuristic: str | None = None) -> tuple[float, list[int]]:
    """(cost, edges) to one target, nodes taken in order of cost so far plus ``scale`` times the distance left: straight
    on the plane of x and y, or over the earth (longitudes, latitudes) by one of HEURISTICS.

    The result is a shortest path while no edge costs less than ``scale`` times its length. A node whose cost falls
    after it was taken is taken again, so a plane's distances, which may disagree a little, do no harm.
    """
    first, head, cost, centroid = net.lists()
    left = (scale * (straight_distances(x, y, target, heuristic) if heuristic else np.hypot(x - x[target], y - y[target]))).tolist()
    far = [np.inf] * len(net.nodes)
    into = [-1] * len(net.nodes)
    done = bytearray(len(net.nodes))
    far[origin] = 0.0
    heap = [(left[origin], origin)]
    while heap:
        _, n = heapq.heappop(heap)
        if n == target:
            return far[n], net.path(into, target)
        if done[n]:
            continue
        done[n] = 1
        if net.blocked and centroid[n] and n != origin:
            continue
        for e in range(first[n], first[n + 1]):
            m = head[e]
            if far[n] + cost[e] < far[m]:
                far[m] = far[n] + cost[e]
                into[m] = e
                done[m] = 0
                heapq.heappush(heap, (far[m] + left[m], m))
    return np.inf, []


def reachable(net: Network, origin: int) -> np.ndarray:
    """Nodes that some path from origin enters, by depth-first search; costs do not matter."""
    first, head, _, centroid = net.lists()
    seen = np.zeros(len(net.nodes), bool)
    seen[origin] = True
    stack = [origin]
    while stack:
        n = stack.pop()
        if net.blocked and centroid[n] and n != origin:
            continue
        for e in range(first[n], first[n + 1]):
            if not seen[head[e]]:
                seen[head[e]] = True
                stack.append(head[e])
    return seen


def delaunay(points: np.ndarray) -> list[tuple[int, int]]:
    """Edges of the Delaunay triangulation of distinct points, by inserting them one at a time: triangles whose
    circumcircle holds the new point are replaced by a fan around it."""
    n = len(points)
    if n < 2:
        return []
    low, high = points.min(axis=0), points.max(axis=0)
    span = float(max(high - low)) or 1.0
    mid = (low + high) / 2
    p = np.vstack([points, mid + span * np.array([[-3000, -1000], [3000, -1000], [0, 3000]])])

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = p[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if d == 0:
            return (0.0, 0.0, np.inf)
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d
        uy = (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        return (ux, uy, (ux - ax) ** 2 + (uy - ay) ** 2)

    triangles = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        x, y = p[i]
        bad = [t for t, (ux, uy, r) in triangles.items() if (x - ux) ** 2 + (y - uy) ** 2 < r * (1 + 1e-12)]
        rim: dict[tuple[int, int], int] = {}
        for t in bad:
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                k = (min(e), max(e))
                rim[k] = rim.get(k, 0) + 1
            del triangles[t]
        for (a, b), times in rim.items():
            if times == 1:
                triangles[a, b, i] = circle((a, b, i))
    edges = {(min(a, b), max(a, b)) for t in triangles for a, b in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])) if a < n and b < n}
    if not edges:  # points on one line: neighbours along it
        along = np.lexsort((points[:, 1], points[:, 0]))
        edges = {(min(a, b), max(a, b)) for a, b in zip(along.tolist(), along[1:].tolist(), strict=False)}
    return sorted(edges)
