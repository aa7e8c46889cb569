"""Equilibrium assignment: all-or-nothing, successive averages, Frank-Wolfe and its conjugate forms, several classes.

The searches of an iteration are one Spark job over origins. Link vectors are held by the driver: they have a row per
directed edge, are bounded by the same check as the broadcast network, and their sums, line searches and combinations
then cost microseconds instead of a job each.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.vdf import array_vdf, check_parameters
from wayfare.operators.paths import collect_network, loads_at, packed_demand, skims
from wayfare.plans.staging import cut

ALGORITHMS = ("all-or-nothing", "msa", "frank-wolfe", "cfw", "bfw")
ALIASES = {"fw": "frank-wolfe"}


@dataclass
class TrafficClass:
    """Demand (origin, destination, core) with its passenger-car equivalent, value of time and a fixed cost per edge."""

    name: str
    demand: DataFrame
    core: str = "demand"
    pce: float = 1.0
    vot: float = 1.0
    fixed_cost: str | None = None
    fixed_cost_multiplier: float = 1.0


@dataclass
class Result:
    flows: DataFrame
    report: list[dict]
    times: np.ndarray = field(repr=False, default=None)
    skims: dict = field(default_factory=dict)


class Assignment:
    """Edges (link_id, a_node, b_node, direction, time and capacity fields) and classes, to be assigned by an algorithm."""

    def __init__(self, spark: SparkSession, edges: DataFrame, centroids: list[int], classes: list[TrafficClass], time_field="free_flow_time", capacity_field="capacity", vdf="bpr", alpha=0.15, beta=4.0, blocked=True, partitions: int | None = None):
        if not classes or len({c.name for c in classes}) < len(classes):
            raise ValueError("classes are needed, with different names")
        self.spark, self.edges, self.classes, self.partitions = spark, edges, classes, partitions
        fixed = tuple(c.fixed_cost for c in classes if c.fixed_cost)
        named = tuple(x for x in (alpha, beta) if isinstance(x, str))
        self.net = collect_network(edges, centroids, time_field, (time_field, capacity_field, *fixed, *named), blocked)
        self.t0, self.capacity = self.net.fields[time_field], self.net.fields[capacity_field]
        for name, v in ((time_field, self.t0), (capacity_field, self.capacity)):
            if not np.isfinite(v).all() or (v <= 0).any():
                raise ValueError(f"{name} holds values that are missing or not positive")
        self.alpha, self.beta = (self.net.fields[x] if isinstance(x, str) else np.full(len(self.t0), float(x)) for x in (alpha, beta))
        check_parameters(self.alpha, self.beta)
        self._time, self._slope = array_vdf(vdf)
        self.fixed = []
        for c in classes:
            own = np.nan_to_num(self.net.fields[c.fixed_cost], posinf=0.0) if c.fixed_cost else np.zeros(len(self.t0))
            if (own < 0).any():
                raise ValueError(f"{c.fixed_cost} holds negative costs")
            self.fixed.append(own * c.fixed_cost_multiplier / c.vot)
        self.preload = np.zeros(len(self.t0))
        self._packed = self._shared = None
        self.keys = {(int(a), int(b)): i for i, (a, b) in enumerate(zip(self.net.link, self.net.direction, strict=True))}

    def add_preload(self, preload: DataFrame) -> None:
        """Flow (link_id, direction, preload) that is always there; rows of other links are an error."""
        if set(preload.columns) != {"link_id", "direction", "preload"}:
            raise ValueError("preload has the columns link_id, direction, preload")
        for r in preload.groupBy("link_id", "direction").agg(F.sum("preload").alias("p")).collect():  # a row an edge at most
            if (r.link_id, r.direction) not in self.keys:
                raise ValueError(f"preload on link {r.link_id}, direction {r.direction}, which is not in the network")
            self.preload[self.keys[r.link_id, r.direction]] += r.p or 0.0

    def time(self, v):
        return self._time(v, self.capacity, self.t0, self.alpha, self.beta)

    def slope(self, v):
        return self._slope(v, self.capacity, self.t0, self.alpha, self.beta)

    def _loaded(self, times: np.ndarray) -> list[np.ndarray]:
        """All-or-nothing loads of each class at its own costs, in passenger-car equivalents."""
        if self._packed is None:
            self._packed = [packed_demand(c.demand, [c.core], self.partitions) for c in self.classes]
            self.net._lists = self.net._ranks = None
            self._shared = self.spark.sparkContext.broadcast(self.net)
        out = []
        for c, fixed, packed in zip(self.classes, self.fixed, self._packed, strict=True):
            cost = self.spark.sparkContext.broadcast(times + fixed)
            y = np.zeros(len(times))
            t = loads_at(self._shared, cost, packed, [c.core]).toArrow()
            at = [self.keys[k] for k in zip(t.column("link_id").to_pylist(), t.column("direction").to_pylist(), strict=True)]
            y[at] = t.column(c.core).to_numpy()
            out.append(y * c.pce)
            cost.destroy()
        return out

    def execute(self, algorithm: str = "bfw", max_iter: int = 250, rgap_target: float = 1e-4, steps_below_needed: int = 1, skim_fields: tuple[str, ...] = (), path_folder: str | None = None) -> Result:
        """Assign. With ``skim_fields`` (the cost and fields of the edges), skims of each class are kept: ``final``, at the
        last times, and ``blended``, averaged over the iterations as flows are. With a folder, each iteration's paths of
        each class are stored there. Both read every iteration's searches again."""
        algorithm = ALIASES.get(algorithm, algorithm)
        if algorithm not in ALGORITHMS:
            raise ValueError(f"unknown algorithm {algorithm}; there are {', '.join(ALGORITHMS)}")
        n = len(self.classes)
        times, report, below = self.time(self.preload) if self.preload.any() else self.t0.copy(), [], 0
        x: list[np.ndarray] = []
        s: list[np.ndarray] = []
        older: list[np.ndarray] = []
        step, restart, conjugate_failed, betas = 1.0, False, False, (1.0, 0.0, 0.0)
        weights: list[tuple[float, dict]] = []
        for k in range(1, max_iter + 1):
            y = self._loaded(times)
            if path_folder:
                self._store_paths(times, k, path_folder)
            seen = {c.name: cut(self._class_skims(i, times, skim_fields)) for i, c in enumerate(self.classes)} if skim_fields else {}
            if k == 1:
                x, s, older, step = [v.copy() for v in y], [v.copy() for v in y], [v.copy() for v in y], 1.0
            else:
                total = sum(x) + self.preload
                for attempt in range(2):
                    plain = k == 2 or step == 1.0 or restart or algorithm in ("msa", "frank-wolfe")
                    new, betas, kind = self._direction(x, y, s, older, step, plain, algorithm == "cfw" or k == 3 or conjugate_failed)
                    if algorithm == "msa":
                        lam, retry = 1.0 / k, False
                    else:
                        lam, retry = self._line_search(x, new, total, k, kind == "fw", rgap_target)
                    if not retry:
                        conjugate_failed = False
                        break
                    restart = conjugate_failed = True
                restart = False
                older, s, step = s, new, lam
                x = [lam * d + (1 - lam) * f for d, f in zip(s, x, strict=True)]
            # a conjugate direction holds older searches too: of the new one it takes beta0
            weights.append((1.0 if k == 1 else step * betas[0], seen))
            v = sum(x) + self.preload
            if algorithm == "all-or-nothing":
                times = self.time(v)
                report.append({"iteration": k, "rgap": float("inf"), "alpha": 1.0, "warnings": ""})
                break
            if k > 1:
                cost = float(times @ v)
                gap = abs(cost - float(times @ sum(y))) / cost if cost else 0.0
                report.append({"iteration": k, "rgap": gap, "alpha": step, "warnings": "", "beta0": betas[0], "beta1": betas[1], "beta2": betas[2]})
                below = below + 1 if gap <= rgap_target else 0
            else:
                report.append({"iteration": 1, "rgap": float("inf"), "alpha": 1.0, "warnings": "", "beta0": 1.0, "beta1": 0.0, "beta2": 0.0})
            times = self.time(v)
            if below >= steps_below_needed:
                break
        self.flow_arrays = [f / c.pce for f, c in zip(x, self.classes, strict=True)]
        result = Result(self._flows(times, n), report, times)
        if skim_fields:
            names = ["cost", *[f for f in skim_fields if f != "cost"]]
            result.skims = {c.name: {"final": self._class_skims(i, times, skim_fields), "blended": self.blended_skims([(w, s[c.name]) for w, s in weights], names)} for i, c in enumerate(self.classes)}
        return result

    def _class_skims(self, which: int, times: np.ndarray, fields: tuple[str, ...]) -> DataFrame:
        """origin, destination, cost and fields of a class's shortest paths, its fixed costs included."""
        self.net.cost = times + self.fixed[which]
        self.net._lists = self.net._ranks = None
        zones = self.net.nodes[self.net.is_centroid].tolist()
        return skims(self.spark, self.net, self.spark.createDataFrame([(int(z),) for z in zones], "origin long"), tuple(f for f in fields if f != "cost"))

    def _store_paths(self, times: np.ndarray, iteration: int, folder: str) -> None:
        from wayfare.operators.paths import shortest_paths
        from wayfare.sources.tables import save_paths

        for c, fixed in zip(self.classes, self.fixed, strict=True):
            self.net.cost = times + fixed
            self.net._lists = self.net._ranks = None
            pairs = c.demand.filter(F.col(c.core) > 0).filter("origin <> destination").select("origin", "destination")
            save_paths(shortest_paths(self.spark, self.net, pairs), iteration, c.name, folder)

    def _direction(self, x, y, s, older, step, plain, one_conjugate):
        if plain:
            return [v.copy() for v in y], (1.0, 0.0, 0.0), "fw"
        xs, ys, ss, os = sum(x), sum(y), sum(s), sum(older)
        d = self.slope(xs + self.preload)
        if one_conjugate:
            p, a = ss - xs, ys - xs
            below = float((d * p * (ys - ss)).sum())
            alpha = min(max(float((d * p * a).sum()) / below, 0.0), 0.99999) if below else 0.0
            return [alpha * i + (1 - alpha) * j for i, j in zip(s, y, strict=True)], (1 - alpha, alpha, 0.0), "cfw"
        big_x, big_y, big_z, big_w = step * ss + (1 - step) * os - xs, ys - xs, ss - xs, os - ss
        xw, zz = float((d * big_x * big_w).sum()), float((d * big_z * big_z).sum())
        mu = max(0.0, -float((d * big_x * big_y).sum()) / xw) if xw else 0.0
        nu = max(0.0, -float((d * big_z * big_y).sum()) / zz + mu * step / (1 - step)) if zz else 0.0
        b = np.array([1.0, nu, mu]) / (1 + nu + mu)
        return [b[0] * i + b[1] * j + b[2] * k for i, j, k in zip(y, s, older, strict=True)], tuple(b.tolist()), "bfw"

    def _line_search(self, x, s, total, k, plain, rgap) -> tuple[float, bool]:
        """Root of the objective's slope on [0, 1], and whether a conjugate direction is to be given up."""
        ways = [b - a for a, b in zip(x, s, strict=True)]
        way = sum(ways)
        constant = sum(float(f @ w) for f, w in zip(self.fixed, ways, strict=True))
        g = lambda lam: float(self.time(total + lam * way) @ way) + constant
        low, high = g(0.0), g(1.0)
        if low * high > 0:
            if low < high:
                return (0.01 / k, False) if plain else (0.0, True)
            return 1.0, False
        return brent(g, 0.0, 1.0, low, high, max(min(1e-6, rgap * 1e-5), 1e-12)), False

    def select_links(self, result: Result, sets: dict[str, list[tuple[int, int]]]) -> dict[str, tuple[DataFrame, DataFrame]]:
        """Per class, loads and demand of the paths at the final times that use any link of each set."""
        from wayfare.operators.paths import select_link, shortest_paths

        out = {}
        for c, fixed in zip(self.classes, self.fixed, strict=True):
            self.net.cost = result.times + fixed
            self.net._lists = self.net._ranks = None
            pairs = c.demand.filter(F.col(c.core) > 0).filter("origin <> destination").select("origin", "destination")
            out[c.name] = select_link(shortest_paths(self.spark, self.net, pairs), c.demand, sets, c.core)
        return out

    def info(self) -> dict:
        """What is assigned, and on what."""
        return {"classes": {c.name: {"core": c.core, "pce": c.pce, "vot": c.vot, "fixed_cost": c.fixed_cost} for c in self.classes}, "edges": len(self.t0), "nodes": len(self.net.nodes), "centroids": int(self.net.is_centroid.sum()), "preloaded": bool(self.preload.any())}

    def blended_skims(self, steps: list[tuple[float, DataFrame]], fields: list[str]) -> DataFrame:
        """Skims of the iterations averaged as their flows were: each (step, skims) takes that share of what came before."""
        weights, rest = [], 1.0
        for step, _ in reversed(steps):
            weights.append(rest * step)
            rest *= 1 - step
        parts = [df.select("origin", "destination", *[(F.col(f) * w).alias(f) for f in fields]) for w, (_, df) in zip(reversed(weights), steps, strict=True) if w]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("origin", "destination").agg(*[F.sum(f).alias(f) for f in fields])

    def _flows(self, times: np.ndarray, n: int) -> DataFrame:
        v = sum(f * c.pce for f, c in zip(self.flow_arrays, self.classes, strict=True)) + self.preload
        # The names of result columns.
        cols = {"link_id": self.net.link, "direction": self.net.direction.astype(np.int32), **{c.name: f for c, f in zip(self.classes, self.flow_arrays, strict=True)}, "Preload": self.preload, "Congested_Time": times, "Delay_factor": times / self.t0, "VOC": v / self.capacity, "PCE": v}
        import pandas as pd

        return self.spark.createDataFrame(pd.DataFrame(cols))

    def final_skims(self, result: Result, fields: tuple[str, ...]) -> dict[str, DataFrame]:
        """By class, skims at the final times with the class's fixed costs."""
        return {c.name: self._class_skims(i, result.times, fields) for i, c in enumerate(self.classes)}


def results_table(flows: DataFrame, classes: list[str]) -> DataFrame:
    """One row a link: _ab, _ba, _tot (or _max) of flows, preload, time, delay, V/C and PCE; a missing way is null."""
    way = lambda f, d: F.max(F.when(F.col("direction") == d, F.col(f)))
    wide = flows.groupBy("link_id").agg(*[x for f in (*classes, "Preload", "Congested_Time", "Delay_factor", "VOC", "PCE") for x in (way(f, 1).alias(f"{f}_AB"), way(f, -1).alias(f"{f}_BA"))])
    both = lambda f: (F.coalesce(f"{f}_AB", F.lit(0.0)) + F.coalesce(f"{f}_BA", F.lit(0.0)))
    most = lambda f: F.greatest(f"{f}_AB", f"{f}_BA")
    return wide.select("*", *[both(f).alias(f"{f}_tot") for f in (*classes, "Preload", "PCE")], *[most(f).alias(f"{f}_Max") for f in ("Congested_Time", "Delay_factor", "VOC")])


def brent(g, a: float, b: float, fa: float, fb: float, tolerance: float, most: int = 100) -> float:
    """A root of g between a and b, whose values fa and fb differ in sign: inverse interpolation guarded by bisection."""
    if fa == 0:
        return a
    if fb == 0:
        return b
    if abs(fa) < abs(fb):
        a, b, fa, fb = b, a, fb, fa
    c, fc, last, halved = a, fa, 0.0, True
    for _ in range(most):
        if fb == 0 or abs(b - a) < tolerance:
            break
        if fa != fc and fb != fc:
            t = a * fb * fc / ((fa - fb) * (fa - fc)) + b * fa * fc / ((fb - fa) * (fb - fc)) + c * fa * fb / ((fc - fa) * (fc - fb))
        else:
            t = b - fb * (b - a) / (fb - fa)
        edge = (3 * a + b) / 4
        if not min(edge, b) < t < max(edge, b) or abs(t - b) >= abs((b - c) if halved else (c - last)) / 2:
            t, halved = (a + b) / 2, True
        else:
            halved = False
        ft = g(t)
        last, c, fc = c, b, fb
        if fa * ft < 0:
            b, fb = t, ft
        else:
            a, fa = t, ft
        if abs(fa) < abs(fb):
            a, b, fa, fb = b, a, fb, fa
    return b
