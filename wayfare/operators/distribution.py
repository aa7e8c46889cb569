"""Trip distribution: iterative proportional fitting, gravity application and calibration, all relational.

A matrix is (origin, destination, flow) and margins (zone_id, production) and (zone_id, attraction).
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.plans.staging import BROADCAST_ROWS, cut, small

BALANCE = 1e-3
#: Cells that one task fits by itself (24 bytes each, and as much again at work).
TASK_CELLS = 4_000_000
#: Cells that a task computes of a seed that is an expression.
COMPUTED_CELLS = 1 << 25


def check_balance(productions: DataFrame, attractions: DataFrame, tolerance: float = BALANCE) -> tuple[float, float]:
    p = productions.agg(F.sum("production")).first()[0] or 0.0
    a = attractions.agg(F.sum("attraction")).first()[0] or 0.0
    if abs(p - a) > tolerance:
        raise ValueError(f"margins are not balanced: {p} and {a}")
    if p <= 0:
        raise ValueError("margins sum to nothing")
    return p, a


def _needed(sums: DataFrame, by: str, target: dict) -> dict:
    """The factor of each zone of one end: its target over t, the sum of its cells at the other end's present scales."""
    return {r[by]: (target.get(r[by], 0.0) / r.t if target.get(r[by], 0.0) > 0 and r.t else 0.0) for r in sums.collect()}  # a row a zone


def _stored_sums(cells: DataFrame) -> Callable[[str, str, dict], DataFrame]:
    """Sums by one end of stored cells, to which the other end's scales come by broadcast."""

    def sums(by: str, other: str, scales: dict) -> DataFrame:
        table = F.broadcast(cells.sparkSession.createDataFrame([(int(z), float(s)) for z, s in scales.items()], f"{other} long, scale double"))
        return cells.join(table, other).groupBy(by).agg(F.sum(F.col("flow") * F.col("scale")).alias("t"))

    return sums


def _tasks(spark, cells: int) -> int:
    return max(spark.sparkContext.defaultParallelism, cells // COMPUTED_CELLS + 1)


def _pairs_by_zone(spark, streamed: list[tuple], streamed_schema: str, other: list[tuple], other_schema: str) -> DataFrame:
    """Every row of one list with every row of the other, for sums: the first is dealt over tasks, the second is sent to
    all of them, and a task's rows of one zone follow one another."""
    tasks = min(_tasks(spark, len(streamed) * len(other)), max(len(streamed), 1))
    return spark.createDataFrame(streamed, streamed_schema).repartition(tasks).crossJoin(F.broadcast(spark.createDataFrame(other, other_schema)))


def _pairs_by_number(spark, rows: list[tuple], rows_schema: str, cols: list[tuple], cols_schema: str) -> DataFrame:
    """The same pairs one at a time, for rows that leave: each number of a range looks up its ends, and no row is copied
    to wait for the others of its zone."""
    numbered = lambda ends, schema, by: F.broadcast(spark.createDataFrame([(k, *e) for k, e in enumerate(ends)], f"{by} long, {schema}"))
    cells, n = len(rows) * len(cols), max(len(cols), 1)
    numbers = spark.range(0, cells, 1, _tasks(spark, cells)).select(F.expr(f"id div {n}").alias("__row"), (F.col("id") % n).alias("__col"))
    return numbers.join(numbered(rows, rows_schema, "__row"), "__row").join(numbered(cols, cols_schema, "__col"), "__col")


def _computed_sums(spark, flow: Column, made: dict, drawn: dict) -> Callable[[str, str, dict], DataFrame]:
    """Sums by one end of a seed that is an expression: nothing but zones is stored or shuffled."""
    margins = {"origin": {z: v for z, v in made.items() if v}, "destination": drawn}
    kind = {"origin": "production", "destination": "attraction"}

    def sums(by: str, other: str, scales: dict) -> DataFrame:
        own, rest = ([(int(z), float(v)) for z, v in margins[e].items()] for e in (by, other))
        cells = _pairs_by_zone(spark, own, f"{by} long, {kind[by]} double", [(z, v, float(scales[z])) for z, v in rest], f"{other} long, {kind[other]} double, scale double")
        return cells.groupBy(by).agg(F.sum(flow * F.col("scale")).alias("t"))

    return sums


def _fitted_by_jobs(sums: Callable[[str, str, dict], DataFrame], made: dict, drawn: dict, row_scale: dict, col_scale: dict, most: int, tolerance: float | None) -> list[dict]:
    """Rounds of two jobs each; changes the scales in place and returns the report."""
    report: list[dict] = []
    for k in range(1, most + 1):
        # factors of the rows are against the columns' scales times their own, and the other way round
        needed = _needed(sums("origin", "destination", col_scale), "origin", made)
        r = {z: (needed[z] / row_scale[z] if row_scale[z] else 0.0) for z in needed if made.get(z, 0.0) > 0}
        row_scale.update({z: needed[z] for z in r})
        needed = _needed(sums("destination", "origin", row_scale), "destination", drawn)
        c = {z: (needed[z] / col_scale[z] if col_scale[z] else 0.0) for z in needed}
        col_scale.update(needed)
        error = max([max(f, 1 / f if f > 0 else 1.0, 1.0) for f in (*r.values(), *c.values())], default=1.0) - 1
        report.append({"iteration": k, "error": error})
        if tolerance is not None and error < tolerance:
            break
    return report


def _fitted_in_task(cells: DataFrame, made: dict, drawn: dict, row_scale: dict, col_scale: dict, most: int, tolerance: float | None) -> tuple[dict, dict, list[dict]]:
    """The same rounds over all cells at once, in one task: for matrices that fit one."""

    def fit(group: pa.Table) -> pa.Table:
        rows, i = np.unique(group.column("origin").to_numpy(), return_inverse=True)
        cols, j = np.unique(group.column("destination").to_numpy(), return_inverse=True)
        flow = group.column("flow").to_numpy()
        p, a = np.array([made.get(int(z), 0.0) for z in rows]), np.array([drawn.get(int(z), 0.0) for z in cols])
        r, c = np.array([row_scale.get(int(z), 1.0) for z in rows]), np.array([col_scale.get(int(z), 1.0) for z in cols])
        part = lambda wanted, sums: np.divide(wanted, sums, out=np.zeros(len(wanted)), where=(wanted > 0) & (sums != 0))
        change = lambda new, old: np.divide(new, old, out=np.zeros(len(new)), where=old != 0)
        errors = []
        for _ in range(most):
            needed = part(p, np.bincount(i, flow * c[j], len(rows)))
            by_row, r = change(needed, r)[p > 0], np.where(p > 0, needed, r)
            needed = part(a, np.bincount(j, flow * r[i], len(cols)))
            by_col, c = change(needed, c), needed
            f = np.concatenate([by_row, by_col])
            errors.append(float(np.max(np.maximum(np.maximum(f, np.divide(1.0, f, out=np.ones(len(f)), where=f > 0)), 1.0), initial=1.0) - 1))
            if tolerance is not None and errors[-1] < tolerance:
                break
        kind = ["row"] * len(rows) + ["column"] * len(cols) + ["error"] * len(errors)
        return pa.table({"kind": pa.array(kind, pa.string()), "at": pa.array(np.concatenate([rows, cols, np.arange(1, len(errors) + 1)]), pa.int64()), "value": pa.array(np.concatenate([r, c, errors]), pa.float64())})

    found = cells.groupBy(F.lit(0).alias("all")).applyInArrow(fit, "kind string, at long, value double").collect()  # zones and rounds
    take = lambda kind: {r.at: r.value for r in found if r.kind == kind}
    report = [{"iteration": k, "error": e} for k, e in sorted(take("error").items())]
    if not report:  # no cell at all: nothing changes
        report = [{"iteration": k, "error": 0.0} for k in range(1, (1 if tolerance is not None else most) + 1)]
    return row_scale | take("row"), col_scale | take("column"), report


def _seed_flow(flow: Column) -> Column:
    """A cell's seed: nothing where it is missing or neither end has anything."""
    return F.when(F.col("production") + F.col("attraction") == 0, 0.0).otherwise(F.coalesce(F.nanvl(flow.cast("double"), F.lit(0.0)), F.lit(0.0)))


def _fitted_computed(spark, seed: Column, made: dict, drawn: dict, most: int, tolerance: float | None) -> tuple[DataFrame, list[dict]]:
    """ipf of a seed that is an expression, over all pairs of zones."""
    flow = _seed_flow(seed)
    row_scale, col_scale = dict.fromkeys(made, 1.0), dict.fromkeys(drawn, 1.0)
    report = _fitted_by_jobs(_computed_sums(spark, flow, made, drawn), made, drawn, row_scale, col_scale, most, tolerance)
    rows, cols = ([(int(z), float(v), float(scale[z])) for z, v in margin.items()] for margin, scale in ((made, row_scale), (drawn, col_scale)))
    out = _pairs_by_number(spark, rows, "origin long, production double, r double", cols, "destination long, attraction double, c double")
    fitted = F.when(F.col("production") > 0, flow * F.col("r") * F.col("c")).otherwise(flow)
    return out.select("origin", "destination", fitted.alias("flow")), report


def ipf(seed: DataFrame | Column, productions: DataFrame, attractions: DataFrame, tolerance: float = 1e-4, max_iterations: int = 5000, fixed_iterations: int | None = None) -> tuple[DataFrame, list[dict]]:
    """(origin, destination, flow) fitted to both margins, and a report (iteration from 1, error).

    Up to ``TASK_CELLS`` cells one task does all rounds. Beyond: a fitted cell is its seed times a scale of its row and one of its column, so only two vectors of zones change. Each
    half of an iteration is one aggregation of the stored seed by one end, with the other end's scales broadcast (zones
    are at most ``BROADCAST_ROWS``); no plan grows. The error is the greatest of all factors and their inverses, less
    one. Rows without production keep their seed unless their attraction is zero too, and are in no sum.

    A seed that is an expression of the columns origin and destination stands for all pairs of a zone with a production
    and one with an attraction. Beyond ``TASK_CELLS`` it is computed anew by each aggregation and by the result, and the
    matrix is never stored (unless a margin has a zone twice, whose cells then come twice).
    """
    spark = productions.sparkSession
    p, a = check_balance(productions, attractions)
    zones = productions.select("zone_id").unionByName(attractions.select("zone_id")).distinct()
    if zones.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        raise ValueError("more zones than a broadcast holds")
    ends = productions.collect(), attractions.collect()  # zones
    made = {r.zone_id: r.production or 0.0 for r in ends[0]}
    drawn = {r.zone_id: (r.attraction or 0.0) * (p / a) for r in ends[1]}
    rounds = (fixed_iterations or max_iterations, None if fixed_iterations else tolerance)
    if isinstance(seed, Column):
        if len(made) * len(drawn) > TASK_CELLS and (len(made), len(drawn)) == (len(ends[0]), len(ends[1])):
            return _fitted_computed(spark, seed, made, drawn, *rounds)
        keys = productions.select(F.col("zone_id").alias("origin")), attractions.select(F.col("zone_id").alias("destination"))
        seed = keys[0].crossJoin(keys[1]).withColumn("flow", seed)
    rows = F.broadcast(spark.createDataFrame([(int(z), float(v)) for z, v in made.items()], "origin long, production double"))
    cols = F.broadcast(spark.createDataFrame([(int(z), float(v)) for z, v in drawn.items()], "destination long, attraction double"))
    whole = seed.join(rows, "origin", "left").join(cols, "destination", "left").fillna(0.0, ["production", "attraction"])
    whole = cut(whole.select("origin", "destination", "production", _seed_flow(F.col("flow")).alias("flow")))
    cells = whole.filter("production <> 0").select("origin", "destination", "flow")
    row_scale = {z: 1.0 for z in made}
    col_scale = {z: 1.0 for z in drawn}
    for z in [r.destination for r in cells.select("destination").distinct().collect() if r.destination not in col_scale]:  # zones
        col_scale[z] = 1.0
        drawn[z] = 0.0
    if cells.limit(TASK_CELLS + 1).count() <= TASK_CELLS:
        row_scale, col_scale, report = _fitted_in_task(cells, made, drawn, row_scale, col_scale, *rounds)
    else:
        report = _fitted_by_jobs(_stored_sums(cells), made, drawn, row_scale, col_scale, *rounds)
    rows = F.broadcast(spark.createDataFrame([(int(z), float(v)) for z, v in row_scale.items()], "origin long, r double"))
    cols = F.broadcast(spark.createDataFrame([(int(z), float(v)) for z, v in col_scale.items()], "destination long, c double"))
    out = whole.join(rows, "origin", "left").join(cols, "destination", "left")
    fitted = F.when(F.col("production") > 0, F.col("flow") * F.col("r") * F.col("c")).otherwise(F.col("flow"))
    return out.select("origin", "destination", fitted.alias("flow")), report


@dataclass
class GravityModel:
    """A deterrence function: EXPO e^(-beta c), POWER c^(-alpha), GAMMA c^alpha e^(-beta c)."""

    function: str
    alpha: float | None = None
    beta: float | None = None

    def __post_init__(self):
        self.function = self.function.upper()
        needed = {"EXPO": {"beta"}, "POWER": {"alpha"}, "GAMMA": {"alpha", "beta"}}
        if self.function not in needed:
            raise ValueError(f"unknown deterrence function {self.function}")
        given = {n for n in ("alpha", "beta") if getattr(self, n) is not None}
        if given != needed[self.function]:
            raise ValueError(f"{self.function} takes {' and '.join(sorted(needed[self.function]))}")

    def deterrence(self, cost: Column) -> Column:
        if self.function == "EXPO":
            return F.exp(-self.beta * cost)
        if self.function == "POWER":
            return F.when(cost != 0, F.pow(cost, F.lit(-self.alpha)))
        return F.when((cost != 0) | F.lit(self.alpha >= 0), F.pow(cost, F.lit(self.alpha))) * F.exp(-self.beta * cost)

    def save(self, spark, path: str) -> None:
        """A line of JSON in a folder of any store that Spark reaches."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark, path: str) -> GravityModel:
        return cls(**json.loads(spark.read.text(path).first().value))


def gravity_seed(impedance: DataFrame, productions: DataFrame, attractions: DataFrame, model: GravityModel, max_cost: float | None = None) -> DataFrame:
    """Flows f(cost) * production * attraction scaled to the total production; pairs beyond max_cost get none."""
    rows = productions.select(F.col("zone_id").alias("origin"), "production")
    cols = attractions.select(F.col("zone_id").alias("destination"), "attraction")
    cells = impedance.join(small(rows), "origin").join(small(cols), "destination")
    raw = model.deterrence(F.col("cost")) * F.col("production") * F.col("attraction")
    finite = F.when(raw.isNull() | F.isnan(raw) | (F.abs(raw) == F.lit(float("inf"))), 0.0).otherwise(raw)
    if max_cost is not None:
        finite = F.when(F.col("cost") < max_cost, finite).otherwise(0.0)
    cells = cells.select("origin", "destination", finite.alias("raw"))
    sums = cells.agg(F.sum("raw").alias("raw_total")).crossJoin(productions.agg(F.sum("production").alias("all")))  # one row
    return cells.crossJoin(F.broadcast(sums)).select("origin", "destination", F.coalesce(F.try_divide(F.col("raw") * F.col("all"), F.col("raw_total")), F.lit(0.0)).alias("flow"))


def apply_gravity(impedance: DataFrame, productions: DataFrame, attractions: DataFrame, model: GravityModel, max_cost: float | None = None, **ipf_options) -> tuple[DataFrame, list[dict]]:
    return ipf(gravity_seed(impedance, productions, attractions, model, max_cost), productions, attractions, **ipf_options)


def mean_cost(flows: DataFrame, impedance: DataFrame) -> float:
    row = flows.join(impedance, ["origin", "destination"]).agg(F.sum(F.col("flow") * F.col("cost")).alias("n"), F.sum("flow").alias("d")).first()
    return row.n / row.d


def calibrate_gravity(observed: DataFrame, impedance: DataFrame, function: str = "EXPO", max_error: float = 1e-4, max_iterations: int = 100, compat: bool = False, **ipf_options) -> tuple[GravityModel, list[dict]]:
    """The parameter whose modelled mean cost is the observed one, by Hyman's secant; starts at 1 / mean cost.

    ``compat`` keeps the parameter after the second evaluation, as a degenerate secant does.
    """
    if function.upper() not in ("EXPO", "POWER"):
        raise ValueError("EXPO and POWER have the one parameter to calibrate")
    productions = observed.groupBy(F.col("origin").alias("zone_id")).agg(F.sum("flow").alias("production"))
    attractions = observed.groupBy(F.col("destination").alias("zone_id")).agg(F.sum("flow").alias("attraction"))
    target = mean_cost(observed, impedance)
    name = "beta" if function.upper() == "EXPO" else "alpha"
    report: list[dict] = []

    def cost_of(b: float) -> float:
        flows, _ = apply_gravity(impedance, productions, attractions, GravityModel(function, **{name: b}), **ipf_options)
        c = mean_cost(flows, impedance)
        report.append({"iteration": len(report) + 1, "parameter": b, "cost": c, "error": abs(c / target - 1)})
        return c

    b0 = 1 / target
    c0 = cost_of(b0)
    b1 = b0 * c0 / target
    c1 = cost_of(b1)
    while not compat and len(report) < max_iterations and report[-1]["error"] > max_error and c1 != c0:
        b0, b1 = b1, ((target - c0) * b1 - (target - c1) * b0) / (c1 - c0)
        c0, c1 = c1, cost_of(b1)
    return GravityModel(function, **{name: b1}), report
