"""Contingency rankings, error metrics, state estimation, reliability by sampling, distribution plans and graph exports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Hours of a year, as the indices count them.
HOURS, HOURS_LOLE = 8760.0, 8766.0
#: Lowest scores of the reliability bands.
BANDS = [(90.0, "Excellent"), (80.0, "Good"), (70.0, "Fair"), (60.0, "Poor")]


def indices(evaluations: DataFrame, hours: float = HOURS) -> DataFrame:
    """Adds eue (probability x shed x hours) and severity (probability x overload in percent); both 0 without a probability."""
    p = F.col("probability")
    return evaluations.withColumn("eue", F.coalesce(p * F.col("load_shed_mw") * hours, F.lit(0.0))).withColumn("severity", F.when(F.col("max_loading") > 1, F.coalesce(p * (F.col("max_loading") - 1) * 100, F.lit(0.0))).otherwise(0.0))


def by_severity(evaluations: DataFrame) -> DataFrame:
    """Contingencies with violations, the highest loading first."""
    return evaluations.where("violations > 0").orderBy(F.desc("max_loading"), "contingency")


def top_by(evaluations: DataFrame, column: str, n: int) -> DataFrame:
    """The n contingencies with the largest values, ties by name."""
    return evaluations.orderBy(F.desc(column), "contingency").limit(n)


def concentration(evaluations: DataFrame, n: int) -> DataFrame:
    """Percent of the whole EUE that the n largest contingencies hold; 0 without any."""
    top = top_by(evaluations, "eue", n).agg(F.sum("eue").alias("top"))
    d = top.crossJoin(evaluations.agg(F.sum("eue").alias("total")))
    return d.select(F.when(F.col("total") != 0, 100 * F.col("top") / F.col("total")).otherwise(0.0).alias("concentration_pct"))


def worst(evaluations: DataFrame) -> DataFrame:
    """One row: counts of violated and non-convergent contingencies, and the converged one with the highest loading, the last name of equals."""
    best = F.max(F.when(F.col("converged"), F.struct("max_loading", "contingency")))
    d = evaluations.agg(F.count("*").alias("n"), F.sum((F.col("violations") > 0).cast("long")).alias("n_violated"), F.sum((~F.col("converged")).cast("long")).alias("n_not_converged"), best.alias("b"))
    return d.select("n", "n_violated", "n_not_converged", F.coalesce("b.max_loading", F.lit(0.0)).alias("worst_loading"), F.col("b.contingency").alias("worst_contingency"))


def largest_flow(flows: DataFrame, keys: list[str]) -> DataFrame:
    """Per case the branch with the largest flow either way, the lowest id of equals."""
    d = flows.groupBy(*keys).agg(F.max(F.struct(F.abs("flow_mw").alias("f"), (-F.col("branch_id")).alias("i"))).alias("m"))
    return d.select(*keys, (-F.col("m.i")).alias("branch_id"), F.col("m.f").alias("max_abs_flow_mw"))


def after_outage(factors: DataFrame, flows: DataFrame) -> DataFrame:
    """(branch_m, branch_l, flow_mw): what flows on branch l once branch m is out, from factors (branch_l, branch_m, lodf)."""
    at = lambda c: flows.select(F.col("branch_id").alias(f"branch_{c}"), F.col("flow_mw").alias(f"f{c}"))
    return factors.where("branch_l <> branch_m").join(at("l"), "branch_l").join(at("m"), "branch_m").select("branch_m", "branch_l", (F.col("fl") + F.col("lodf") * F.col("fm")).alias("flow_mw"))


def flow_errors(got: DataFrame, reference: DataFrame) -> DataFrame:
    """Largest and mean errors of magnitudes and angles (bus_id, vm, va in radians) over the buses of both; angles in degrees."""
    d = got.alias("g").join(reference.alias("r"), "bus_id").select(F.abs(F.col("g.vm") - F.col("r.vm")).alias("m"), F.abs(F.col("g.va") - F.col("r.va")).alias("a"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return d.agg(F.count("m").alias("n_buses"), z(F.max("m")).alias("max_vm_error"), z(F.degrees(F.max("a"))).alias("max_va_error_deg"), z(F.avg("m")).alias("mean_vm_error"), z(F.degrees(F.sum("a") / F.greatest(F.count("m"), F.lit(1)))).alias("mean_va_error_deg"))


def limit_excess(voltages: DataFrame, units: DataFrame, flows: DataFrame) -> DataFrame:
    """Largest excess over the limits of magnitudes (vm, vmin, vmax), outputs (p, pmin, pmax) and loadings (s, limit); 0 where none is broken."""
    over = lambda v, lo, hi: F.greatest(F.col(lo) - F.col(v), F.col(v) - F.col(hi), F.lit(0.0))
    z = lambda c, n: F.coalesce(F.max(c), F.lit(0.0)).alias(n)
    a = voltages.agg(z(over("vm", "vmin", "vmax"), "max_vm_violation_pu"))
    b = units.agg(z(over("p", "pmin", "pmax"), "max_p_violation_mw"))
    return a.crossJoin(b).crossJoin(flows.agg(z(F.greatest(F.abs("s") - F.col("limit"), F.lit(0.0)), "max_branch_flow_violation_mva")))


def objective_gap(objective: Column, reference: Column) -> tuple[Column, Column]:
    """Absolute gap, and relative to the reference; 0 where that is near 0."""
    gap = F.abs(objective - reference)
    return gap, F.when(F.abs(reference) > 1e-10, gap / F.abs(reference)).otherwise(0.0)


def angle_unit(angles: DataFrame, key: list[str], expected: str = "radians") -> DataFrame:
    """The unit that angles (va) look like: degrees if over 30 % lie beyond 1.5, radians if over 90 % lie within 1 and none beyond 2, else the expected one."""
    a = F.abs("va")
    d = angles.groupBy(*key).agg(F.count("va").alias("n"), F.max(a).alias("max_abs"), F.avg((a > 1.5).cast("double")).alias("_large"), F.avg((a < 1).cast("double")).alias("_small"))
    unit = F.when(F.col("_large") > 0.3, "degrees").when((F.col("_small") > 0.9) & (F.col("max_abs") < 2), "radians").otherwise(expected)
    return d.select(*key, "n", "max_abs", unit.alias("unit"))


def estimation_summary(trials: DataFrame) -> DataFrame:
    """Of trials (converged, mae_deg, rmse_deg, max_error_deg, se_time_ms): rates, means and the deviation of a population over converged ones; the median is at index n / 2, p95 at index 0.95 n, both cut to whole numbers."""
    total = trials.agg(F.count("*").alias("total_trials"), F.sum(F.col("converged").cast("long")).alias("converged_trials"))
    ok = trials.where("converged")
    means = ok.agg(F.avg("mae_deg").alias("mean_mae_deg"), F.stddev_pop("mae_deg").alias("std_mae_deg"), F.avg("rmse_deg").alias("mean_rmse_deg"), F.avg("max_error_deg").alias("mean_max_error_deg"), F.avg("se_time_ms").alias("mean_se_time_ms"))
    counts = ok.groupBy("se_time_ms").agg(F.count("*").alias("c")).withColumn("end", F.sum("c").over(W.orderBy("se_time_ms")))
    d = counts.crossJoin(F.broadcast(total))
    at = lambda share: F.min(F.when(F.col("end") > F.least(F.floor(F.col("converged_trials") * F.lit(share)), F.col("converged_trials") - 1), F.col("se_time_ms")))
    return total.crossJoin(means).crossJoin(d.agg(at(0.5).alias("median_se_time_ms"), at(0.95).alias("p95_se_time_ms"))).withColumn("convergence_rate", F.when(F.col("total_trials") > 0, F.col("converged_trials") / F.col("total_trials")).otherwise(0.0))


def residuals(measurements: DataFrame, angles: DataFrame) -> DataFrame:
    """measurements (type, bus_id, value, weight) with residual: angles against estimates (bus_id, angle_rad), 0 where none; magnitudes against 1; flows and injections are 0 here."""
    d = measurements.join(angles, "bus_id", "left")
    r = F.when(F.col("type") == "angle", F.col("value") - F.coalesce("angle_rad", F.lit(0.0))).when(F.col("type") == "voltage", F.col("value") - 1).otherwise(0.0)
    return d.withColumn("residual", r)


def chi_square(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("residual") * F.col("residual")).alias("chi2"), F.count("*").alias("n"))


def stations_to_buses(frames: DataFrame, stations: DataFrame) -> DataFrame:
    """Frames with the bus they name, else that of their station; those with neither are left out."""
    d = frames.join(stations.select("station", F.col("bus_id").alias("_of_station")), "station", "left")
    return d.withColumn("bus_id", F.coalesce("bus_id", "_of_station")).drop("_of_station").where("bus_id is not null")


def estimate(buses: DataFrame, branches: DataFrame, measurements: DataFrame, base_mva: float = 1.0) -> DataFrame:
    """Weighted least squares for bus angles, one network a task: measurements (id, type, branch_id, bus_id, value, weight) with estimate and residual. The first bus has angle 0. Types: flow, injection, angle; others have no estimate."""
    none = lambda t: F.lit(None).cast(t)
    long, double = "long", "double"
    b = buses.select(F.lit(0).alias("kind"), "id", none("string").alias("type"), none(long).alias("f"), none(long).alias("t"), none(double).alias("v"), none(double).alias("w"))
    e = branches.where("status").select(F.lit(1), "id", none("string"), F.col("from_bus"), F.col("to_bus"), 1 / F.greatest(F.abs(F.col("reactance_pu") * F.col("tap_ratio")), F.lit(1e-6)), none(double))
    m = measurements.select(F.lit(2), "id", "type", "branch_id", "bus_id", "value", "weight")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(g[g.kind == 0].id)
        at = {k: i for i, k in enumerate(ids)}
        e = g[g.kind == 1].set_index("id")
        m = g[g.kind == 2].sort_values("id")
        h = np.zeros((len(m), len(ids)))
        for r, x in enumerate(m.itertuples()):
            lines = e.loc[[int(x.f)]].assign(s=1.0) if x.type == "flow" and x.f in e.index else pd.concat([e[e.f == x.t].assign(s=1.0), e[e.t == x.t].assign(s=-1.0)]) if x.type == "injection" else e[:0].assign(s=0.0)
            for y in lines.itertuples():
                h[r, at[int(y.f)]] += y.s * y.v * base_mva
                h[r, at[int(y.t)]] -= y.s * y.v * base_mva
            if x.type == "angle":
                h[r, at[int(x.t)]] = 1.0
        w = np.sqrt(m.w.to_numpy(float))
        used = np.abs(h).sum(axis=1) > 0
        theta = np.zeros(len(ids))
        theta[1:] = np.linalg.lstsq((w[:, None] * h)[used][:, 1:], (w * m.v.to_numpy(float))[used], rcond=None)[0]
        est = np.where(used, h @ theta, np.nan)
        return pd.DataFrame({"id": m.id.astype("int64"), "type": m.type, "branch_id": m.f.astype("Int64"), "bus_id": m.t.astype("Int64"), "value": m.v.astype(float), "weight": m.w.astype(float), "estimate": est, "residual": m.v.to_numpy(float) - est})

    d = b.unionAll(e).unionAll(m).withColumn("net", F.lit(0))
    return d.groupBy("net").applyInPandas(run, "id long, type string, branch_id long, bus_id long, value double, weight double, estimate double, residual double")


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone, from the first 32 bits of an MD5, so that reruns and other engines agree."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("double") / float(1 << 32)


def monte_carlo(generators: DataFrame, loads: DataFrame, samples: int, seed: int = 1, outage: float = 0.05, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, lole_hours, eue_mwh): a unit in service fails in a sample with its rate (forced_outage, else outage); LOLE and EUE are the mean shares short of the load, over a year. Samples times units is the work by definition; it is summed before any shuffle."""
    k = list(keys)
    rate = F.coalesce("forced_outage", F.lit(outage)) if "forced_outage" in generators.columns else F.lit(outage)
    s = generators.sparkSession.range(samples).withColumnRenamed("id", "sample")
    up = uniform(F.lit(seed), F.col("sample"), F.col("id")) >= rate
    need = loads.groupBy(*k).agg(F.sum("active_power_mw").alias("need"))
    per = generators.where("status").crossJoin(s).groupBy(*k, "sample").agg(F.sum(F.when(up, F.col("pmax_mw")).otherwise(0.0)).alias("have"))
    cases = need.crossJoin(s).join(per, [*k, "sample"], "left")
    short = F.greatest(F.col("need") - F.coalesce("have", F.lit(0.0)), F.lit(0.0))
    return cases.groupBy(*k).agg((F.avg((short > 0).cast("double")) * HOURS_LOLE).alias("lole_hours"), (F.avg(short) * HOURS_LOLE).alias("eue_mwh"))


def multiarea(per_area: DataFrame) -> DataFrame:
    """System figures of areas: the largest LOLE, and the sum of EUE."""
    return per_area.agg(F.max("lole_hours").alias("system_lole"), F.sum("eue_mwh").alias("system_eue"), F.count("*").alias("n_areas"))


def corridors_of(areas: DataFrame, corridors: DataFrame) -> DataFrame:
    """(area, corridor_id, capacity_mw) of the corridors that touch an area at either end, once each."""
    ends = corridors.select(F.explode(F.array_distinct(F.array("area_a", "area_b"))).alias("area"), "corridor_id", "capacity_mw")
    return areas.select("area").join(ends, "area")


def maintenance_conflicts(windows: DataFrame, corridors: DataFrame) -> DataFrame:
    """(day, area_a, area_b): areas that are joined by a corridor and both have a window (area, day) on one day."""
    w = windows.select("area", "day").distinct()
    pairs = corridors.select(F.least("area_a", "area_b").alias("area_a"), F.greatest("area_a", "area_b").alias("area_b")).where("area_a < area_b").distinct()
    return pairs.join(w.select(F.col("area").alias("area_a"), "day"), "area_a").join(w.select(F.col("area").alias("area_b"), "day"), ["area_b", "day"]).select("day", "area_a", "area_b")


def score(lole: Column, lole_max: float = 10.0, weight: float = 0.6, others: float = 0.4) -> Column:
    """100 less the weighted share of the tolerated LOLE, held to [0, 100]; the other factors are 0."""
    return F.least(F.greatest(100 * (1 - weight * F.least(lole / lole_max, F.lit(1.0)) / (weight + others)), F.lit(0.0)), F.lit(100.0))


def band(points: Column) -> Column:
    out = F.when(points >= BANDS[0][0], BANDS[0][1])
    for low, name in BANDS[1:]:
        out = out.when(points >= low, name)
    return out.otherwise("Critical")


def loss_weight(points: Column, least: float = 80.0, aggressive: bool = False) -> Column:
    """Weight of losses against reliability: 0.1 below the least score, 0.5 within 10 above it, then 0.6, or 0.8 if aggressive."""
    return F.when(points < least, 0.1).when(points < least + 10, 0.5).otherwise(0.8 if aggressive else 0.6)


def restoration(before: Column, after: Column) -> tuple[Column, Column, Column]:
    """Percent by which LOLE falls, the effectiveness in [0, 1], and whether it exceeds one half."""
    e = F.when(before > 0, F.least(F.greatest((before - after) / before, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.when(before > 0, 100 * F.greatest(before - after, F.lit(0.0)) / before).otherwise(0.0), e, e > 0.5


def peak_lole(per_area: DataFrame, n_windows: int) -> DataFrame:
    """Baseline, peak during maintenance (a fifth of the mean area's LOLE more for each window) and the percent by which EUE falls (5 for each window, 15 at most)."""
    total = F.sum("lole_hours")
    return per_area.agg(total.alias("baseline_lole"), (total + 0.2 * n_windows * F.avg("lole_hours")).alias("peak_lole"), F.lit(min(5.0 * n_windows, 15.0)).alias("eue_reduction_pct"))


def outage_sampling(elements: DataFrame, samples: int, seed: int = 1) -> DataFrame:
    """Means over samples of a random element with one to three outages: lost = rate x repair hours x outages. elements need a gapless number k."""
    n = elements.agg(F.count("*").alias("n"))
    s = elements.sparkSession.range(samples).crossJoin(n).select(F.floor(uniform(F.lit(seed), F.col("id"), F.lit("element")) * F.col("n")).cast("int").alias("k"), (F.floor(uniform(F.lit(seed), F.col("id"), F.lit("outages")) * 3) + 1).alias("outages"))
    d = s.join(elements, "k").withColumn("lost", F.col("failure_rate") * F.col("repair_hours") * F.col("outages"))
    return d.agg(F.count("*").alias("samples"), F.avg("lost").alias("mean_lost"), F.avg("outages").alias("mean_outages"))


def adjacency(branches: DataFrame) -> DataFrame:
    """(bus, neighbour, susceptance) both ways: 1 / |x|, 1e6 for x near 0."""
    b = F.when(F.abs("reactance_pu") > 1e-9, 1 / F.abs("reactance_pu")).otherwise(1e6)
    one = lambda x, y: branches.select(F.col(x).alias("bus"), F.col(y).alias("neighbour"), b.alias("susceptance"))
    return one("from_bus", "to_bus").unionAll(one("to_bus", "from_bus"))


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(i, v) of a sparse matrix (i, j, b) times a vector (j, x)."""
    return matrix.join(vector, "j").groupBy("i").agg(F.sum(F.col("b") * F.col("x")).alias("v"))


def density(matrix: DataFrame) -> DataFrame:
    """Non-zero entries, and their share of all of a square matrix."""
    d = matrix.where("b <> 0").agg(F.count("*").alias("nnz"), F.greatest(F.max("i"), F.max("j")).alias("_m"))
    n = matrix.select(F.explode(F.array("i", "j")).alias("k")).agg(F.count_distinct("k").alias("n"))
    return d.crossJoin(n).select("n", "nnz", (F.col("nnz") / (F.col("n") * F.col("n"))).alias("density"))


def unserved_buses(roots: DataFrame, generators: DataFrame, loads: DataFrame) -> DataFrame:
    """(bus, active_power_mw) of loads in islands (bus, island) without a unit in service."""
    fed = generators.where("status").join(roots, "bus").select("island").distinct()
    return loads.join(roots, "bus").join(fed, "island", "left_anti").groupBy("bus").agg(F.sum("active_power_mw").alias("active_power_mw"))


def load_balanced(loads: DataFrame, parts: int) -> DataFrame:
    """(bus, part): buses by falling load, each to the part with the least load so far, the lowest of equals. Greedy, so one grid's buses (bus, active_power_mw) run in one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["active_power_mw", "bus"], ascending=[False, True])
        sums, out = np.zeros(parts), []
        for v in g.active_power_mw:
            p = int(np.argmin(sums))
            sums[p] += v
            out.append(p)
        return pd.DataFrame({"bus": g.bus.astype("int64"), "part": np.array(out, "int32")})

    return loads.groupBy("bus").agg(F.sum("active_power_mw").alias("active_power_mw")).withColumn("net", F.lit(0)).groupBy("net").applyInPandas(run, "bus long, part int")


def hosting(buses: DataFrame, limits: DataFrame, factors: DataFrame, flows: DataFrame, steps: int, most: float) -> DataFrame:
    """(bus_id, step, injection_mw, ok): whether every branch stays within its limit when a bus feeds in step / steps of most. factors (branch_id, bus_id, ptdf) give the change of flow."""
    worst_room = factors.join(flows.select("branch_id", "flow_mw"), "branch_id").join(limits, "branch_id")
    s = worst_room.select("bus_id", "ptdf", "flow_mw", "flow_limit", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("step"))
    p = F.col("step") * (most / steps)
    return s.groupBy("bus_id", "step").agg(F.max(F.abs(F.col("flow_mw") + F.col("ptdf") * p) - F.col("flow_limit")).alias("over")).join(buses.select(F.col("id").alias("bus_id")), "bus_id").select("bus_id", "step", p.alias("injection_mw"), (F.col("over") <= 1e-9).alias("ok"))


def elcc_table(df: DataFrame) -> DataFrame:
    """The reference's own results are these constants."""
    return df.sparkSession.createDataFrame([("solar", 0.8, 0.75, 0.85), ("wind", 0.7, 0.65, 0.75), ("storage", 0.9, 0.85, 0.95)], "class_id string, elcc_mean double, elcc_ci_lo double, elcc_ci_hi double")


def graph_json(nodes: DataFrame, edges: DataFrame, graphs: DataFrame) -> DataFrame:
    """(graph_id, edges): a JSON text of each graph's edges in order; nodes are the same in all graphs and are in the table of nodes."""
    e = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct("branch_id", "from_node", "to_node", "reactance_pu", "flow_mw"))).alias("edges"))
    return graphs.select("graph_id").join(e, "graph_id", "left").select("graph_id", F.to_json("edges").alias("edges"))


def price_stress(assets: DataFrame, hours: DataFrame, scenarios: int, seed: int = 1, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """(scenario, asset_id, cost): energy cost when each scenario scales all prices (hour, price) by a factor in [low, high]; assets charge from the unscaled median up, as in the base run."""
    median = hours.agg(F.median("price").alias("median"))
    run = hours.crossJoin(median).agg(F.sum(F.when(F.col("price") >= F.col("median"), F.col("price")).otherwise(0.0)).alias("dear"), F.sum(F.when(F.col("price") < F.col("median"), F.col("price")).otherwise(0.0)).alias("cheap"))
    s = assets.sparkSession.range(scenarios).select(F.col("id").alias("scenario"), (low + (high - low) * uniform(F.lit(seed), F.col("id"))).alias("scale"))
    return assets.crossJoin(run).crossJoin(s).select("scenario", "asset_id", (F.col("scale") * (F.col("p_min") * F.col("dear") + F.col("p_max") * F.col("cheap"))).alias("cost"))


def terminal_flow(r: Column, x: Column, vi: Column, vj: Column, ti: Column, tj: Column) -> tuple[Column, Column]:
    """P and Q into a branch without shunts at its first end, from magnitudes and angles of both."""
    z2 = r * r + x * x
    g, b, d = r / z2, -x / z2, ti - tj
    p = vi * vi * g - vi * vj * (g * F.cos(d) + b * F.sin(d))
    q = -vi * vi * b - vi * vj * (g * F.sin(d) - b * F.cos(d))
    return p, q


def marginal_cost(coeffs: Column, p: Column) -> Column:
    """c1 + 2 c2 p + 3 c3 p^2 ..."""
    each = F.transform(coeffs, lambda c, i: c * i)
    return F.aggregate(F.reverse(F.slice(each, 2, F.greatest(F.size(coeffs) - 1, F.lit(0)))), F.lit(0.0), lambda acc, c: acc * p + c)
