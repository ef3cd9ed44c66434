"""Dispatch by windows, and contingency tables from distribution factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def merit_order(generators: DataFrame, requirement: Column | float, keys: list[str] | None = None) -> DataFrame:
    """Every unit starts at pmin; headroom is filled by rising marginal cost, ties by id. Exact for linear costs without flow limits.

    dispatch_mw and short_mw, what the requirement lacks after all units (the same in each row).
    """
    keys = keys or []
    order = W.partitionBy(*(keys or [F.lit(0)])).orderBy("c1", "id")
    every = W.partitionBy(*(keys or [F.lit(0)]))
    room = F.greatest(F.col("pmax_mw") - F.col("pmin_mw"), F.lit(0.0))
    d = generators.where("status").withColumn("_room", room).withColumn("_base", F.sum("pmin_mw").over(every))
    before = F.coalesce(F.sum("_room").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    need = (requirement if isinstance(requirement, Column) else F.lit(float(requirement))) - F.col("_base")
    d = d.withColumn("dispatch_mw", F.col("pmin_mw") + F.least(F.greatest(need - before, F.lit(0.0)), F.col("_room")))
    return d.withColumn("short_mw", F.greatest(need - F.sum("_room").over(every), F.lit(0.0))).select(*keys, "id", "bus", "c1", "dispatch_mw", "short_mw")


def polynomial_cost(coeffs: Column, p: Column) -> Column:
    """c0 + c1 p + c2 p^2 + ..., by Horner's rule."""
    return F.aggregate(F.reverse(coeffs), F.lit(0.0), lambda acc, c: acc * p + c)


def piecewise_cost(xs: Column, ys: Column, p: Column) -> Column:
    """Linear interpolation, held at both ends."""
    pairs = F.arrays_zip(xs.alias("x0"), F.slice(xs, 2, F.size(xs)).alias("x1"), ys.alias("y0"), F.slice(ys, 2, F.size(ys)).alias("y1")).cast("array<struct<x0:double,x1:double,y0:double,y1:double>>")
    inside = F.filter(pairs, lambda s: (p >= s["x0"]) & (p < s["x1"]))
    s = F.get(inside, 0)
    return F.when(p <= F.get(xs, 0), F.get(ys, 0)).when(p >= F.element_at(xs, -1), F.element_at(ys, -1)).otherwise(s["y0"] + (p - s["x0"]) * (s["y1"] - s["y0"]) / (s["x1"] - s["x0"]))


def ramp_violations(runs: DataFrame, ramp: float, unit: str = "gen_id", time: str = "time", p: str = "p_mw", dt: float = 1.0) -> DataFrame:
    """Steps that change by more than ramp * dt (tolerance 1e-3)."""
    d = runs.withColumn("delta", F.col(p) - F.lag(p).over(W.partitionBy(unit).orderBy(time)))
    return d.where(F.abs("delta") > ramp * dt + 1e-3).select(unit, time, "delta", F.when(F.col("delta") > 0, "up").otherwise("down").alias("direction"))


def lodf(ptdf: DataFrame, branches: DataFrame) -> DataFrame:
    """(branch_l, branch_m, lodf) from factors (branch_id, bus_id, ptdf): -1 on the diagonal, infinite where an outage splits the grid."""
    ends = branches.where("status").select(F.col("id").alias("branch_m"), "from_bus", "to_bus")
    one = ptdf.join(ends, ptdf.bus_id == F.col("from_bus")).select("branch_id", "branch_m", F.col("ptdf").alias("v"))
    two = ptdf.join(ends, ptdf.bus_id == F.col("to_bus")).select("branch_id", "branch_m", (-F.col("ptdf")).alias("v"))
    h = one.unionAll(two).groupBy("branch_id", "branch_m").agg(F.sum("v").alias("h"))
    own = h.where("branch_id = branch_m").select("branch_m", (1 - F.col("h")).alias("left"))
    d = h.join(own, "branch_m")
    v = F.when(F.col("branch_id") == F.col("branch_m"), -1.0).when(F.abs("left") < 1e-10, float("inf")).otherwise(F.col("h") / F.col("left"))
    return d.select(F.col("branch_id").alias("branch_l"), "branch_m", v.alias("lodf"))


def screen(factors: DataFrame, flows: DataFrame, limits: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Per single outage: the highest loading, the branch that has it (lowest id of equals), and whether it is flagged."""
    f = flows.select("branch_id", "flow_mw")
    d = factors.where("branch_l <> branch_m").join(f.withColumnsRenamed({"branch_id": "branch_l", "flow_mw": "fl"}), "branch_l").join(f.withColumnsRenamed({"branch_id": "branch_m", "flow_mw": "fm"}), "branch_m").join(limits.withColumnRenamed("branch_id", "branch_l"), "branch_l")
    d = d.withColumn("loading", F.when(F.col("lodf") == float("inf"), float("inf")).otherwise(F.abs(F.col("fl") + F.col("lodf") * F.col("fm")) / F.col("flow_limit")))
    best = F.max(F.struct(F.col("loading"), (-F.col("branch_l")).alias("n")))
    d = d.groupBy("branch_m").agg(best.alias("b"), F.sum((F.col("loading") > 1).cast("long")).alias("violations"))
    return d.select(F.col("branch_m").alias("outage"), F.col("b.loading").alias("max_loading_fraction"), (-F.col("b.n")).alias("most_loaded_branch"), (F.col("b.loading") > threshold).alias("flagged"), "violations")


def pairs(branches: DataFrame) -> DataFrame:
    """Unordered pairs of in-service branches: the N-2 list, quadratic by definition."""
    a = branches.where("status").select(F.col("id").alias("a"))
    return a.join(a.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))


def outage_probability(outages: DataFrame, rates: DataFrame, default: float = 0.01) -> DataFrame:
    """(contingency, probability, n) from rows (contingency, branch_id): the product of forced-outage rates."""
    d = outages.join(rates, "branch_id", "left").withColumn("r", F.coalesce("rate", F.lit(default)))
    return d.groupBy("contingency").agg(F.exp(F.sum(F.log("r"))).alias("probability"), F.count("*").alias("n"))


def cumulative_eue(cases: DataFrame, key: str, eue: str = "eue") -> DataFrame:
    """Cases by falling EUE with rank, running total and share."""
    order = W.orderBy(F.desc(eue), key)
    total = F.sum(eue).over(W.partitionBy(F.lit(0)))
    return cases.select(key, eue, F.row_number().over(order).alias("rank"), F.sum(eue).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("cumulative"), total.alias("_t")).withColumn("share", F.when(F.col("_t") > 0, F.col("cumulative") / F.col("_t")).otherwise(0.0)).drop("_t")
