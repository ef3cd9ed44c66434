"""Optimal dispatch by windows (linear and piecewise costs), ramps, and what a dispatch does to flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Tolerance of segment ends, and the price of a unit without one.
TOLERANCE, DEFAULT_COST = 1e-6, 1.0


def segment_findings(limits: DataFrame, segments: DataFrame) -> DataFrame:
    """(bus_id, problem) of cost segments (bus_id, start, end, slope) that don't cover pmin to pmax of limits (bus_id, pmin, pmax, demand) without gap or overlap."""
    w = W.partitionBy("bus_id").orderBy("start")
    s = segments.withColumn("_prev", F.lag("end").over(w)).withColumn("_first", F.min("start").over(W.partitionBy("bus_id"))).withColumn("_last", F.max("end").over(W.partitionBy("bus_id")))
    d = s.join(limits.select("bus_id", "pmin", "pmax"), "bus_id")
    t = F.lit(TOLERANCE)
    problem = F.array_compact(F.array(F.when(F.col("end") <= F.col("start"), "empty segment"), F.when(F.col("start") < F.col("_prev") - t, "overlap"), F.when(F.col("start") > F.col("_prev") + t, "gap"), F.when(F.col("_first") > F.col("pmin") + t, "starts above pmin"), F.when(F.col("_last") < F.col("pmax") - t, "ends below pmax")))
    return d.select("bus_id", F.explode(problem).alias("problem")).distinct()


def dispatch(limits: DataFrame, costs: DataFrame, segments: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, bus_id, dispatch_mw, injection_mw, price, short_mw): the cheapest dispatch that meets the sum of demands, which is the optimum of the linear program without flow limits.

    A unit with segments offers them by rising slope, others their whole range at their cost. What lies below pmin must run; the rest is taken by price, ties by bus. price is that of the dearest part taken; short_mw what is left of the demand (above 0) or too much must run (below 0), in each row.
    """
    k = list(keys)
    seg = segments.select(*k, "bus_id", F.greatest(F.col("end") - F.col("start"), F.lit(0.0)).alias("width"), F.col("slope").alias("c"), F.col("start").alias("s")) if segments is not None else None
    plain = limits.join(costs.select("bus_id", F.col("marginal_cost").alias("c")), "bus_id", "left")
    if seg is not None:
        plain = plain.join(seg.select(*k, "bus_id").distinct(), [*k, "bus_id"], "left_anti")
    offers = plain.select(*k, "bus_id", F.col("pmax").alias("width"), F.coalesce("c", F.lit(DEFAULT_COST)).alias("c"), F.lit(0.0).alias("s"))
    if seg is not None:
        offers = offers.unionByName(seg)
    d = offers.join(limits, [*k, "bus_id"])
    own = W.partitionBy(*k, "bus_id").orderBy("c", "s").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("lo", F.coalesce(F.sum("width").over(own), F.lit(0.0))).withColumn("hi", F.col("lo") + F.col("width"))
    inside = lambda a, b: F.greatest(F.least(F.col("hi"), b) - F.greatest(F.col("lo"), a), F.lit(0.0))
    d = d.withColumn("must", inside(F.lit(0.0), F.col("pmin"))).withColumn("room", inside(F.col("pmin"), F.col("pmax")))
    need = limits.groupBy(*k).agg(F.sum("demand").alias("need")).join(d.groupBy(*k).agg(F.sum("must").alias("all_must"), F.sum("room").alias("all_room")), k) if k else limits.agg(F.sum("demand").alias("need")).crossJoin(d.agg(F.sum("must").alias("all_must"), F.sum("room").alias("all_room")))
    # Prices are added up first, so that the parts of one price are the only rows that are ordered together.
    per = d.groupBy(*k, "c").agg(F.sum("room").alias("at_price"))
    below = per.select(*k, "c", F.coalesce(F.sum("at_price").over(W.partitionBy(*k).orderBy("c").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("below"))
    same = W.partitionBy(*k, "c").orderBy("bus_id", "s").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_same", F.coalesce(F.sum("room").over(same), F.lit(0.0))).join(below, [*k, "c"])
    d = d.join(need, k) if k else d.crossJoin(need)
    left = F.col("need") - F.col("all_must") - F.col("below") - F.col("_same")
    d = d.withColumn("taken", F.least(F.greatest(left, F.lit(0.0)), F.col("room")))
    short = F.when(F.col("need") < F.col("all_must"), F.col("need") - F.col("all_must")).otherwise(F.greatest(F.col("need") - F.col("all_must") - F.col("all_room"), F.lit(0.0)))
    unit = d.groupBy(*k, "bus_id").agg(F.sum(F.col("must") + F.col("taken")).alias("dispatch_mw"), F.max(F.when(F.col("taken") > 0, F.col("c"))).alias("_price"), F.first("demand").alias("demand"), F.first(short).alias("short_mw"))
    price = unit.groupBy(*k).agg(F.max("_price").alias("price")) if k else unit.agg(F.max("_price").alias("price"))
    unit = unit.join(price, k) if k else unit.crossJoin(price)
    return unit.select(*k, "bus_id", "dispatch_mw", (F.col("dispatch_mw") - F.col("demand")).alias("injection_mw"), "price", "short_mw")


def limit_violations(flows: DataFrame, limits: DataFrame) -> DataFrame:
    """Flows (branch_id, flow_mw) above their branch's limit, the largest excess first in excess_mw."""
    return flows.join(limits, "branch_id").where(F.abs("flow_mw") > F.col("flow_limit")).withColumn("excess_mw", F.abs("flow_mw") - F.col("flow_limit"))


def effective_bounds(units: DataFrame, dt: float = 1.0) -> DataFrame:
    """pmin and pmax cut by what ramp_down and ramp_up allow from p_prev within dt hours."""
    return units.select("id", F.greatest(F.col("p_prev") - F.col("ramp_down") * dt, F.col("pmin_mw")).alias("p_min_effective"), F.least(F.col("p_prev") + F.col("ramp_up") * dt, F.col("pmax_mw")).alias("p_max_effective"))


def trajectory(runs: DataFrame, unit: int, key: str = "gen_id") -> DataFrame:
    """One unit's output by time."""
    return runs.where(F.col(key) == unit).select("time", "p_mw").orderBy("time")


def transfer(ptdf: DataFrame, source: int, sink: int, mw: float) -> DataFrame:
    """(branch_id, flow_mw, ptdf) of moving mw from source to sink; without a transfer the factor is 0."""
    one = ptdf.groupBy("branch_id").agg(F.sum(F.when(F.col("bus_id") == source, F.col("ptdf")).when(F.col("bus_id") == sink, -F.col("ptdf")).otherwise(0.0) if source != sink else F.lit(0.0)).alias("factor"))
    return one.select("branch_id", (F.col("factor") * mw).alias("flow_mw"), F.col("factor").alias("ptdf") if mw else F.lit(0.0).alias("ptdf"))
