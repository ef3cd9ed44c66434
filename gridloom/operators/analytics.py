"""Reliability, KPI, rent and deliverability tables from branch flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CASE = ["scenario_id", "time"]


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def reliability_cases(flows: DataFrame, limits: DataFrame, unserved_threshold: float = 0.1) -> DataFrame:
    """Per case: eue, violations (utilisation above 1), max_utilization, lole_flag and constrained."""
    require(flows, *CASE, "branch_id", "flow_mw")
    d = flows.join(limits.where("flow_limit > 0"), "branch_id", "left").withColumn("u", F.abs("flow_mw") / F.col("flow_limit"))
    unserved = F.coalesce(F.sum("unserved_energy_mw"), F.lit(0.0)) if "unserved_energy_mw" in flows.columns else F.lit(0.0)
    out = d.groupBy(*CASE).agg(unserved.alias("eue"), F.sum(F.coalesce((F.col("u") > 1).cast("long"), F.lit(0))).alias("violations"), F.coalesce(F.max("u"), F.lit(0.0)).alias("max_utilization"))
    return out.withColumn("lole_flag", F.col("eue") > unserved_threshold).withColumn("constrained", (F.col("violations") > 0) | (F.col("max_utilization") > 0.95))


def reliability_summary(cases: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Totals over cases; a scenario's weight is 1 where none is given."""
    d = cases.join(weights, "scenario_id", "left") if weights is not None else cases.withColumn("weight", F.lit(1.0))
    w = F.coalesce("weight", F.lit(1.0))
    return d.agg(F.countDistinct("scenario_id").alias("n_scenarios"), F.countDistinct("time").alias("n_times"), F.sum(F.col("lole_flag").cast("double") * w).alias("lole"), F.sum(F.col("eue") * w).alias("eue"), F.sum("violations").alias("violations"))


def kpi_stress(flows: DataFrame) -> DataFrame:
    """Per case: mean, max and sum of |flow|, and the number of branches (null counts as one)."""
    a = F.abs("flow_mw")
    n = F.countDistinct("branch_id") + F.max(F.col("branch_id").isNull().cast("long"))
    return flows.groupBy(*CASE).agg(F.avg(a).alias("mean_abs_flow"), F.max(a).alias("max_abs_flow"), F.sum(a).alias("total_abs_flow"), n.alias("n_branches"))


def with_reliability(kpi: DataFrame, cases: DataFrame) -> DataFrame:
    return kpi.join(cases, [c for c in CASE if c in cases.columns], "left")


def with_metadata(kpi: DataFrame, scenarios: DataFrame) -> DataFrame:
    return kpi.join(scenarios, "scenario_id", "left")


def rents(flows: DataFrame, branches: DataFrame, lmp: DataFrame) -> DataFrame:
    """Congestion rent of every flow: (lmp_to - lmp_from) * flow; a missing price is 0."""
    at = lambda side: lmp.select(F.col("bus_id").alias(f"{side}_bus"), F.col("lmp").alias(f"lmp_{side}"))
    d = flows.join(branches.select(F.col("id").alias("branch_id"), "from_bus", "to_bus"), "branch_id").join(at("from"), "from_bus", "left").join(at("to"), "to_bus", "left")
    return d.withColumn("rent", (F.coalesce("lmp_to", F.lit(0.0)) - F.coalesce("lmp_from", F.lit(0.0))) * F.col("flow_mw"))


def rent_totals(rent: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return rent.groupBy(*(keys or [])).agg(F.sum("rent").alias("congestion_rent"))


def injection_payments(injections: DataFrame, lmp: DataFrame) -> DataFrame:
    """gen_revenue over positive injections and load_payment over the others."""
    d = injections.join(lmp, F.col("bus") == F.col("bus_id"), "left").withColumn("pay", F.abs("injection_mw") * F.coalesce("lmp", F.lit(0.0)))
    up = F.col("injection_mw") > 0
    return d.agg(F.coalesce(F.sum(F.when(up, F.col("pay"))), F.lit(0.0)).alias("gen_revenue"), F.coalesce(F.sum(F.when(~up, F.col("pay"))), F.lit(0.0)).alias("load_payment"))


def kpi_contributions(runs: DataFrame, kpis: list[str], controls: list[str], baseline: str | None = None, key: str = "scenario_id") -> DataFrame:
    """Per KPI and control: mean with it on and off, delta of on against the baseline, share of the KPI's total |delta|, and rank.

    The baseline is the named scenario or else the first, by key, with no control on; else the first.
    """
    off = ~reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in map(F.col, controls)])
    pick = runs.withColumn("_first", F.when(F.col(key) == baseline, 0).otherwise(F.when(off, 1).otherwise(2))).orderBy("_first", key).limit(1)
    base = pick.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("base")) for k in kpis])).alias("b")).select("b.*")
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kpi"), F.col(k).cast("double").alias("value"), F.lit(c).alias("control"), F.col(c).alias("on")) for k in kpis for c in controls])).alias("r")).select("r.*")
    d = long.groupBy("kpi", "control").agg(F.avg(F.when(F.col("on"), F.col("value"))).alias("mean_on"), F.avg(F.when(~F.col("on"), F.col("value"))).alias("mean_off")).join(base, "kpi")
    d = d.withColumn("mean_on", F.coalesce("mean_on", "base")).withColumn("mean_off", F.coalesce("mean_off", "base")).withColumn("delta", F.col("mean_on") - F.col("base"))
    d = d.withColumn("abs_delta", F.abs("delta"))
    total = F.sum("abs_delta").over(W.partitionBy("kpi"))
    d = d.withColumn("pct", F.when(total > 0, 100 * F.col("abs_delta") / total).otherwise(0.0))
    return d.withColumn("rank", F.row_number().over(W.partitionBy("kpi").orderBy(F.desc("abs_delta"), "control"))).drop("base")


def deliverability(ptdf: DataFrame, limits: DataFrame, flows: DataFrame, pmax: DataFrame) -> DataFrame:
    """Per bus and case: the least headroom over |ptdf| by branch, over pmax, in [0, 1]; and its mean over cases."""
    f = flows.groupBy(*CASE, "branch_id").agg(F.max_by("flow_mw", F.abs("flow_mw")).alias("flow_mw"))
    d = ptdf.where("abs(ptdf) > 1e-9").join(f, "branch_id").join(limits, "branch_id", "left").withColumn("bound", (F.coalesce("flow_limit", F.lit(1e6)) - F.abs("flow_mw")) / F.abs("ptdf"))
    d = d.groupBy("bus_id", *CASE).agg(F.min(F.when(F.col("bound") > 0, F.col("bound"))).alias("bound")).join(pmax, "bus_id", "left")
    d = d.withColumn("ds", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("bound", F.lit(0.0)) / F.coalesce("pmax", F.lit(1.0)))))
    return d.withColumn("ds_mean", F.avg("ds").over(W.partitionBy("bus_id"))).select("bus_id", *CASE, "ds", "ds_mean")
