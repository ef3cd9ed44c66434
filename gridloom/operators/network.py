"""Network tables: statistics, inspection, validation, admittance matrices, islands and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.order import by_id, components, numbered


def stats(buses: DataFrame, branches: DataFrame, generators: DataFrame, loads: DataFrame) -> DataFrame:
    one = buses.agg(F.count("*").alias("n_buses"))
    one = one.crossJoin(branches.agg(F.count("*").alias("n_branches")))
    one = one.crossJoin(generators.agg(F.count("*").alias("n_generators"), F.coalesce(F.sum("pmax_mw"), F.lit(0.0)).alias("total_pmax"), F.coalesce(F.sum("pmin_mw"), F.lit(0.0)).alias("total_pmin")))
    return one.crossJoin(loads.agg(F.count("*").alias("n_loads"), F.coalesce(F.sum("active_power_mw"), F.lit(0.0)).alias("total_load_mw"), F.coalesce(F.sum("reactive_power_mvar"), F.lit(0.0)).alias("total_load_mvar")))


def reserve_margin(generators: DataFrame, loads: DataFrame) -> DataFrame:
    """Finite capacity in service over load, less 1; infinite without load."""
    cap = generators.where(F.col("status") & (F.abs("pmax_mw") < float("inf"))).agg(F.coalesce(F.sum("pmax_mw"), F.lit(0.0)).alias("capacity_mw"))
    d = cap.crossJoin(loads.agg(F.coalesce(F.sum("active_power_mw"), F.lit(0.0)).alias("load_mw")))
    return d.withColumn("reserve_margin", F.when(F.col("load_mw") == 0, float("inf")).otherwise((F.col("capacity_mw") - F.col("load_mw")) / F.col("load_mw")))


def inspect_generators(generators: DataFrame, bus: int | None = None) -> DataFrame:
    return (generators if bus is None else generators.where(F.col("bus") == bus)).select("bus", "id", "pmin_mw", "pmax_mw", "status").orderBy("bus", "id")


def inspect_branches(branches: DataFrame, max_rating: float | None = None) -> DataFrame:
    d = branches if max_rating is None else branches.where(F.col("rate_a_mva") <= max_rating)
    return d.select("from_bus", "to_bus", "id", "reactance_pu", "rate_a_mva", "status").orderBy("from_bus", "to_bus", "id")


def thermal_lowest(branches: DataFrame, n: int = 20) -> DataFrame:
    """The n lowest ratings; LOW if below half the mean."""
    mean = branches.agg(F.avg("rate_a_mva").alias("_mean"))
    d = branches.crossJoin(F.broadcast(mean)).withColumn("flag", F.when(F.col("rate_a_mva") < 0.5 * F.col("_mean"), "LOW").otherwise("OK"))
    return d.orderBy("rate_a_mva", "id").limit(n).select("id", "from_bus", "to_bus", "rate_a_mva", "flag")


def injections(generators: DataFrame, loads: DataFrame, output: str = "pmax_mw") -> DataFrame:
    """Generation less load by bus, whatever the status."""
    both = generators.select("bus", F.col(output).alias("p")).unionAll(loads.select("bus", (-F.col("active_power_mw")).alias("p")))
    return both.groupBy("bus").agg(F.sum("p").alias("injection_mw"))


def susceptance(x: Column, tap: Column) -> Column:
    return 1 / F.greatest(F.abs(x * tap), F.lit(1e-6))


def b_prime(branches: DataFrame) -> DataFrame:
    """(i, j, b) of the in-service branches' susceptance matrix, entries summed."""
    b = susceptance(F.col("reactance_pu"), F.col("tap_ratio"))
    e = lambda i, j, v: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), v.alias("b"))
    d = branches.where("status").select(F.explode(F.array(e("from_bus", "from_bus", b), e("to_bus", "to_bus", b), e("from_bus", "to_bus", -b), e("to_bus", "from_bus", -b))).alias("e"))
    return d.select("e.*").groupBy("i", "j").agg(F.sum("b").alias("b"))


def y_bus(branches: DataFrame) -> DataFrame:
    """(i, j, g, b) of the admittance matrix: pi models with tap and phase shift."""
    r, x, t, s = F.col("resistance_pu"), F.col("reactance_pu"), F.col("tap_ratio"), F.col("phase_shift_rad")
    z2 = r * r + x * x
    g, b, c = r / z2, -x / z2, F.col("charging_b_pu") / 2
    e = lambda i, j, re, im: F.struct(F.col(i).alias("i"), F.col(j).alias("j"), re.alias("g"), im.alias("b"))
    entries = F.array(
        e("from_bus", "from_bus", g / (t * t), (b + c) / (t * t)),
        e("to_bus", "to_bus", g, b + c),
        e("from_bus", "to_bus", -(g * F.cos(s) - b * F.sin(s)) / t, -(b * F.cos(s) + g * F.sin(s)) / t),
        e("to_bus", "from_bus", -(g * F.cos(s) + b * F.sin(s)) / t, -(b * F.cos(s) - g * F.sin(s)) / t),
    )
    return branches.where("status").select(F.explode(entries).alias("e")).select("e.*").groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))


def degree_stats(buses: DataFrame, branches: DataFrame) -> DataFrame:
    ends = branches.select(F.explode(F.array("from_bus", "to_bus")).alias("id")).groupBy("id").count()
    d = buses.select("id").join(ends, "id", "left").withColumn("degree", F.coalesce("count", F.lit(0)))
    n, e = F.count("*"), F.sum("degree") / 2
    return d.agg(n.alias("n_nodes"), e.cast("long").alias("n_edges"), F.min("degree").alias("min_degree"), F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"), F.when(n > 1, 2 * e / (n * (n - 1))).otherwise(0.0).alias("density"))


def islands(buses: DataFrame, branches: DataFrame, in_service_only: bool = False) -> DataFrame:
    """(bus, island): components by the smallest bus reachable, numbered from 0."""
    e = (branches.where("status") if in_service_only else branches).select(F.col("from_bus").alias("a"), F.col("to_bus").alias("b"))
    label = components(buses.select(F.col("id").alias("node")), e)
    roots = numbered(label.select(F.col("root").alias("_root")).distinct(), by_id("_root"), ["_root"], "island")
    return label.join(roots, label.root == F.col("_root")).select(F.col("node").alias("bus"), "island")


def areas(buses: DataFrame) -> DataFrame:
    """(bus, part): zone, else area, numbered from 0."""
    keyed = buses.select(F.col("id").alias("bus"), F.coalesce("zone_id", "area_id", F.lit(0)).alias("_key"))
    parts = numbered(keyed.select(F.col("_key").alias("_zone")).distinct(), by_id("_zone"), ["_zone"], "part")
    return keyed.join(parts, F.col("_key") == F.col("_zone")).select("bus", "part")


def tie_lines(branches: DataFrame, parts: DataFrame) -> DataFrame:
    at = lambda side: parts.select(F.col("bus").alias(f"{side}_bus"), F.col("part").alias(f"{side}_part"))
    return branches.join(at("from"), "from_bus").join(at("to"), "to_bus").where("from_part <> to_part").select("id", "from_bus", "to_bus", "from_part", "to_part")


def dangling(buses: DataFrame, branches: DataFrame, generators: DataFrame, loads: DataFrame) -> DataFrame:
    """(entity, entity_id, bus) of references to buses that don't exist."""
    refs = [branches.select(F.lit(f"branch.{c}").alias("entity"), "id", F.col(c).alias("bus")) for c in ("from_bus", "to_bus")] + [d.select(F.lit(n).alias("entity"), "id", "bus") for n, d in (("generator", generators), ("load", loads))]
    all_ = refs[0]
    for r in refs[1:]:
        all_ = all_.unionAll(r)
    return all_.join(buses.select(F.col("id").alias("bus")), "bus", "left_anti").select("entity", F.col("id").alias("entity_id"), "bus")


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def parallel_branches(branches: DataFrame, more_than: int = 2) -> DataFrame:
    return branches.groupBy(F.least("from_bus", "to_bus").alias("a"), F.greatest("from_bus", "to_bus").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > more_than)
