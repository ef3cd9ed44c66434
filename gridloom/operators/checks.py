"""Checks of grid tables, scenarios and datasets: a row for each finding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kilovolts outside of which a level is unusual, R/X above which a branch is, and MW above which a unit is.
VOLTAGE_KV, RX_RATIO, LARGE_MW = (0.1, 1500.0), 10.0, 10_000.0
#: Share of reserve beyond which a balance is doubtful.
MUCH_RESERVE = 5.0


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _broken(df: DataFrame, entity: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(severity, entity, entity_id, message) of the rules (severity, message, condition) that rows break, in one pass."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))) for s, m, c in rules]))
    return df.select("id", F.explode(hits).alias("h")).select("h.severity", F.lit(entity).alias("entity"), F.col("id").alias("entity_id"), "h.message")


def _totals(generators: DataFrame, loads: DataFrame) -> DataFrame:
    z = F.lit(0.0)
    g = generators.agg(F.coalesce(F.sum("pmax_mw"), z).alias("pmax"), F.coalesce(F.sum("pmin_mw"), z).alias("pmin"))
    return g.crossJoin(loads.agg(F.coalesce(F.sum("active_power_mw"), z).alias("load"))).withColumn("id", F.lit(None).cast("long"))


def physical(buses: DataFrame, branches: DataFrame, generators: DataFrame, loads: DataFrame) -> DataFrame:
    """Findings on levels, impedances, taps, ratings, limits and totals. A phase shifter may have a negative resistance, a condenser a negative minimum; the columns is_phase_shifter, is_condenser, qmin_mvar and qmax_mvar are optional."""
    has = lambda d, c, v: F.col(c) if c in d.columns else F.lit(v)
    kv, r, x, tap = F.col("voltage_kv"), F.col("resistance_pu"), F.col("reactance_pu"), F.col("tap_ratio")
    bus = [("error", "voltage not above 0", kv <= 0), ("warning", "unusual voltage", (kv > 0) & ((kv < VOLTAGE_KV[0]) | (kv > VOLTAGE_KV[1])))]
    branch = [
        ("error", "negative resistance", (r < 0) & ~has(branches, "is_phase_shifter", False)),
        ("error", "zero impedance", (r == 0) & (x == 0)),
        ("warning", "high R/X", (F.abs(x) > 1e-9) & (r > RX_RATIO * F.abs(x))),
        ("error", "negative tap", tap < 0),
        ("error", "zero tap", tap == 0),
        ("error", "negative rating", F.col("rate_a_mva") < 0),
    ]
    unit = [
        ("error", "pmax below pmin", F.col("pmax_mw") < F.col("pmin_mw")),
        ("error", "qmax below qmin", has(generators, "qmax_mvar", 0.0) < has(generators, "qmin_mvar", 0.0)),
        ("warning", "negative pmin", (F.col("pmin_mw") < 0) & ~has(generators, "is_condenser", False)),
        ("warning", "very large unit", F.col("pmax_mw") > LARGE_MW),
    ]
    total = [("warning", "capacity below load", (F.col("load") > 0) & (F.col("pmax") < F.col("load"))), ("warning", "minimum above load", (F.col("load") > 0) & (F.col("pmin") > F.col("load")))]
    return _union([_broken(buses, "bus", bus), _broken(branches, "branch", branch), _broken(generators, "generator", unit), _broken(_totals(generators, loads), "network", total)])


def balance(generators: DataFrame, loads: DataFrame) -> DataFrame:
    """Findings on limits, loads and reserve."""
    unit = [("error", "negative pmax", F.col("pmax_mw") < 0), ("error", "pmin above pmax", F.col("pmin_mw") > F.col("pmax_mw"))]
    total = [
        ("error", "capacity below load", F.col("pmax") < F.col("load")),
        ("warning", "minimum above load", (F.col("load") > 0) & (F.col("pmin") > F.col("load"))),
        ("warning", "reserve above 500 %", (F.col("load") > 0) & (F.col("pmax") - F.col("load") > MUCH_RESERVE * F.col("load"))),
        ("warning", "no load", F.col("load") == 0),
    ]
    return _union([_broken(generators, "generator", unit), _broken(loads, "load", [("warning", "negative load", F.col("active_power_mw") < 0)]), _broken(_totals(generators, loads), "network", total)])


def placement(branches: DataFrame, generators: DataFrame, loads: DataFrame, more_than: int = 2) -> DataFrame:
    """Findings on places: all units or all loads on one bus, anything at bus 0, and more than more_than branches from one bus to another."""

    def one_bus(d: DataFrame, entity: str) -> DataFrame:
        s = d.agg(F.count("*").alias("n"), F.min("bus").alias("lo"), F.max("bus").alias("hi")).where("n > 1 and lo = hi")
        return s.select(F.lit("warning").alias("severity"), F.lit(entity).alias("entity"), F.col("lo").alias("entity_id"), F.lit("all on one bus").alias("message"))

    at_zero = [_broken(d, n, [("warning", "at bus 0", F.col("bus") == 0)]) for d, n in ((generators, "generator"), (loads, "load"))]
    several = branches.groupBy("from_bus", "to_bus").agg(F.count("*").alias("n"), F.min("id").alias("id")).where(F.col("n") > more_than)
    several = several.select(F.lit("warning").alias("severity"), F.lit("branch").alias("entity"), F.col("id").alias("entity_id"), F.lit("many parallel branches").alias("message"))
    return _union([one_bus(generators, "generator"), one_bus(loads, "load"), *at_zero, several])


def topology(buses: DataFrame, branches: DataFrame, roots: DataFrame) -> DataFrame:
    """Findings on shape: self loops, buses without a branch, and more than one island, by roots (bus, island)."""
    loops = _broken(branches, "branch", [("error", "self loop", F.col("from_bus") == F.col("to_bus"))])
    ends = branches.select(F.explode(F.array("from_bus", "to_bus")).alias("id")).distinct()
    alone = _broken(buses.join(ends, "id", "left_anti"), "bus", [("warning", "no branch", F.lit(True))])
    split = roots.groupBy("island").agg(F.min("bus").alias("id")).where("island > 0")
    return _union([loops, alone, _broken(split, "island", [("warning", "not connected to the first island", F.lit(True))])])


def summary(buses: DataFrame, branches: DataFrame, generators: DataFrame, loads: DataFrame) -> DataFrame:
    """One row: counts, levels, capacity, load, reserve in percent of the load, and whether several units share one bus."""
    b = buses.agg(F.count("*").alias("n_buses"), F.min("voltage_kv").alias("min_kv"), F.max("voltage_kv").alias("max_kv"))
    e = branches.agg(F.count("*").alias("n_branches"), F.sum(F.col("status").cast("long")).alias("n_in_service"))
    g = generators.agg(F.count("*").alias("n_generators"), F.coalesce(F.sum("pmax_mw"), F.lit(0.0)).alias("capacity_mw"), ((F.count("*") > 1) & (F.min("bus") == F.max("bus"))).alias("all_units_on_one_bus"))
    d = loads.agg(F.count("*").alias("n_loads"), F.coalesce(F.sum("active_power_mw"), F.lit(0.0)).alias("load_mw"))
    return b.crossJoin(e).crossJoin(g).crossJoin(d).withColumn("reserve_pct", F.when(F.col("load_mw") > 0, 100 * (F.col("capacity_mw") - F.col("load_mw")) / F.col("load_mw")))


def bus_balance(buses: DataFrame, generators: DataFrame, loads: DataFrame) -> DataFrame:
    """Capacity in service, load and surplus by bus."""
    g = generators.where("status").groupBy(F.col("bus").alias("id")).agg(F.sum("pmax_mw").alias("g"))
    d = loads.groupBy(F.col("bus").alias("id")).agg(F.sum("active_power_mw").alias("d"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return buses.select("id").join(g, "id", "left").join(d, "id", "left").select(F.col("id").alias("bus"), z("g").alias("capacity_mw"), z("d").alias("load_mw"), (z("g") - z("d")).alias("surplus_mw"))


def against_spec(df: DataFrame, columns: list[tuple[str, str | None]]) -> DataFrame:
    """(column, problem) of the columns (name, type or none) that df lacks or has with another type; types agree if the part before the first underscore does, in any case."""
    have = {c.lower(): t for c, t in df.dtypes}
    loose = lambda t: t.lower().split("_")[0]
    rows = [(c, "missing" if c.lower() not in have else "type") for c, t in columns if c.lower() not in have or (t and loose(t) != loose(have[c.lower()]))]
    return df.sparkSession.createDataFrame(rows, "column string, problem string")


def column_roles(df: DataFrame, key: str = "scenario_id") -> DataFrame:
    """(column, role): booleans are controls; numbers are KPIs unless their name ends in _enabled or _dispatch, which are controls."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    rows = [(c, "control" if t == "boolean" or c.endswith(("_enabled", "_dispatch")) else "kpi") for c, t in df.dtypes if c != key and (t == "boolean" or t in numeric or t.startswith("decimal"))]
    return df.sparkSession.createDataFrame(rows, "column string, role string")


def scenario_findings(scenarios: DataFrame) -> DataFrame:
    """(scenario_id, problem): empty and repeated ids, and scenarios (scenario_id, time_slices) without a time slice."""
    empty = scenarios.where((F.trim(F.coalesce("scenario_id", F.lit(""))) == "")).select("scenario_id", F.lit("empty id").alias("problem"))
    twice = scenarios.groupBy("scenario_id").agg(F.count("*").alias("n")).where("n > 1").select("scenario_id", F.lit("repeated id").alias("problem"))
    bare = scenarios.where(F.coalesce(F.size("time_slices"), F.lit(0)) <= 0).select("scenario_id", F.lit("no time slice").alias("problem"))
    return _union([empty, twice, bare])
