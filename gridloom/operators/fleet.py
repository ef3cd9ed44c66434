"""DER, distribution, scenario, PMU, feature, geo and benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gridloom.operators.order import by_id, numbered


def envelope(assets: DataFrame, by_bus: bool = False) -> DataFrame:
    """Bounds of an aggregate: the least of minima, the greatest of maxima, and the number of assets."""
    key = F.col("bus").cast("string") if by_bus else F.coalesce("agg_id", F.col("asset_id").cast("string"))
    return assets.groupBy(key.alias("group_id")).agg(F.min("p_min").alias("p_min"), F.max("p_max").alias("p_max"), F.min("q_min").alias("q_min"), F.max("q_max").alias("q_max"), F.count("*").alias("n_assets"))


def schedule(assets: DataFrame, prices: DataFrame, soc0: float = 0.5, capacity: float = 4.0) -> DataFrame:
    """Per asset and hour: p_min (charge) at or above the median price, else p_max, clamped so that the state of charge stays in [0, capacity].

    A clamped recurrence is no window; it runs as an ordered fold over each asset's hours.
    """
    hours = prices.agg(F.sort_array(F.collect_list(F.struct("hour", "price"))).alias("hours"), F.median("price").alias("median"))
    d = assets.crossJoin(F.broadcast(hours))
    zero = F.struct(F.lit(soc0 * capacity).alias("soc"), F.array().cast("array<struct<hour:bigint,desired:double,actual:double,soc:double>>").alias("rows"))

    def step(acc: Column, h: Column) -> Column:
        desired = F.when(h["price"] >= F.col("median"), F.col("p_min")).otherwise(F.col("p_max"))
        actual = F.greatest(F.lit(0.0) - acc["soc"], F.least(desired, F.lit(capacity) - acc["soc"]))
        soc = acc["soc"] + actual
        row = F.struct(h["hour"].cast("bigint").alias("hour"), desired.cast("double").alias("desired"), actual.cast("double").alias("actual"), soc.cast("double").alias("soc"))
        return F.struct(soc.alias("soc"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    return d.select("asset_id", F.explode(F.aggregate("hours", zero, step)["rows"]).alias("r")).select("asset_id", "r.*")


def curtailment(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg((F.abs(F.col("actual") - F.col("desired")) > 1e-6).cast("double")).alias("curtailment_rate"))


def flisr(elements: DataFrame, runs: int) -> DataFrame:
    """Run i takes element i modulo n, in order of the id."""
    e = numbered(elements, by_id("element_id"), ["element_id"], "k")
    n = e.agg(F.count("*").alias("n"))
    r = elements.sparkSession.range(runs).withColumnRenamed("id", "run").crossJoin(F.broadcast(n)).withColumn("k", F.pmod("run", "n")).join(e, "k")
    saidi = F.greatest(F.col("failure_rate") * F.col("repair_hours"), F.lit(1.0))
    return r.select("run", "element_id", saidi.alias("saidi"), F.col("failure_rate").alias("saifi"), F.when(F.col("failure_rate") > 0, saidi / F.col("failure_rate")).otherwise(0.0).alias("caidi"))


def apply_scenarios(scenarios: DataFrame, loads: DataFrame) -> DataFrame:
    """Every scenario's loads, scaled; a null scale is 1."""
    return loads.crossJoin(scenarios.select("scenario_id", "load_scale")).select("scenario_id", "id", "bus", (F.col("active_power_mw") * F.coalesce("load_scale", F.lit(1.0))).alias("active_power_mw"))


def apply_outages(scenarios: DataFrame, branches: DataFrame, outages: DataFrame) -> DataFrame:
    """Every scenario's branches without those that it takes out: rows (scenario_id, branch_id)."""
    d = branches.crossJoin(scenarios.select("scenario_id"))
    return d.join(outages.withColumnRenamed("branch_id", "id"), ["scenario_id", "id"], "left_anti").select("scenario_id", "id", "from_bus", "to_bus")


def batch_jobs(scenarios: DataFrame, task: str) -> DataFrame:
    return scenarios.select(F.concat(F.lit(f"{task}:"), "scenario_id").alias("job_id"), "scenario_id")


def batch_stats(runs: DataFrame, value: str) -> DataFrame:
    """n, min, max, mean, median (the value at index n / 2) and p95 (the value at index ceil(0.95 n), at most the last), each by rank over counted values, so no list of all values is made."""
    counts = runs.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("c"))
    upto = counts.withColumn("end", F.sum("c").over(W.orderBy("v")))
    n = F.sum("c")
    totals = counts.agg(n.alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), (F.sum(F.col("v") * F.col("c")) / n).alias("mean"))
    at = upto.crossJoin(F.broadcast(totals))
    rank = lambda i: F.min(F.when(F.col("end") > i, F.col("v")))
    picked = at.agg(rank(F.floor(F.col("n") / 2)).alias("median"), rank(F.least(F.ceil(F.col("n") * F.lit(0.95)), F.col("n") - 1)).alias("p95"))
    return totals.crossJoin(picked)


def pmu_measurements(frames: DataFrame) -> DataFrame:
    """Voltage and angle rows of valid frames; weight falls with the total vector error."""
    w = F.greatest(1 / (1 + F.col("tve") * F.col("tve")), F.lit(0.1))
    rows = F.array(F.struct(F.lit("voltage").alias("type"), F.col("vm").alias("value")), F.struct(F.lit("angle").alias("type"), F.col("va").alias("value")))
    return frames.where("valid").select("timestamp", "bus_id", w.alias("weight"), F.explode(rows).alias("m")).select("timestamp", "bus_id", "m.type", "m.value", "weight")


def gnn_graphs(flows: DataFrame) -> DataFrame:
    """(graph_id, scenario_id, time): cases numbered from 0."""
    return numbered(flows.select("scenario_id", "time").distinct(), F.col("scenario_id"), ["time"], "graph_id")


def gnn_nodes(buses: DataFrame, generators: DataFrame, loads: DataFrame) -> DataFrame:
    """Static node features: node_id by bus order, with generator and load sums."""
    g = generators.groupBy("bus").agg(F.count("*").alias("num_gens"), F.sum("pmax_mw").alias("pmax_mw"))
    ld = loads.groupBy("bus").agg(F.count("*").alias("num_loads"), F.sum("active_power_mw").alias("load_mw"))
    d = buses.join(g, buses.id == g.bus, "left").drop("bus").join(ld, buses.id == ld.bus, "left").drop("bus")
    z = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return numbered(d, by_id("id"), ["id"], "node_id").select("node_id", F.col("id").alias("bus_id"), "voltage_kv", z("num_gens", 0), z("num_loads", 0), z("pmax_mw", 0.0), z("load_mw", 0.0))


def gnn_edges(flows: DataFrame, branches: DataFrame, graphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every graph's edges, with 0 where a case has no flow."""
    at = lambda side: nodes.select(F.col("bus_id").alias(f"{side}_bus"), F.col("node_id").alias(f"{side}_node"))
    e = branches.join(at("from"), "from_bus").join(at("to"), "to_bus").crossJoin(graphs)
    f = flows.select("scenario_id", "time", F.col("branch_id").alias("id"), "flow_mw")
    return e.join(f, ["scenario_id", "time", "id"], "left").select("graph_id", F.col("id").alias("branch_id"), "from_node", "to_node", "reactance_pu", F.coalesce("flow_mw", F.lit(0.0)).alias("flow_mw"))


def distance_km(a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> Column:
    h = F.pow(F.sin(F.radians(b_lat - a_lat) / 2), 2) + F.cos(F.radians(a_lat)) * F.cos(F.radians(b_lat)) * F.pow(F.sin(F.radians(b_lon - a_lon) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(h))


def knn(points: DataFrame, sites: DataFrame, k: int) -> DataFrame:
    """The k nearest sites of each point; sites are a short list, sent to every task."""
    d = points.crossJoin(F.broadcast(sites)).withColumn("distance_km", distance_km(F.col("lat"), F.col("lon"), F.col("site_lat"), F.col("site_lon")))
    return d.withColumn("k", F.row_number().over(W.partitionBy("id").orderBy("distance_km", "site_id"))).where(F.col("k") <= k).select(F.col("id").alias("bus_id"), "site_id", "distance_km", "k")


def point_in_polygon(points: DataFrame, polygons: DataFrame) -> DataFrame:
    """(bus_id, polygon_id) by ray casting over rows (polygon_id, ring: array of (x, y)); the lowest polygon id that holds the point, else null."""
    r = F.col("ring")
    edges = F.arrays_zip(r.alias("a"), F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)).alias("b"))
    x, y = F.col("lon"), F.col("lat")
    p = polygons.withColumn("edges", edges).withColumn("x0", F.array_min(F.transform(r, lambda v: v["x"]))).withColumn("x1", F.array_max(F.transform(r, lambda v: v["x"])))
    crossing = F.filter("edges", lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    hit = points.join(F.broadcast(p), (x >= F.col("x0")) & (x <= F.col("x1"))).where(F.size(crossing) % 2 == 1).groupBy("id").agg(F.min("polygon_id").alias("polygon_id"))
    return points.select("id").join(hit, "id", "left").select(F.col("id").alias("bus_id"), "polygon_id")


def lags_and_rolling(series: DataFrame, key: str, time: str, value: str, lags: tuple[int, ...] = (1, 2), window: int = 3) -> DataFrame:
    w = W.partitionBy(key).orderBy(time)
    back = w.rowsBetween(-(window - 1), 0)
    return series.select(key, time, value, *[F.lag(value, k).over(w).alias(f"lag_{k}") for k in lags], F.avg(value).over(back).alias("rolling_mean"), F.stddev_pop(value).over(back).alias("rolling_std"))


def seasonal(series: DataFrame, time: str) -> DataFrame:
    """hour_of_day, day_of_week (Monday is 0), month_of_year, is_weekend and is_peak_hour (7 to 22) of epoch seconds."""
    days, hour = F.floor(F.col(time) / 86400), F.floor(F.pmod(F.col(time), F.lit(86400)) / 3600).cast("int")
    day = F.pmod(days + 3, F.lit(7)).cast("int")
    month = F.month(F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))
    return series.select("*", hour.alias("hour_of_day"), day.alias("day_of_week"), month.alias("month_of_year"), (day >= 5).alias("is_weekend"), hour.between(7, 22).alias("is_peak_hour"))


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Pass rate, and over converged runs the mean and longest solve with its case."""
    ok = F.col("converged")
    return runs.agg(F.count("*").alias("n"), F.avg(ok.cast("double")).alias("pass_rate"), F.avg(F.when(ok, F.col("solve_ms"))).alias("avg_solve_ms"), F.max(F.when(ok, F.col("solve_ms"))).alias("max_solve_ms"), F.max(F.when(ok, F.struct("solve_ms", "case_name")))["case_name"].alias("slowest"))


def benchmark_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    b, a = before.alias("b"), after.alias("a")
    change = F.when(F.col("b.converged") & ~F.col("a.converged"), "newly failing").when(~F.col("b.converged") & F.col("a.converged"), "newly passing").otherwise("same")
    d = F.col("a.solve_ms") - F.col("b.solve_ms")
    return b.join(a, "case_name").select("case_name", change.alias("change"), d.alias("delta_ms"), F.when(F.col("b.solve_ms") > 0, 100 * d / F.col("b.solve_ms")).otherwise(0.0).alias("delta_pct"))
