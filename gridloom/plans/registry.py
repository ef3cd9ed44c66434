"""Every query by name, with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import analytics, dispatch, fleet, kernels, network, timeseries
from gridloom.plans import studies  # noqa: F401  registers its queries
from gridloom.plans.adapter import Grid
from gridloom.plans.catalog import ORACLES, QUERIES, Query, query

RESAMPLE = "SELECT timestamp - ((timestamp % {p} + {p}) % {p}) AS bucket_start, count(*) AS count, round(avg(value), 6) AS mean_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value FROM {t} WHERE timestamp IS NOT NULL AND value IS NOT NULL GROUP BY 1"


@query(RESAMPLE.format(p=3600, t="series"), ("series",))
def ts_resample(g: Grid) -> DataFrame:
    return timeseries.resample(g.series, "1h")


@query(RESAMPLE.format(p=300, t="(SELECT timestamp - 1704067200 AS timestamp, value FROM series) s"), ("series",))
def ts_resample_negative_ts(g: Grid) -> DataFrame:
    return timeseries.resample(g.series.withColumn("timestamp", F.col("timestamp") - 1704067200), "5m")


@query("SELECT coalesce(a.sensor, b.sensor) AS sensor, round(a.value_sum, 6) AS value_sum, round(b.value_sum, 6) AS value_sum_right FROM (SELECT sensor, sum(value) AS value_sum FROM series GROUP BY 1) a FULL JOIN (SELECT concat(upper(substr(sensor, 1, 1)), substr(sensor, 2)) AS sensor, sum(value) AS value_sum FROM series WHERE sensor <> 'click' GROUP BY 1 UNION ALL SELECT sensor, sum(user_id)::DOUBLE FROM series WHERE sensor = 'click' GROUP BY 1) b ON a.sensor = b.sensor", ("series",))
def ts_join_outer(g: Grid) -> DataFrame:
    s = g.series
    other = s.select(F.when(F.col("sensor") == "click", F.col("sensor")).otherwise(F.concat(F.upper(F.substring("sensor", 1, 1)), F.expr("substr(sensor, 2)"))).alias("sensor"), F.when(F.col("sensor") == "click", F.col("user_id").cast("double")).otherwise(F.col("value")).alias("value"))
    return timeseries.outer_join(timeseries.aggregate(s), timeseries.aggregate(other), "sensor")


def _aggregate(agg: str, sql: str) -> None:
    def f(g: Grid) -> DataFrame:
        return timeseries.aggregate(g.series, agg=agg)

    f.__name__ = f"ts_agg_{agg}"
    query(f"SELECT sensor, {sql} AS value_{agg} FROM series GROUP BY sensor", ("series",))(f)


for _a, _s in (("sum", "round(sum(value), 6)"), ("mean", "round(avg(value), 6)"), ("min", "round(min(value), 6)"), ("max", "round(max(value), 6)"), ("count", "count(*)")):
    _aggregate(_a, _s)

CASES = "SELECT f.scenario_id, f.time, coalesce(sum(unserved_energy_mw), 0) AS eue, sum(CASE WHEN abs(flow_mw) / flow_limit > 1 THEN 1 ELSE 0 END)::BIGINT AS violations, coalesce(max(abs(flow_mw) / flow_limit), 0) AS max_utilization FROM flows f LEFT JOIN limits l ON f.branch_id = l.branch_id AND flow_limit > 0 GROUP BY 1, 2"
CASES_ROUNDED = f"SELECT scenario_id, time, round(eue, 6) AS eue, violations, round(max_utilization, 6) AS max_utilization, eue > 0.1::DOUBLE AS lole_flag, violations > 0 OR max_utilization > 0.95::DOUBLE AS constrained FROM ({CASES}) c"
STRESS = "SELECT scenario_id, time, round(avg(abs(flow_mw)), 6) AS mean_abs_flow, max(abs(flow_mw)) AS max_abs_flow, sum(abs(flow_mw)) AS total_abs_flow, count(DISTINCT branch_id) AS n_branches FROM flows GROUP BY 1, 2"


@query(CASES_ROUNDED, ("flows", "limits"))
def reliability_case(g: Grid) -> DataFrame:
    return analytics.reliability_cases(g.flows, g.limits)


@query(f"SELECT count(DISTINCT scenario_id) AS n_scenarios, count(DISTINCT time) AS n_times, round(sum(CASE WHEN lole_flag THEN 1.0::DOUBLE ELSE 0 END), 6) AS lole, round(sum(eue), 6) AS eue, sum(violations)::BIGINT AS violations FROM (SELECT *, eue > 0.1::DOUBLE AS lole_flag FROM ({CASES}) c) d", ("flows", "limits"))
def reliability_summary(g: Grid) -> DataFrame:
    return analytics.reliability_summary(analytics.reliability_cases(g.flows, g.limits))


@query(STRESS, ("flows",))
def kpi_stress(g: Grid) -> DataFrame:
    return analytics.kpi_stress(g.flows)


@query(f"SELECT * FROM ({STRESS}) s LEFT JOIN ({CASES_ROUNDED}) c USING (scenario_id, time)", ("flows", "limits"))
def kpi_with_reliability(g: Grid) -> DataFrame:
    return analytics.with_reliability(analytics.kpi_stress(g.flows), analytics.reliability_cases(g.flows, g.limits))


@query(f"SELECT s.*, storm, storage, round(cost, 6) AS cost, load_scale FROM ({STRESS}) s LEFT JOIN scenarios m ON s.scenario_id = m.scenario_id", ("flows", "scenarios"))
def kpi_with_metadata(g: Grid) -> DataFrame:
    return analytics.with_metadata(analytics.kpi_stress(g.flows), g.scenarios)


RENT = "SELECT f.*, (coalesce(t.lmp, 0) - coalesce(s.lmp, 0)) * flow_mw AS rent FROM flows f JOIN branches b ON b.id = f.branch_id LEFT JOIN lmp s ON s.bus_id = b.from_bus LEFT JOIN lmp t ON t.bus_id = b.to_bus"


@query(f"SELECT branch_id, round(sum(rent), 6) AS congestion_rent FROM ({RENT}) r GROUP BY 1", ("flows", "branches", "lmp"))
def alloc_rents_branch(g: Grid) -> DataFrame:
    return analytics.rent_totals(analytics.rents(g.flows, g.branches, g.lmp), ["branch_id"])


@query(f"SELECT scenario_id, time, round(sum(rent), 6) AS congestion_rent FROM ({RENT}) r GROUP BY 1, 2", ("flows", "branches", "lmp"))
def alloc_rents_total(g: Grid) -> DataFrame:
    return analytics.rent_totals(analytics.rents(g.flows, g.branches, g.lmp), ["scenario_id", "time"])


INJECTIONS = "SELECT bus, sum(p) AS injection_mw FROM (SELECT bus, pmax_mw AS p FROM generators UNION ALL SELECT bus, -active_power_mw FROM loads) u GROUP BY bus"


@query(f"SELECT round(coalesce(sum(CASE WHEN injection_mw > 0 THEN injection_mw * coalesce(lmp, 0) END), 0), 6) AS gen_revenue, round(coalesce(sum(CASE WHEN NOT injection_mw > 0 THEN abs(injection_mw) * coalesce(lmp, 0) END), 0), 6) AS load_payment FROM ({INJECTIONS}) i LEFT JOIN lmp ON bus = bus_id", ("generators", "loads", "lmp"))
def alloc_rents_injection(g: Grid) -> DataFrame:
    return analytics.injection_payments(network.injections(g.generators, g.loads), g.lmp)


CONTRIBUTION = """
WITH long AS (
  SELECT scenario_id, 'cost' AS kpi, cost AS value, 'storm' AS control, storm AS is_on FROM scenarios UNION ALL SELECT scenario_id, 'cost', cost, 'storage', storage FROM scenarios
  UNION ALL SELECT scenario_id, 'load_scale', load_scale, 'storm', storm FROM scenarios UNION ALL SELECT scenario_id, 'load_scale', load_scale, 'storage', storage FROM scenarios
), pick AS (
  SELECT * FROM scenarios ORDER BY CASE WHEN NOT (storm OR storage) THEN 1 ELSE 2 END, scenario_id LIMIT 1
), base AS (
  SELECT 'cost' AS kpi, cost AS base FROM pick UNION ALL SELECT 'load_scale', load_scale FROM pick
), m AS (
  SELECT kpi, control, coalesce(avg(CASE WHEN is_on THEN value END), max(base)) AS mean_on, coalesce(avg(CASE WHEN NOT is_on THEN value END), max(base)) AS mean_off, max(base) AS base FROM long JOIN base USING (kpi) GROUP BY 1, 2
), d AS (
  SELECT *, mean_on - base AS delta, sum(abs(mean_on - base)) OVER (PARTITION BY kpi) AS total FROM m
)
SELECT kpi, control, round(mean_on, 6) AS mean_on, round(mean_off, 6) AS mean_off, round(delta, 6) AS delta, round(abs(delta), 6) AS abs_delta,
  round(CASE WHEN total > 0 THEN 100 * abs(delta) / total ELSE 0 END, 6) AS pct, row_number() OVER (PARTITION BY kpi ORDER BY abs(delta) DESC, control)::INTEGER AS rank FROM d
"""


@query(CONTRIBUTION, ("scenarios",))
def alloc_kpi_contribution(g: Grid) -> DataFrame:
    return analytics.kpi_contributions(g.scenarios, ["cost", "load_scale"], ["storm", "storage"])


@query("SELECT n_buses, n_branches, n_generators, round(total_pmax, 6) AS total_pmax, round(total_pmin, 6) AS total_pmin, n_loads, round(l, 6) AS total_load_mw, round(q, 6) AS total_load_mvar FROM (SELECT count(*) AS n_buses FROM buses) a, (SELECT count(*) AS n_branches FROM branches) b, (SELECT count(*) AS n_generators, sum(pmax_mw) AS total_pmax, sum(pmin_mw) AS total_pmin FROM generators) c, (SELECT count(*) AS n_loads, sum(active_power_mw) AS l, sum(reactive_power_mvar) AS q FROM loads) d", ("buses", "branches", "generators", "loads"))
def net_stats(g: Grid) -> DataFrame:
    return network.stats(g.buses, g.branches, g.generators, g.loads)


@query("SELECT round(c, 6) AS capacity_mw, round(l, 6) AS load_mw, round((c - l) / l, 6) AS reserve_margin FROM (SELECT sum(pmax_mw) AS c FROM generators WHERE status) a, (SELECT sum(active_power_mw) AS l FROM loads) b", ("generators", "loads"))
def net_reserve_margin(g: Grid) -> DataFrame:
    return network.reserve_margin(g.generators, g.loads)


@query("SELECT bus, id, pmin_mw, round(pmax_mw, 6) AS pmax_mw, status FROM generators WHERE bus = 3", ("generators",))
def inspect_generators(g: Grid) -> DataFrame:
    return network.inspect_generators(g.generators, 3)


@query("SELECT from_bus, to_bus, id, round(reactance_pu, 6) AS reactance_pu, rate_a_mva, status FROM branches WHERE rate_a_mva <= 150", ("branches",))
def inspect_branches(g: Grid) -> DataFrame:
    return network.inspect_branches(g.branches, 150.0)


@query("SELECT id, from_bus, to_bus, rate_a_mva, CASE WHEN rate_a_mva < 0.5::DOUBLE * (SELECT avg(rate_a_mva) FROM branches) THEN 'LOW' ELSE 'OK' END AS flag FROM branches ORDER BY rate_a_mva, id LIMIT 20", ("branches",))
def inspect_thermal_lowest(g: Grid) -> DataFrame:
    return network.thermal_lowest(g.branches)


@query(f"SELECT bus, round(injection_mw, 6) AS injection_mw FROM ({INJECTIONS}) i", ("generators", "loads"))
def bus_injections(g: Grid) -> DataFrame:
    return network.injections(g.generators, g.loads)


BPRIME = "SELECT i, j, round(sum(v), 6) AS b FROM (SELECT from_bus AS i, from_bus AS j, y AS v FROM e UNION ALL SELECT to_bus, to_bus, y FROM e UNION ALL SELECT from_bus, to_bus, -y FROM e UNION ALL SELECT to_bus, from_bus, -y FROM e) u GROUP BY 1, 2"


@query(f"WITH e AS (SELECT *, 1 / greatest(abs(reactance_pu * tap_ratio), 0.000001::DOUBLE) AS y FROM branches WHERE status) {BPRIME}", ("branches",))
def bprime_coo(g: Grid) -> DataFrame:
    return network.b_prime(g.branches)


YBUS = """
WITH e AS (SELECT from_bus AS f, to_bus AS t, resistance_pu / (resistance_pu ** 2 + reactance_pu ** 2) AS g, -reactance_pu / (resistance_pu ** 2 + reactance_pu ** 2) AS b, charging_b_pu / 2 AS c FROM branches WHERE status)
SELECT i, j, round(sum(g), 6) AS g, round(sum(b), 6) AS b FROM (
  SELECT f AS i, f AS j, g, b + c AS b FROM e UNION ALL SELECT t, t, g, b + c FROM e UNION ALL SELECT f, t, -g, -b FROM e UNION ALL SELECT t, f, -g, -b FROM e) u GROUP BY 1, 2
"""


@query(YBUS, ("branches",))
def ybus_coo(g: Grid) -> DataFrame:
    return network.y_bus(g.branches)


@query("SELECT count(*) AS n_nodes, (sum(d) / 2)::BIGINT AS n_edges, min(d)::BIGINT AS min_degree, round(avg(d), 6) AS avg_degree, max(d)::BIGINT AS max_degree, round(sum(d)::DOUBLE / (count(*) * (count(*) - 1)), 6) AS density FROM (SELECT b.id, count(e.id) AS d FROM buses b LEFT JOIN (SELECT from_bus AS id FROM branches UNION ALL SELECT to_bus FROM branches) e ON b.id = e.id GROUP BY b.id) x", ("buses", "branches"))
def graph_degree_stats(g: Grid) -> DataFrame:
    return network.degree_stats(g.buses, g.branches)


ISLANDS = "WITH RECURSIVE e AS (SELECT from_bus AS a, to_bus AS b FROM branches WHERE {w} UNION SELECT to_bus, from_bus FROM branches WHERE {w}), reach AS (SELECT id AS bus, id AS o FROM buses UNION SELECT r.bus, e.b FROM reach r JOIN e ON e.a = r.o), low AS (SELECT bus, min(o) AS m FROM reach GROUP BY bus) SELECT bus, (dense_rank() OVER (ORDER BY m) - 1)::INTEGER AS island FROM low"


@query(ISLANDS.format(w="true"), ("buses", "branches"))
def graph_islands(g: Grid) -> DataFrame:
    return network.islands(g.buses, g.branches)


@query(ISLANDS.format(w="status"), ("buses", "branches"))
def graph_islands_status_aware(g: Grid) -> DataFrame:
    return network.islands(g.buses, g.branches, in_service_only=True)


AREAS = "SELECT id AS bus, (dense_rank() OVER (ORDER BY coalesce(zone_id, area_id, 0)) - 1)::INTEGER AS part FROM buses"


@query(AREAS, ("buses",))
def partition_areas(g: Grid) -> DataFrame:
    return network.areas(g.buses)


@query(f"SELECT b.id, from_bus, to_bus, p.part AS from_part, q.part AS to_part FROM branches b JOIN ({AREAS}) p ON p.bus = from_bus JOIN ({AREAS}) q ON q.bus = to_bus WHERE p.part <> q.part", ("branches", "buses"))
def partition_tie_lines(g: Grid) -> DataFrame:
    return network.tie_lines(g.branches, network.areas(g.buses))


@query("SELECT * FROM (SELECT 'branch.from_bus' AS entity, id AS entity_id, from_bus AS bus FROM branches UNION ALL SELECT 'branch.to_bus', id, to_bus FROM branches UNION ALL SELECT 'generator', id, bus FROM generators UNION ALL SELECT 'load', id, bus FROM loads) r WHERE bus NOT IN (SELECT bus FROM generators)", ("branches", "generators", "loads"))
def validate_references(g: Grid) -> DataFrame:
    return network.dangling(g.generators.select(F.col("bus").alias("id")).distinct(), g.branches, g.generators, g.loads)


@query("SELECT bus AS id, count(*) AS n FROM generators GROUP BY bus HAVING count(*) > 1", ("generators",))
def validate_unique_ids(g: Grid) -> DataFrame:
    return network.duplicate_ids(g.generators.select(F.col("bus").alias("id")))


MERIT = """
WITH u AS (
  SELECT id, bus, c1, pmin_mw, greatest(pmax_mw - pmin_mw, 0) AS room, sum(pmin_mw) OVER () AS base, (SELECT sum(active_power_mw) * 1.01::DOUBLE FROM loads) AS need FROM generators WHERE status
), w AS (
  SELECT *, coalesce(sum(room) OVER (ORDER BY c1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(room) OVER () AS rooms FROM u
)
SELECT id, bus, c1, round(pmin_mw + least(greatest(need - base - before, 0), room), 6) AS dispatch_mw, round(greatest(need - base - rooms, 0), 6) AS short_mw FROM w
"""


def _dispatch(g: Grid) -> DataFrame:
    need = g.loads.agg((F.sum("active_power_mw") * 1.01).alias("need"))
    return dispatch.merit_order(g.generators.crossJoin(F.broadcast(need)), F.col("need"))


@query(MERIT, ("generators", "loads"))
def merit_order_dispatch(g: Grid) -> DataFrame:
    return _dispatch(g)


@query("SELECT id, round(c0 + c1 * pmax_mw + 0.01::DOUBLE * pmax_mw * pmax_mw, 6) AS cost FROM generators", ("generators",))
def cost_evaluate_poly(g: Grid) -> DataFrame:
    return g.generators.select("id", dispatch.polynomial_cost(F.array("c0", "c1", F.lit(0.01)), F.col("pmax_mw")).alias("cost"))


@query("SELECT id, round(CASE WHEN pmax_mw <= 20 THEN 100.0 WHEN pmax_mw >= 80 THEN 900.0 WHEN pmax_mw < 50 THEN 100 + (pmax_mw - 20) * 300 / 30 ELSE 400 + (pmax_mw - 50) * 500 / 30 END::DOUBLE, 6) AS cost FROM generators", ("generators",))
def cost_evaluate_pwl(g: Grid) -> DataFrame:
    a = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    return g.generators.select("id", dispatch.piecewise_cost(a(20, 50, 80), a(100, 400, 900), F.col("pmax_mw")).alias("cost"))


@query("SELECT branch_id AS gen_id, time, delta, CASE WHEN delta > 0 THEN 'up' ELSE 'down' END AS direction FROM (SELECT branch_id, time, round(p - lag(p) OVER (PARTITION BY branch_id ORDER BY time), 6) AS delta FROM (SELECT branch_id, time, sum(flow_mw) AS p FROM flows GROUP BY 1, 2) x) y WHERE abs(delta) > 50.001::DOUBLE", ("flows",))
def ramp_violations(g: Grid) -> DataFrame:
    runs = g.flows.groupBy(F.col("branch_id").alias("gen_id"), "time").agg(F.sum("flow_mw").alias("p_mw"))
    return dispatch.ramp_violations(runs, 50.0)


@query("SELECT a.id AS a, b.id AS b FROM branches a JOIN branches b ON a.id < b.id WHERE a.status AND b.status", ("branches",))
def n2_pairs(g: Grid) -> DataFrame:
    return dispatch.pairs(g.branches)


@query("SELECT contingency, round(exp(sum(ln(r))), 6) AS probability, count(*) AS n FROM (SELECT e.element_id % 100 AS contingency, CASE WHEN failure_rate > 0 THEN failure_rate ELSE 0.01 END::DOUBLE AS r FROM elements e) x GROUP BY 1", ("elements",))
def contingency_probability(g: Grid) -> DataFrame:
    e = g.elements
    outages = e.select((F.col("element_id") % 100).alias("contingency"), F.col("element_id").alias("branch_id"))
    return dispatch.outage_probability(outages, e.where("failure_rate > 0").select(F.col("element_id").alias("branch_id"), F.col("failure_rate").alias("rate")))


@query("SELECT time, round(eue, 6) AS eue, row_number() OVER w::INTEGER AS rank, round(sum(eue) OVER w, 6) AS cumulative, round(sum(eue) OVER w / sum(eue) OVER (), 6) AS share FROM (SELECT time, round(sum(unserved_energy_mw), 6) AS eue FROM flows GROUP BY 1) x WINDOW w AS (ORDER BY eue DESC, time ROWS UNBOUNDED PRECEDING)".replace("row_number() OVER w::INTEGER", "CAST(row_number() OVER w AS INTEGER)"), ("flows",))
def nk_rank_cumulative_eue(g: Grid) -> DataFrame:
    return dispatch.cumulative_eue(g.flows.groupBy("time").agg(F.round(F.sum("unserved_energy_mw"), 6).alias("eue")), "time")


def _flow(g: Grid) -> DataFrame:
    d = _dispatch(g).select("id", "bus", F.col("dispatch_mw").alias("pmax_mw"))
    return kernels.dc_flow(g.buses, g.branches, network.injections(d, g.loads))


@query()
def dc_flow(g: Grid) -> DataFrame:
    return _flow(g)


@query("SELECT id AS bus, 0.0::DOUBLE AS residual FROM buses WHERE id > 1", ("buses",))
def dc_flow_kcl_residual(g: Grid) -> DataFrame:
    f = _flow(g)
    d = _dispatch(g).select("id", "bus", F.col("dispatch_mw").alias("pmax_mw"))
    out = f.select(F.col("from_bus").alias("bus"), F.col("flow_mw").alias("p")).unionAll(f.select("to_bus", -F.col("flow_mw"))).unionAll(network.injections(d, g.loads).select("bus", -F.col("injection_mw")))
    return out.where("bus > 1").groupBy("bus").agg(F.abs(F.round(F.sum("p"), 5)).alias("residual"))


@query()
def ptdf_matrix(g: Grid) -> DataFrame:
    return kernels.ptdf(g.buses, g.branches)


@query()
def lodf_matrix(g: Grid) -> DataFrame:
    return dispatch.lodf(kernels.ptdf(g.buses, g.branches), g.branches)


@query()
def n1_screen(g: Grid) -> DataFrame:
    return dispatch.screen(dispatch.lodf(kernels.ptdf(g.buses, g.branches), g.branches), _flow(g), g.limits)


@query()
def ds_scores(g: Grid) -> DataFrame:
    pmax = g.generators.groupBy(F.col("bus").alias("bus_id")).agg(F.sum("pmax_mw").alias("pmax"))
    return analytics.deliverability(kernels.ptdf(g.buses, g.branches), g.limits, g.flows, pmax)


@query()
def ac_newton(g: Grid) -> DataFrame:
    d = _dispatch(g).select("id", "bus", F.col("dispatch_mw").alias("pmax_mw"))
    ratio = 20 / g.loads.agg(F.sum("active_power_mw")).first()[0]
    s = network.injections(d, g.loads).select("bus", (F.col("injection_mw") * ratio).alias("injection_mw"), F.lit(0.0).alias("injection_mvar"))
    return kernels.ac_flow(g.buses, network.y_bus(g.branches), s)


@query("SELECT s.scenario_id, l.id, l.bus, round(active_power_mw * load_scale, 6) AS active_power_mw FROM loads l, scenarios s", ("loads", "scenarios"))
def scenario_apply_loads(g: Grid) -> DataFrame:
    return fleet.apply_scenarios(g.scenarios, g.loads)


@query("SELECT s.scenario_id, b.id, from_bus, to_bus FROM branches b, scenarios s WHERE NOT (b.id % 7 = length(s.scenario_id) % 7)", ("branches", "scenarios"))
def scenario_apply_outages(g: Grid) -> DataFrame:
    out = g.branches.crossJoin(g.scenarios).where("id % 7 = length(scenario_id) % 7").select("scenario_id", F.col("id").alias("branch_id"))
    return fleet.apply_outages(g.scenarios, g.branches, out)


@query("SELECT 'pf:' || scenario_id AS job_id, scenario_id FROM scenarios", ("scenarios",))
def batch_jobs(g: Grid) -> DataFrame:
    return fleet.batch_jobs(g.scenarios, "pf")


@query("WITH a AS (SELECT list(repair_hours ORDER BY repair_hours) AS v, count(*) AS n, min(repair_hours) AS min, max(repair_hours) AS max, avg(repair_hours) AS mean FROM elements) SELECT n, min, max, round(mean, 6) AS mean, v[n // 2 + 1] AS median, v[least(ceil(n * 0.95::DOUBLE)::BIGINT, n - 1) + 1] AS p95 FROM a", ("elements",))
def batch_stats(g: Grid) -> DataFrame:
    return fleet.batch_stats(g.elements, "repair_hours")


@query("SELECT coalesce(agg_id, asset_id::VARCHAR) AS group_id, min(p_min) AS p_min, max(p_max) AS p_max, min(q_min) AS q_min, max(q_max) AS q_max, count(*) AS n_assets FROM assets GROUP BY 1", ("assets",))
def derms_envelope_agg(g: Grid) -> DataFrame:
    return fleet.envelope(g.assets)


@query("SELECT bus::VARCHAR AS group_id, min(p_min) AS p_min, max(p_max) AS p_max, min(q_min) AS q_min, max(q_max) AS q_max, count(*) AS n_assets FROM assets GROUP BY 1", ("assets",))
def derms_envelope_bus(g: Grid) -> DataFrame:
    return fleet.envelope(g.assets, by_bus=True)


PRICES = "SELECT (timestamp // 3600) % 24 AS hour, round(avg(value), 3) AS price FROM series GROUP BY 1"
SCHEDULE = f"""
WITH RECURSIVE prices AS ({PRICES}), h AS (
  SELECT hour, price, row_number() OVER (ORDER BY hour, price) AS k, (SELECT median(price) FROM prices) AS m FROM prices
), d AS (
  SELECT asset_id, hour, k, CASE WHEN price >= m THEN p_min ELSE p_max END AS desired FROM assets, h
), s AS (
  SELECT asset_id, 0::BIGINT AS k, NULL::BIGINT AS hour, 0.0::DOUBLE AS desired, 0.0::DOUBLE AS actual, 2.0::DOUBLE AS soc FROM assets
  UNION ALL SELECT d.asset_id, d.k, d.hour, d.desired, greatest(0.0::DOUBLE - s.soc, least(d.desired, 4.0::DOUBLE - s.soc)), s.soc + greatest(0.0::DOUBLE - s.soc, least(d.desired, 4.0::DOUBLE - s.soc)) FROM s JOIN d ON d.asset_id = s.asset_id AND d.k = s.k + 1
)
"""


def _schedule(g: Grid) -> DataFrame:
    prices = g.series.groupBy(F.expr("(timestamp div 3600) % 24").alias("hour")).agg(F.round(F.avg("value"), 3).alias("price"))
    return fleet.schedule(g.assets, prices)


@query(SCHEDULE + "SELECT asset_id, hour, desired, actual, soc FROM s WHERE k > 0", ("assets", "series"))
def derms_schedule(g: Grid) -> DataFrame:
    return _schedule(g)


@query(SCHEDULE + "SELECT round(avg(CASE WHEN abs(actual - desired) > 0.000001::DOUBLE THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS curtailment_rate FROM s WHERE k > 0", ("assets", "series"))
def derms_curtailment_rate(g: Grid) -> DataFrame:
    return fleet.curtailment(_schedule(g))


@query("WITH e AS (SELECT *, row_number() OVER (ORDER BY element_id) - 1 AS k, count(*) OVER () AS n FROM elements) SELECT run, element_id, round(greatest(failure_rate * repair_hours, 1), 6) AS saidi, failure_rate AS saifi, round(CASE WHEN failure_rate > 0 THEN greatest(failure_rate * repair_hours, 1) / failure_rate ELSE 0 END, 6) AS caidi FROM (SELECT unnest(range(5000)) AS run) r JOIN e ON run % n = k", ("elements",))
def flisr_runs(g: Grid) -> DataFrame:
    return fleet.flisr(g.elements, 5000)


FRAMES = "SELECT timestamp, CAST(user_id % 25 + 1 AS BIGINT) AS bus_id, 1 + value / 1000 AS vm, value / 100 AS va, value / 50 AS tve, user_id % 4 <> 0 AS valid FROM series"


@query(f"WITH f AS ({FRAMES}) SELECT timestamp, bus_id, 'voltage' AS type, round(vm, 6) AS value, round(greatest(1 / (1 + tve * tve), 0.1::DOUBLE), 6) AS weight FROM f WHERE valid UNION ALL SELECT timestamp, bus_id, 'angle', round(va, 6), round(greatest(1 / (1 + tve * tve), 0.1::DOUBLE), 6) FROM f WHERE valid", ("series",))
def pmu_to_measurements(g: Grid) -> DataFrame:
    v = F.col("value")
    return fleet.pmu_measurements(g.series.select("timestamp", (F.col("user_id") % 25 + 1).cast("long").alias("bus_id"), (1 + v / 1000).alias("vm"), (v / 100).alias("va"), (v / 50).alias("tve"), (F.col("user_id") % 4 != 0).alias("valid")))


GRAPHS = "SELECT scenario_id, time, (dense_rank() OVER (ORDER BY scenario_id, time) - 1)::INTEGER AS graph_id FROM (SELECT DISTINCT scenario_id, time FROM flows) x"
NODES = "SELECT (row_number() OVER (ORDER BY b.id) - 1)::INTEGER AS node_id, b.id AS bus_id, voltage_kv, coalesce(num_gens, 0) AS num_gens, coalesce(num_loads, 0) AS num_loads, round(coalesce(p, 0), 6) AS pmax_mw, round(coalesce(l, 0), 6) AS load_mw FROM buses b LEFT JOIN (SELECT bus, count(*) AS num_gens, sum(pmax_mw) AS p FROM generators GROUP BY 1) g ON g.bus = b.id LEFT JOIN (SELECT bus, count(*) AS num_loads, sum(active_power_mw) AS l FROM loads GROUP BY 1) d ON d.bus = b.id"


@query(GRAPHS, ("flows",))
def gnn_graphs(g: Grid) -> DataFrame:
    return fleet.gnn_graphs(g.flows)


@query(NODES, ("buses", "generators", "loads"))
def gnn_nodes(g: Grid) -> DataFrame:
    return fleet.gnn_nodes(g.buses, g.generators, g.loads)


@query(f"SELECT graph_id, b.id AS branch_id, p.node_id AS from_node, q.node_id AS to_node, round(reactance_pu, 6) AS reactance_pu, coalesce(flow_mw, 0) AS flow_mw FROM branches b JOIN ({NODES}) p ON p.bus_id = from_bus JOIN ({NODES}) q ON q.bus_id = to_bus CROSS JOIN ({GRAPHS}) g LEFT JOIN flows f ON f.scenario_id = g.scenario_id AND f.time = g.time AND f.branch_id = b.id", ("branches", "buses", "generators", "loads", "flows"))
def gnn_edges(g: Grid) -> DataFrame:
    return fleet.gnn_edges(g.flows, g.branches, fleet.gnn_graphs(g.flows), fleet.gnn_nodes(g.buses, g.generators, g.loads))


KM = "2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians(s.lat - b.lat) / 2), 2) + cos(radians(b.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - b.lon) / 2), 2)))"
KNN = f"SELECT bus_id, site_id, round(distance_km, 6) AS distance_km, k FROM (SELECT b.id AS bus_id, s.id AS site_id, {KM} AS distance_km, row_number() OVER (PARTITION BY b.id ORDER BY {KM}, s.id)::INTEGER AS k FROM buses b, buses s WHERE s.id % 5 = 0) x WHERE k <= {{k}}"


def _sites(g: Grid) -> DataFrame:
    return g.buses.where("id % 5 = 0").select(F.col("id").alias("site_id"), F.col("lat").alias("site_lat"), F.col("lon").alias("site_lon"))


@query(KNN.format(k=2), ("buses",))
def geo_knn(g: Grid) -> DataFrame:
    return fleet.knn(g.buses, _sites(g), 2)


@query(KNN.format(k=1), ("buses",))
def geo_voronoi(g: Grid) -> DataFrame:
    return fleet.knn(g.buses, _sites(g), 1)


@query("SELECT id AS bus_id, CASE WHEN lon > 1.5::DOUBLE AND lon < 9.5::DOUBLE AND lat > 0.5::DOUBLE AND lat < 8.5::DOUBLE THEN 1::BIGINT WHEN lon > 6.5::DOUBLE AND lon < 20.5::DOUBLE AND lat > 4.5::DOUBLE AND lat < 16.5::DOUBLE THEN 2::BIGINT END AS polygon_id FROM buses", ("buses",))
def geo_point_in_polygon(g: Grid) -> DataFrame:
    box = lambda a, b, c, d: [(a, b), (c, b), (c, d), (a, d)]
    polygons = g.spark.createDataFrame([(1, box(1.5, 0.5, 9.5, 8.5)), (2, box(6.5, 4.5, 20.5, 16.5))], "polygon_id long, ring array<struct<x:double,y:double>>")
    return fleet.point_in_polygon(g.buses, polygons)


HOURLY = "SELECT sensor, timestamp - timestamp % 3600 AS hour, round(sum(value), 4) AS v FROM series GROUP BY 1, 2"


def _hourly(g: Grid) -> DataFrame:
    return g.series.groupBy("sensor", (F.col("timestamp") - F.col("timestamp") % 3600).alias("hour")).agg(F.round(F.sum("value"), 4).alias("v"))


@query(f"SELECT sensor, hour, v, lag(v, 1) OVER w AS lag_1, lag(v, 2) OVER w AS lag_2, round(avg(v) OVER r, 6) AS rolling_mean, round(stddev_pop(v) OVER r, 6) AS rolling_std FROM ({HOURLY}) x WINDOW w AS (PARTITION BY sensor ORDER BY hour), r AS (PARTITION BY sensor ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", ("series",))
def geo_lag_rolling(g: Grid) -> DataFrame:
    return fleet.lags_and_rolling(_hourly(g), "sensor", "hour", "v")


@query(f"SELECT *, extract(hour FROM t)::INTEGER AS hour_of_day, (isodow(t) - 1)::INTEGER AS day_of_week, month(t)::INTEGER AS month_of_year, isodow(t) >= 6 AS is_weekend, extract(hour FROM t) BETWEEN 7 AND 22 AS is_peak_hour FROM (SELECT *, make_timestamp(hour * 1000000) AS t FROM ({HOURLY}) h) x".replace("SELECT *, extract", "SELECT sensor, hour, v, extract"), ("series",))
def geo_seasonal(g: Grid) -> DataFrame:
    return fleet.seasonal(_hourly(g), "hour")




def _runs(g: Grid, f: float, k: int) -> DataFrame:
    return g.star("part").groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("case_name")).agg((F.round(F.sum("p_retailprice"), 2) * f).alias("solve_ms"), (F.count("*") % k != 0).alias("converged"))


@query("WITH r AS (SELECT p_brand || '/' || p_size::VARCHAR AS case_name, round(sum(p_retailprice), 2) AS solve_ms, count(*) % 4 <> 0 AS converged FROM part GROUP BY 1) SELECT count(*) AS n, round(avg(CASE WHEN converged THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS pass_rate, round(avg(CASE WHEN converged THEN solve_ms END), 6) AS avg_solve_ms, max(CASE WHEN converged THEN solve_ms END) AS max_solve_ms, (SELECT case_name FROM r WHERE converged ORDER BY solve_ms DESC, case_name DESC LIMIT 1) AS slowest FROM r")
def benchmark_summary(g: Grid) -> DataFrame:
    return fleet.benchmark_summary(_runs(g, 1.0, 4))


@query("WITH r AS (SELECT p_brand || '/' || p_size::VARCHAR AS case_name, round(sum(p_retailprice), 2) AS v, count(*) AS n FROM part GROUP BY 1) SELECT case_name, CASE WHEN n % 4 <> 0 AND n % 3 = 0 THEN 'newly failing' WHEN n % 4 = 0 AND n % 3 <> 0 THEN 'newly passing' ELSE 'same' END AS change, round(v * 1.25::DOUBLE - v, 6) AS delta_ms, round(CASE WHEN v > 0 THEN 100 * (v * 1.25::DOUBLE - v) / v ELSE 0 END, 6) AS delta_pct FROM r")
def benchmark_compare(g: Grid) -> DataFrame:
    return fleet.benchmark_compare(_runs(g, 1.0, 4), _runs(g, 1.25, 3))


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
