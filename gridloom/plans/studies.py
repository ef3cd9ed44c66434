"""Queries of checks, markets, contingencies, metrics, estimation and sampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions import units
from gridloom.operators import checks, dispatch, fleet, kernels, market, network, scenario, studies
from gridloom.operators.order import by_id, numbered
from gridloom.plans.adapter import Grid
from gridloom.plans.catalog import query

GRID = ("buses", "branches", "generators", "loads")
#: Variants of the grid that break rules, in both dialects.
BAD_BUS = "SELECT id, CASE WHEN id % 6 = 0 THEN 0 WHEN id % 7 = 0 THEN 2000 ELSE voltage_kv END AS voltage_kv FROM buses"
BAD_BRANCH = "SELECT id, CASE WHEN id % 5 = 0 THEN -resistance_pu WHEN id % 11 = 0 THEN 0 ELSE resistance_pu * (id % 3) * 40 END AS resistance_pu, CASE WHEN id % 11 = 0 THEN 0 ELSE reactance_pu END AS reactance_pu, CAST(id % 4 - 1 AS DOUBLE) AS tap_ratio, rate_a_mva - 105 AS rate_a_mva FROM branches"
BAD_UNIT = "SELECT id, bus, pmax_mw * (id % 5 - 1) * 60 AS pmax_mw, CAST(30 - id % 50 AS DOUBLE) AS pmin_mw FROM generators"


def _sql(g: Grid, text: str, *views: str) -> DataFrame:
    return g.spark.sql(text.replace(views[0], "{d}"), d=getattr(g, views[0]))


def _finds(table: str, entity: str, rules: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{s}' AS severity, '{entity}' AS entity, id AS entity_id, '{m}' AS message FROM {table} WHERE {c}" for s, m, c in rules)


_TOTALS = "(SELECT NULL::BIGINT AS id, sum(pmax_mw) AS pmax, sum(pmin_mw) AS pmin, (SELECT sum(active_power_mw) FROM loads) AS l FROM bad_unit)"
PHYSICAL = " UNION ALL ".join([
    _finds("bad_bus", "bus", [("error", "voltage not above 0", "voltage_kv <= 0"), ("warning", "unusual voltage", "voltage_kv > 1500")]),
    _finds("bad_branch", "branch", [("error", "negative resistance", "resistance_pu < 0"), ("error", "zero impedance", "resistance_pu = 0 AND reactance_pu = 0"), ("warning", "high R/X", "abs(reactance_pu) > 1e-9 AND resistance_pu > 10 * abs(reactance_pu)"), ("error", "negative tap", "tap_ratio < 0"), ("error", "zero tap", "tap_ratio = 0"), ("error", "negative rating", "rate_a_mva < 0")]),
    _finds("bad_unit", "generator", [("error", "pmax below pmin", "pmax_mw < pmin_mw"), ("warning", "negative pmin", "pmin_mw < 0"), ("warning", "very large unit", "pmax_mw > 10000")]),
    _finds(_TOTALS, "network", [("warning", "capacity below load", "l > 0 AND pmax < l"), ("warning", "minimum above load", "l > 0 AND pmin > l")]),
])


@query(f"WITH bad_bus AS ({BAD_BUS}), bad_branch AS ({BAD_BRANCH}), bad_unit AS ({BAD_UNIT}) {PHYSICAL}", GRID)
def validate_physical(g: Grid) -> DataFrame:
    return checks.physical(_sql(g, BAD_BUS, "buses"), _sql(g, BAD_BRANCH, "branches"), _sql(g, BAD_UNIT, "generators"), g.loads)


BALANCE = " UNION ALL ".join([
    _finds("bad_unit", "generator", [("error", "negative pmax", "pmax_mw < 0"), ("error", "pmin above pmax", "pmin_mw > pmax_mw")]),
    _finds("loads", "load", [("warning", "negative load", "active_power_mw < 0")]),
    _finds(_TOTALS, "network", [("error", "capacity below load", "pmax < l"), ("warning", "minimum above load", "l > 0 AND pmin > l"), ("warning", "reserve above 500 %", "l > 0 AND pmax - l > 5 * l"), ("warning", "no load", "l = 0")]),
])


@query(f"WITH bad_unit AS ({BAD_UNIT}) {BALANCE}", ("generators", "loads"))
def validate_power_balance(g: Grid) -> DataFrame:
    return checks.balance(_sql(g, BAD_UNIT, "generators"), g.loads)


@query("WITH b AS (SELECT id, from_bus % 3 AS from_bus, to_bus % 3 AS to_bus FROM branches), u AS (SELECT id, bus % 3 AS bus FROM generators) SELECT 'warning' AS severity, 'generator' AS entity, id AS entity_id, 'at bus 0' AS message FROM u WHERE bus = 0 UNION ALL SELECT 'warning', 'load', max(bus), 'all on one bus' FROM (SELECT 7::BIGINT AS bus FROM loads) x HAVING count(*) > 1 UNION ALL SELECT 'warning', 'branch', min(id), 'many parallel branches' FROM b GROUP BY from_bus, to_bus HAVING count(*) > 2", ("branches", "generators", "loads"))
def validate_placement(g: Grid) -> DataFrame:
    mod = lambda d, *cs: d.withColumns({c: F.col(c) % 3 for c in cs})
    return checks.placement(mod(g.branches, "from_bus", "to_bus"), mod(g.generators, "bus"), g.loads.withColumn("bus", F.lit(7).cast("long")))


@query("WITH RECURSIVE e AS (SELECT id, least(from_bus, 20) AS a, least(to_bus, 20) AS b FROM branches WHERE least(from_bus, 20) <> 3 AND least(to_bus, 20) <> 3), ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach AS (SELECT id AS bus, id AS o FROM buses UNION SELECT r.bus, y.b FROM reach r JOIN ends y ON y.a = r.o), low AS (SELECT bus, min(o) AS m FROM reach GROUP BY bus) SELECT 'error' AS severity, 'branch' AS entity, id AS entity_id, 'self loop' AS message FROM e WHERE a = b UNION ALL SELECT 'warning', 'bus', id, 'no branch' FROM buses WHERE id NOT IN (SELECT a FROM ends) UNION ALL SELECT 'warning', 'island', m, 'not connected to the first island' FROM low WHERE m > 1 GROUP BY m", ("branches", "buses"))
def validate_topology(g: Grid) -> DataFrame:
    e = g.branches.withColumns({c: F.least(F.col(c), F.lit(20)) for c in ("from_bus", "to_bus")}).where("from_bus <> 3 and to_bus <> 3")
    return checks.topology(g.buses, e, network.islands(g.buses, e))


@query("SELECT a.*, b.*, c.*, d.*, round(100 * (capacity_mw - load_mw) / load_mw, 6) AS reserve_pct FROM (SELECT count(*) AS n_buses, min(voltage_kv) AS min_kv, max(voltage_kv) AS max_kv FROM buses) a, (SELECT count(*) AS n_branches, count(*) FILTER (WHERE status) AS n_in_service FROM branches) b, (SELECT count(*) AS n_generators, round(sum(pmax_mw), 6) AS capacity_mw, count(DISTINCT bus) = 1 AND count(*) > 1 AS all_units_on_one_bus FROM generators) c, (SELECT count(*) AS n_loads, round(sum(active_power_mw), 6) AS load_mw FROM loads) d", GRID)
def inspect_summary(g: Grid) -> DataFrame:
    return checks.summary(g.buses, g.branches, g.generators, g.loads)


@query("SELECT b.id AS bus, round(coalesce(p, 0), 6) AS capacity_mw, round(coalesce(l, 0), 6) AS load_mw, round(coalesce(p, 0) - coalesce(l, 0), 6) AS surplus_mw FROM buses b LEFT JOIN (SELECT bus, sum(pmax_mw) AS p FROM generators WHERE status GROUP BY 1) u ON u.bus = b.id LEFT JOIN (SELECT bus, sum(active_power_mw) AS l FROM loads GROUP BY 1) d ON d.bus = b.id", ("buses", "generators", "loads"))
def inspect_power_balance(g: Grid) -> DataFrame:
    return checks.bus_balance(g.buses, g.generators, g.loads)


@query("SELECT 'weight' AS column, 'missing' AS problem UNION ALL SELECT 'cost', 'type'")
def validate_dataset_spec(g: Grid) -> DataFrame:
    return checks.against_spec(g.scenarios, [("SCENARIO_ID", "STRING"), ("cost", "bigint"), ("weight", None), ("storm", "boolean_flag")])


@query("SELECT 'storm' AS column, 'control' AS role UNION ALL SELECT 'storage', 'control' UNION ALL SELECT 'cost', 'kpi' UNION ALL SELECT 'load_scale', 'kpi' UNION ALL SELECT 'wind_enabled', 'control'")
def kpi_column_roles(g: Grid) -> DataFrame:
    return checks.column_roles(g.scenarios.withColumn("wind_enabled", F.lit(1)))


SPEC = "SELECT scenario_id, CASE WHEN storm THEN load_scale END AS load_scale, CASE WHEN storage THEN load_scale / 2 END AS renewable_scale, CASE WHEN storm THEN NULL ELSE cost END AS weight"


@query(f"WITH s AS ({SPEC}, storage FROM scenarios) SELECT scenario_id, coalesce(load_scale, 1) AS load_scale, coalesce(renewable_scale, 0.9::DOUBLE) AS renewable_scale, round(coalesce(weight, 1), 6) AS weight, unnest(CASE WHEN storage THEN ['t1', 't2'] ELSE ['t0'] END) AS time FROM s", ("scenarios",))
def scenario_resolve(g: Grid) -> DataFrame:
    d = g.spark.sql(f"{SPEC}, CASE WHEN storage THEN array('t1', 't2') END AS time_slices FROM {{d}}", d=g.scenarios)
    d = d.withColumn("time_slices", F.coalesce("time_slices", F.array(F.lit("t0"))))
    return scenario.resolve(d, {"load_scale": 1.0, "renewable_scale": 0.9, "weight": 1.0})


@query("SELECT scenario_id, 'repeated id' AS problem FROM scenarios UNION ALL SELECT '', 'empty id' UNION ALL SELECT scenario_id, 'no time slice' FROM scenarios WHERE storm UNION ALL SELECT scenario_id, 'no time slice' FROM scenarios WHERE storm UNION ALL SELECT '', 'no time slice'", ("scenarios",))
def scenario_validate(g: Grid) -> DataFrame:
    d = g.scenarios.select("scenario_id", F.when(F.col("storm"), F.array().cast("array<string>")).otherwise(F.array(F.lit("t"))).alias("time_slices"))
    return checks.scenario_findings(d.unionAll(d).unionAll(g.spark.createDataFrame([("", None)], "scenario_id string, time_slices array<string>")))


@query("SELECT s.scenario_id, u.id, u.bus, round(CASE WHEN s.storm AND u.id % 4 = 0 THEN 5 WHEN u.id % 2 = 0 THEN pmax_mw * s.load_scale ELSE pmax_mw END, 6) AS pmax_mw FROM generators u, scenarios s", ("generators", "scenarios"))
def scenario_apply_gens(g: Grid) -> DataFrame:
    s = g.scenarios
    o = s.where("storm").crossJoin(g.generators.where("id % 4 = 0").select("id")).select("scenario_id", "id", F.lit(5.0).alias("p_mw"))
    return scenario.apply_generators(s.withColumn("renewable_scale", F.col("load_scale")), g.generators.withColumn("is_renewable", F.col("id") % 2 == 0), o)


@query("SELECT name AS wanted, id FROM buses UNION ALL SELECT id::VARCHAR, id FROM buses", ("buses",))
def scenario_match_names(g: Grid) -> DataFrame:
    b = g.buses
    return scenario.named(b, b.select(F.col("name").alias("wanted")).unionAll(b.select(F.col("id").cast("string"))).unionAll(g.spark.createDataFrame([("nobody",)], "wanted string")))


@query("SELECT count(*) AS n_jobs, count(*) FILTER (WHERE NOT storm) AS n_ok, count(*) FILTER (WHERE storm) AS n_failed FROM scenarios", ("scenarios",))
def batch_manifest(g: Grid) -> DataFrame:
    def study(rows):
        if rows.storm.iloc[0]:
            raise ValueError("no study in a storm")
        return rows[["cost"]]

    return scenario.batch_manifest(scenario.run_batch(g.scenarios, study, "cost double"))


@query("SELECT id, from_bus, to_bus FROM branches WHERE id <> 7", ("branches",))
def branches_without_outage(g: Grid) -> DataFrame:
    return g.branches.where(F.col("id") != 7).select("id", "from_bus", "to_bus")


OFFERS = """
WITH offers AS (
  SELECT l.bus_id, pmax AS width, coalesce(marginal_cost, 1) AS c, 0.0::DOUBLE AS s FROM opf_limits l LEFT JOIN opf_costs k USING (bus_id) WHERE {plain}
  {more}
), o AS (
  SELECT o.*, pmin, pmax, demand, coalesce(sum(width) OVER (PARTITION BY bus_id ORDER BY c, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM offers o JOIN opf_limits USING (bus_id)
), p AS (
  SELECT *, greatest(least(lo + width, pmin) - greatest(lo, 0), 0) AS must, greatest(least(lo + width, pmax) - greatest(lo, pmin), 0) AS room FROM o
), q AS (
  SELECT *, (SELECT sum(demand) FROM opf_limits) - (SELECT sum(must) FROM p) - coalesce(sum(room) OVER (ORDER BY c, bus_id, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM p
), t AS (
  SELECT *, least(greatest(open, 0), room) AS taken FROM q
)
SELECT bus_id, round(sum(must + taken), 6) AS dispatch_mw, round(sum(must + taken) - max(demand), 6) AS injection_mw, (SELECT max(c) FROM t WHERE taken > 0) AS price, round(greatest((SELECT sum(demand) FROM opf_limits) - (SELECT sum(must + room) FROM t), 0), 6) AS short_mw FROM t GROUP BY bus_id
"""


@query(OFFERS.format(plain="true", more=""), ("opf_limits", "opf_costs"))
def dc_opf_csv_linear(g: Grid) -> DataFrame:
    return market.dispatch(g.opf_limits, g.opf_costs)


@query(OFFERS.format(plain="bus_id NOT IN (SELECT bus_id FROM segments)", more='UNION ALL SELECT bus_id, "end" - start, slope, start FROM segments'), ("opf_limits", "opf_costs", "segments"))
def dc_opf_csv_piecewise(g: Grid) -> DataFrame:
    return market.dispatch(g.opf_limits, g.opf_costs, g.segments)


@query('SELECT bus_id, \'overlap\' AS problem FROM segments WHERE start > 0 AND bus_id % 2 = 0 UNION ALL SELECT bus_id, \'gap\' FROM segments WHERE start > 0 AND bus_id % 2 = 1', ("segments",))
def dc_opf_segment_findings(g: Grid) -> DataFrame:
    moved = g.segments.withColumn("start", F.when(F.col("start") > 0, F.when(F.col("bus_id") % 2 == 0, F.col("start") * 0.9).otherwise(F.col("start") * 1.1)).otherwise(F.col("start")))
    return market.segment_findings(g.opf_limits, moved)


@query("SELECT bus_id, start, row_number() OVER (PARTITION BY bus_id ORDER BY start)::INTEGER AS k, slope FROM segments", ("segments",))
def piecewise_by_start(g: Grid) -> DataFrame:
    from pyspark.sql import Window as W

    return g.segments.select("bus_id", F.round("start", 6).alias("start"), F.row_number().over(W.partitionBy("bus_id").orderBy("start")).alias("k"), "slope")


def _network_dispatch(g: Grid) -> DataFrame:
    u = g.generators.where("status")
    need = g.loads.agg((F.sum("active_power_mw") * 1.01).alias("need"))
    n = u.agg(F.count("*").alias("n"))
    limits = u.crossJoin(need).crossJoin(n).select(F.col("id").alias("bus_id"), F.col("pmin_mw").alias("pmin"), F.col("pmax_mw").alias("pmax"), (F.col("need") / F.col("n")).alias("demand"))
    return market.dispatch(limits, u.select(F.col("id").alias("bus_id"), F.col("c1").alias("marginal_cost"))).select(F.col("bus_id").alias("id"), "dispatch_mw", F.col("price").alias("lmp"), "short_mw")


@query("WITH u AS (SELECT id, c1, pmin_mw, pmax_mw - pmin_mw AS room, (SELECT sum(active_power_mw) * 1.01::DOUBLE FROM loads) - sum(pmin_mw) OVER () AS need, sum(pmax_mw - pmin_mw) OVER () AS rooms FROM generators WHERE status), w AS (SELECT *, least(greatest(need - coalesce(sum(room) OVER (ORDER BY c1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0), room) AS t FROM u) SELECT id, round(pmin_mw + t, 6) AS dispatch_mw, (SELECT max(c1) FROM w WHERE t > 1e-9) AS lmp, round(greatest(need - rooms, 0), 6) AS short_mw FROM w", ("generators", "loads"))
def dc_opf_network_dispatch(g: Grid) -> DataFrame:
    return _network_dispatch(g)


@query()
def dc_opf_network_flows(g: Grid) -> DataFrame:
    d = _network_dispatch(g).join(g.generators.select("id", "bus"), "id").select("bus", F.col("dispatch_mw").alias("pmax_mw"))
    return kernels.dc_flow(g.buses, g.branches, network.injections(d, g.loads))


@query("SELECT scenario_id, time, branch_id, flow_mw, flow_limit, abs(flow_mw) - flow_limit AS excess_mw FROM flows JOIN limits USING (branch_id) WHERE abs(flow_mw) > flow_limit", ("flows", "limits"))
def branch_limit_violations(g: Grid) -> DataFrame:
    return market.limit_violations(g.flows, g.limits).select("scenario_id", "time", "branch_id", "flow_mw", "flow_limit", "excess_mw")


@query("SELECT id, round(greatest(pmax_mw / 2 - 10, pmin_mw), 6) AS p_min_effective, round(least(pmax_mw / 2 + 20, pmax_mw), 6) AS p_max_effective FROM generators", ("generators",))
def effective_ramp_bounds(g: Grid) -> DataFrame:
    return market.effective_bounds(g.generators.withColumns({"p_prev": F.col("pmax_mw") / 2, "ramp_down": F.lit(20.0), "ramp_up": F.lit(40.0)}), 0.5)


@query("SELECT time, sum(flow_mw) AS p_mw FROM flows WHERE branch_id = 5 GROUP BY 1", ("flows",))
def generator_trajectory(g: Grid) -> DataFrame:
    return market.trajectory(g.flows.groupBy(F.col("branch_id").alias("gen_id"), "time").agg(F.sum("flow_mw").alias("p_mw")), 5)


INDICES = "SELECT *, coalesce(probability * load_shed_mw * 8760, 0) AS eue, CASE WHEN max_loading > 1 THEN coalesce(probability * (max_loading - 1) * 100, 0) ELSE 0 END AS severity FROM evaluations"


@query(f"SELECT contingency, round(eue, 6) AS eue, round(severity, 6) AS severity FROM ({INDICES}) e", ("evaluations",))
def contingency_indices(g: Grid) -> DataFrame:
    return studies.indices(g.evaluations).select("contingency", "eue", "severity")


@query("SELECT contingency, max_loading, violations FROM evaluations WHERE violations > 0", ("evaluations",))
def violations_by_severity(g: Grid) -> DataFrame:
    return studies.by_severity(g.evaluations).select("contingency", "max_loading", "violations")


@query(f"SELECT contingency, round(eue, 6) AS eue FROM ({INDICES}) e ORDER BY e.eue DESC, contingency LIMIT 20", ("evaluations",))
def top_by_eue(g: Grid) -> DataFrame:
    return studies.top_by(studies.indices(g.evaluations), "eue", 20).select("contingency", "eue")


@query(f"SELECT contingency, round(severity, 6) AS severity FROM ({INDICES}) e ORDER BY e.severity DESC, contingency LIMIT 20", ("evaluations",))
def top_by_severity(g: Grid) -> DataFrame:
    return studies.top_by(studies.indices(g.evaluations), "severity", 20).select("contingency", "severity")


@query(f"SELECT round(100 * sum(eue) FILTER (WHERE r <= 10) / sum(eue), 6) AS concentration_pct FROM (SELECT eue, row_number() OVER (ORDER BY eue DESC, contingency) AS r FROM ({INDICES}) e) x", ("evaluations",))
def eue_concentration(g: Grid) -> DataFrame:
    return studies.concentration(studies.indices(g.evaluations), 10)


@query("SELECT count(*) AS n, count(*) FILTER (WHERE violations > 0) AS n_violated, count(*) FILTER (WHERE NOT converged) AS n_not_converged, round(max(max_loading) FILTER (WHERE converged), 6) AS worst_loading, (SELECT contingency FROM evaluations WHERE converged ORDER BY max_loading DESC, contingency DESC LIMIT 1) AS worst_contingency FROM evaluations", ("evaluations",))
def worst_contingency(g: Grid) -> DataFrame:
    return studies.worst(g.evaluations)


@query("SELECT scenario_id, time, branch_id, abs(flow_mw) AS max_abs_flow_mw FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id, time ORDER BY abs(flow_mw) DESC, branch_id) AS r FROM flows) x WHERE r = 1", ("flows",))
def max_flow_branch(g: Grid) -> DataFrame:
    return studies.largest_flow(g.flows, ["scenario_id", "time"])


@query("SELECT 'N-1' AS kind, id AS a, NULL::BIGINT AS b FROM branches WHERE status UNION ALL SELECT 'N-2', x.id, y.id FROM branches x JOIN branches y ON x.id < y.id WHERE x.status AND y.status", ("branches",))
def n1_n2_contingencies(g: Grid) -> DataFrame:
    one = g.branches.where("status").select(F.lit("N-1").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("long").alias("b"))
    return one.unionByName(dispatch.pairs(g.branches).withColumn("kind", F.lit("N-2")))


@query("SELECT count(*) AS n_buses, round(max(abs(r * d)), 6) AS max_vm_error, round(degrees(max(abs(va * 0.01::DOUBLE))), 6) AS max_va_error_deg, round(avg(abs(r * d)), 6) AS mean_vm_error, round(degrees(avg(abs(va * 0.01::DOUBLE))), 6) AS mean_va_error_deg FROM (SELECT va, 1 AS r, CAST(bus_id % 5 AS DOUBLE) / 100 AS d FROM voltages WHERE bus_id % 10 <> 0) x", ("voltages",))
def pf_error_metrics(g: Grid) -> DataFrame:
    v = g.voltages
    return studies.flow_errors(v.where("bus_id % 10 <> 0").select("bus_id", (F.col("vm") + (F.col("bus_id") % 5).cast("double") / 100).alias("vm"), (F.col("va") * 1.01).alias("va")), v)


@query("SELECT round((SELECT max(greatest(0.95::DOUBLE - vm, vm - 1.05::DOUBLE, 0)) FROM voltages), 6) AS max_vm_violation_pu, round((SELECT max(greatest(pmin_mw - (pmax_mw + id % 3), id % 3, 0)) FROM generators), 6)::DOUBLE AS max_p_violation_mw, round((SELECT max(greatest(abs(flow_mw) - flow_limit, 0)) FROM flows JOIN limits USING (branch_id)), 6) AS max_branch_flow_violation_mva", ("voltages", "generators", "flows", "limits"))
def opf_violation_metrics(g: Grid) -> DataFrame:
    v = g.voltages.withColumns({"vmin": F.lit(0.95), "vmax": F.lit(1.05)})
    u = g.generators.select((F.col("pmax_mw") + F.col("id") % 3).alias("p"), F.col("pmin_mw").alias("pmin"), F.col("pmax_mw").alias("pmax"))
    return studies.limit_excess(v, u, g.flows.join(g.limits, "branch_id").select(F.col("flow_mw").alias("s"), F.col("flow_limit").alias("limit")))


@query("SELECT contingency, round(abs(max_loading - violations), 6) AS gap_abs, round(CASE WHEN violations > 0 THEN abs(max_loading - violations) / violations ELSE 0 END, 6) AS gap_rel FROM evaluations", ("evaluations",))
def objective_gap(g: Grid) -> DataFrame:
    a, r = studies.objective_gap(F.col("max_loading"), F.col("violations"))
    return g.evaluations.select("contingency", a.alias("gap_abs"), r.cast("double").alias("gap_rel"))


@query("SELECT case_id, count(*) AS n, round(max(abs(va)), 6) AS max_abs, CASE WHEN avg(CASE WHEN abs(va) > 1.5 THEN 1.0 ELSE 0 END) > 0.3 THEN 'degrees' WHEN avg(CASE WHEN abs(va) < 1 THEN 1.0 ELSE 0 END) > 0.9 AND max(abs(va)) < 2 THEN 'radians' ELSE 'unknown' END AS unit FROM (SELECT case_id, va * (case_id % 4) AS va FROM voltages) v GROUP BY 1", ("voltages",))
def angle_units(g: Grid) -> DataFrame:
    return studies.angle_unit(g.voltages.withColumn("va", F.col("va") * (F.col("case_id") % 4)), ["case_id"], "unknown")


@query("WITH a AS (SELECT list(se_time_ms ORDER BY se_time_ms) AS v, count(*) AS n, avg(mae_deg) AS m, stddev_pop(mae_deg) AS s, avg(rmse_deg) AS r, avg(max_error_deg) AS e, avg(se_time_ms) AS t FROM trials WHERE converged), b AS (SELECT count(*) AS total FROM trials) SELECT total AS total_trials, n AS converged_trials, round(m, 6) AS mean_mae_deg, round(s, 6) AS std_mae_deg, round(r, 6) AS mean_rmse_deg, round(e, 6) AS mean_max_error_deg, round(t, 6) AS mean_se_time_ms, v[n // 2 + 1] AS median_se_time_ms, v[least(floor(n * 0.95::DOUBLE)::BIGINT, n - 1) + 1] AS p95_se_time_ms, round(n::DOUBLE / total, 6) AS convergence_rate FROM a, b", ("trials",))
def se_study_summary(g: Grid) -> DataFrame:
    return studies.estimation_summary(g.trials)


FRAMES = "SELECT timestamp, CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 25 + 1 AS BIGINT) END AS bus_id, concat('st', CAST(user_id % 8 AS VARCHAR(9))) AS station, value FROM series"


@query(f"SELECT timestamp, station, coalesce(f.bus_id, s.bus_id) AS bus_id, round(value, 6) AS value FROM ({FRAMES}) f LEFT JOIN (SELECT 'st0' AS station, 1::BIGINT AS bus_id UNION ALL SELECT 'st3', 9) s USING (station) WHERE coalesce(f.bus_id, s.bus_id) IS NOT NULL", ("series",))
def pmu_stations(g: Grid) -> DataFrame:
    stations = g.spark.createDataFrame([("st0", 1), ("st3", 9)], "station string, bus_id long")
    return studies.stations_to_buses(_sql(g, FRAMES, "series"), stations).select("timestamp", "station", "bus_id", "value")


@query(f"SELECT timestamp, count(*) AS n_frames, count(DISTINCT station) AS n_stations FROM ({FRAMES}) f GROUP BY 1", ("series",))
def pmu_snapshots(g: Grid) -> DataFrame:
    return _sql(g, FRAMES, "series").groupBy("timestamp").agg(F.count("*").alias("n_frames"), F.count_distinct("station").alias("n_stations")).orderBy("timestamp")


@query("SELECT timestamp % 50 AS snapshot, round(sum(w * r * r), 6) AS chi2, count(*) AS n FROM (SELECT timestamp, 1 + user_id % 3 AS w, CASE user_id % 3 WHEN 0 THEN value - (user_id % 25 + 1) * 0.1::DOUBLE WHEN 1 THEN value - 1 ELSE 0 END AS r FROM series) x GROUP BY 1", ("series",))
def chi2(g: Grid) -> DataFrame:
    m = g.series.select((F.col("timestamp") % 50).alias("snapshot"), F.element_at(F.array(F.lit("angle"), F.lit("voltage"), F.lit("flow")), (F.col("user_id") % 3 + 1).cast("int")).alias("type"), (F.col("user_id") % 25 + 1).alias("bus_id"), "value", (1 + F.col("user_id") % 3).alias("weight"))
    return studies.chi_square(studies.residuals(m, g.buses.select(F.col("id").alias("bus_id"), (F.col("id") * 0.1).alias("angle_rad"))), ["snapshot"])


def _measured(g: Grid) -> DataFrame:
    m = g.branches.where("status").select("id", F.lit("flow").alias("type"), F.col("id").alias("branch_id"), F.lit(None).cast("long").alias("bus_id"), (F.col("id") % 9 - 4).cast("double").alias("value"), F.lit(2.0).alias("weight"))
    return m.unionAll(g.buses.select(F.col("id") + 1000, F.lit("injection"), F.lit(None).cast("long"), "id", (F.col("id") % 5 - 2).cast("double"), F.lit(1.0)))


@query("SELECT id AS bus, 0.0::DOUBLE AS gradient FROM buses WHERE id > 1", ("buses",))
def wls_residuals(g: Grid) -> DataFrame:
    """At the estimate the weighted residuals are orthogonal to each bus angle: every gradient is 0."""
    r = studies.estimate(g.buses, g.branches, _measured(g))
    e = g.branches.where("status").select(F.col("id").alias("line"), "from_bus", "to_bus", (1 / F.col("reactance_pu")).alias("y"))
    flow = r.where("type = 'flow'").join(e, F.col("branch_id") == F.col("line")).select((F.col("weight") * F.col("residual") * F.col("y")).alias("v"), "from_bus", "to_bus")
    into = lambda s, d: d.select(F.col(s).alias("bus"), (F.col("v") if s == "from_bus" else -F.col("v")).alias("v"))
    inj = r.where("type = 'injection'").select("bus_id", (F.col("weight") * F.col("residual")).alias("w"))
    a = inj.join(e, F.col("bus_id") == F.col("from_bus")).select((F.col("w") * F.col("y")).alias("v"), "from_bus", "to_bus")
    b = inj.join(e, F.col("bus_id") == F.col("to_bus")).select((-F.col("w") * F.col("y")).alias("v"), "from_bus", "to_bus")
    rows = flow.unionAll(a).unionAll(b)
    return into("from_bus", rows).unionAll(into("to_bus", rows)).where("bus > 1").groupBy("bus").agg(F.abs(F.round(F.sum("v"), 5)).alias("gradient"))


@query("SELECT c.area_a AS area, corridor_id, capacity_mw FROM corridors c UNION SELECT area_b, corridor_id, capacity_mw FROM corridors", ("corridors",))
def area_corridors(g: Grid) -> DataFrame:
    return studies.corridors_of(g.buses.select(F.col("area_id").alias("area")).distinct(), g.corridors)


@query("SELECT DISTINCT x.day, least(x.area, y.area) AS area_a, greatest(x.area, y.area) AS area_b FROM windows x JOIN windows y ON x.day = y.day AND x.area < y.area WHERE EXISTS (SELECT 1 FROM corridors c WHERE (c.area_a = x.area AND c.area_b = y.area) OR (c.area_a = y.area AND c.area_b = x.area))", ("windows", "corridors"))
def maintenance_conflicts(g: Grid) -> DataFrame:
    return studies.maintenance_conflicts(g.windows, g.corridors)


UNIFORM = "('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE"
MC = f"WITH s AS (SELECT unnest(range(200)) AS sample), u AS (SELECT area_id AS area, sample, sum(CASE WHEN {UNIFORM.format("'1:' || sample || ':' || g.id")} >= 0.05::DOUBLE THEN pmax_mw ELSE 0 END) AS have FROM generators g JOIN buses b ON b.id = g.bus, s WHERE g.status GROUP BY 1, 2), n AS (SELECT area_id AS area, sum(active_power_mw * 20) AS need FROM loads l JOIN buses b ON b.id = l.bus GROUP BY 1), x AS (SELECT n.area, greatest(need - coalesce(have, 0), 0) AS short FROM n CROSS JOIN s LEFT JOIN u ON u.area = n.area AND u.sample = s.sample), a AS (SELECT area, avg(CASE WHEN short > 0 THEN 1.0::DOUBLE ELSE 0 END) * 8766 AS lole_hours, avg(short) * 8766 AS eue_mwh FROM x GROUP BY 1) "


def _areas(g: Grid) -> DataFrame:
    at = g.buses.select(F.col("id").alias("bus"), F.col("area_id").alias("area"))
    return studies.monte_carlo(g.generators.join(at, "bus"), g.loads.join(at, "bus").withColumn("active_power_mw", F.col("active_power_mw") * 20), 200, keys=("area",))


@query(MC + "SELECT area, round(lole_hours, 6) AS lole_hours, round(eue_mwh, 6) AS eue_mwh FROM a", ("generators", "buses", "loads"))
def monte_carlo_areas(g: Grid) -> DataFrame:
    return _areas(g)


@query(MC + "SELECT round(max(lole_hours), 6) AS system_lole, round(sum(eue_mwh), 6) AS system_eue, count(*) AS n_areas FROM a", ("generators", "buses", "loads"))
def multiarea_system(g: Grid) -> DataFrame:
    return studies.multiarea(_areas(g))


@query(MC + "SELECT round(sum(lole_hours), 6) AS baseline_lole, round(sum(lole_hours) + 0.4::DOUBLE * avg(lole_hours), 6) AS peak_lole, 10.0::DOUBLE AS eue_reduction_pct FROM a", ("generators", "buses", "loads"))
def maintenance_peak_lole(g: Grid) -> DataFrame:
    return studies.peak_lole(_areas(g), 2)


@query(f"WITH e AS (SELECT *, row_number() OVER (ORDER BY element_id) - 1 AS k FROM elements), s AS (SELECT floor({UNIFORM.format("'1:' || i || ':element'")} * (SELECT count(*) FROM e)) AS k, floor({UNIFORM.format("'1:' || i || ':outages'")} * 3) + 1 AS o FROM (SELECT unnest(range(2000)) AS i) r) SELECT count(*) AS samples, round(avg(failure_rate * repair_hours * o), 6) AS mean_lost, round(avg(o), 6) AS mean_outages FROM s JOIN e USING (k)", ("elements",))
def outage_mc(g: Grid) -> DataFrame:
    return studies.outage_sampling(numbered(g.elements, by_id("element_id"), ["element_id"], "k"), 2000)


@query("SELECT contingency, round(p, 6) AS score, CASE WHEN p >= 90 THEN 'Excellent' WHEN p >= 80 THEN 'Good' WHEN p >= 70 THEN 'Fair' WHEN p >= 60 THEN 'Poor' ELSE 'Critical' END AS band, CASE WHEN p < 80 THEN 0.1 WHEN p < 90 THEN 0.5 ELSE 0.6 END::DOUBLE AS loss_weight FROM (SELECT contingency, 100 * (1 - 0.6::DOUBLE * least(load_shed_mw * 2 / 10, 1)) AS p FROM evaluations) x", ("evaluations",))
def vvo_weights(g: Grid) -> DataFrame:
    p = studies.score(F.col("load_shed_mw") * 2)
    return g.evaluations.select("contingency", p.alias("score"), studies.band(p).alias("band"), studies.loss_weight(p).alias("loss_weight"))


@query("SELECT contingency, round(CASE WHEN load_shed_mw > 0 THEN 100 * greatest(load_shed_mw - max_loading, 0) / load_shed_mw ELSE 0 END, 6) AS reduction_pct, round(CASE WHEN load_shed_mw > 0 THEN greatest((load_shed_mw - max_loading) / load_shed_mw, 0) ELSE 0 END, 6) AS effectiveness, load_shed_mw > 0 AND (load_shed_mw - max_loading) / load_shed_mw > 0.5 AS effective FROM evaluations", ("evaluations",))
def flisr_effect(g: Grid) -> DataFrame:
    a, b, c = studies.restoration(F.col("load_shed_mw"), F.col("max_loading"))
    return g.evaluations.select("contingency", a.alias("reduction_pct"), b.alias("effectiveness"), c.alias("effective"))


@query("SELECT 'solar' AS class_id, 0.8::DOUBLE AS elcc_mean, 0.75::DOUBLE AS elcc_ci_lo, 0.85::DOUBLE AS elcc_ci_hi UNION ALL SELECT 'wind', 0.7, 0.65, 0.75 UNION ALL SELECT 'storage', 0.9, 0.85, 0.95")
def elcc_constants(g: Grid) -> DataFrame:
    return studies.elcc_table(g.scenarios)


@query("SELECT from_bus AS bus, to_bus AS neighbour, round(1 / reactance_pu, 6) AS susceptance FROM branches UNION ALL SELECT to_bus, from_bus, round(1 / reactance_pu, 6) FROM branches", ("branches",))
def adjacency_susceptance(g: Grid) -> DataFrame:
    return studies.adjacency(g.branches)


E_ = "WITH e AS (SELECT from_bus AS f, to_bus AS t, 1 / reactance_pu AS y FROM branches WHERE status), m AS (SELECT i, j, sum(v) AS b FROM (SELECT f AS i, f AS j, y AS v FROM e UNION ALL SELECT t, t, y FROM e UNION ALL SELECT f, t, -y FROM e UNION ALL SELECT t, f, -y FROM e) u GROUP BY 1, 2) "


@query(E_ + "SELECT i, round(sum(b * j * 0.01::DOUBLE), 6) AS v FROM m GROUP BY 1", ("branches",))
def sparse_matvec(g: Grid) -> DataFrame:
    return studies.matvec(network.b_prime(g.branches), g.buses.select(F.col("id").alias("j"), (F.col("id") * 0.01).alias("x")))


@query(E_ + "SELECT (SELECT count(DISTINCT i) FROM m) AS n, count(*) AS nnz, round(count(*)::DOUBLE / ((SELECT count(DISTINCT i) FROM m) ** 2), 6) AS density FROM m WHERE b <> 0", ("branches",))
def sparse_density(g: Grid) -> DataFrame:
    return studies.density(network.b_prime(g.branches))


@query("WITH RECURSIVE e AS (SELECT from_bus AS a, to_bus AS b FROM branches WHERE status AND abs(from_bus - to_bus) = 5 UNION SELECT to_bus, from_bus FROM branches WHERE status AND abs(from_bus - to_bus) = 5), reach AS (SELECT id AS bus, id AS o FROM buses UNION SELECT r.bus, e.b FROM reach r JOIN e ON e.a = r.o), fed AS (SELECT DISTINCT r.bus FROM reach r JOIN generators u ON u.bus = r.o WHERE u.status AND u.pmax_mw > 60) SELECT bus, round(sum(active_power_mw), 6) AS active_power_mw FROM loads WHERE bus NOT IN (SELECT bus FROM fed) GROUP BY 1", ("branches", "buses", "generators", "loads"))
def unserved_load_buses(g: Grid) -> DataFrame:
    roots = network.islands(g.buses, g.branches.where(F.abs(F.col("from_bus") - F.col("to_bus")) == 5), in_service_only=True)
    return studies.unserved_buses(roots, g.generators.where("pmax_mw > 60"), g.loads)


@query()
def partition_load_balanced(g: Grid) -> DataFrame:
    return studies.load_balanced(g.loads, 4)


@query("SELECT 12.0::DOUBLE AS out_of_source, 12.0::DOUBLE AS into_sink")
def ptdf_transfer(g: Grid) -> DataFrame:
    """All of a transfer leaves its source and enters its sink."""
    t = market.transfer(kernels.ptdf(g.buses, g.branches), 3, 17, 12.0).join(g.branches.select(F.col("id").alias("branch_id"), "from_bus", "to_bus"), "branch_id")
    net = lambda bus: F.sum(F.when(F.col("from_bus") == bus, F.col("flow_mw")).when(F.col("to_bus") == bus, -F.col("flow_mw")).otherwise(0.0))
    return t.agg(net(3).alias("out_of_source"), (-net(17)).alias("into_sink"))


@query("SELECT b.id AS branch_m, x.id AS bus, 0.0::DOUBLE AS residual FROM branches b, buses x WHERE b.status AND x.id > 1", ("branches", "buses"))
def lodf_kcl_residual(g: Grid) -> DataFrame:
    """After each single outage the estimated flows still balance the injections of every bus but the slack: a check of every factor off the diagonal."""
    d = g.generators.where("status").select("bus", (F.col("pmax_mw") / 10).alias("pmax_mw"))
    inj = network.injections(d, g.loads)
    f = kernels.dc_flow(g.buses, g.branches, inj)
    left = studies.after_outage(dispatch.lodf(kernels.ptdf(g.buses, g.branches), g.branches), f).join(g.branches.select(F.col("id").alias("branch_l"), "from_bus", "to_bus"), "branch_l")
    out = left.select("branch_m", F.col("from_bus").alias("bus"), F.col("flow_mw").alias("p")).unionAll(left.select("branch_m", "to_bus", -F.col("flow_mw")))
    cases = g.branches.where("status").select(F.col("id").alias("branch_m"))
    rows = out.unionAll(cases.crossJoin(inj).select("branch_m", "bus", -F.col("injection_mw")))
    return rows.where("bus > 1").groupBy("branch_m", "bus").agg(F.abs(F.round(F.sum("p"), 4)).alias("residual"))


@query()
def hosting_capacity(g: Grid) -> DataFrame:
    d = g.generators.where("status").select("bus", (F.col("pmax_mw") / 10).alias("pmax_mw"))
    f = kernels.dc_flow(g.buses, g.branches, network.injections(d, g.loads))
    return studies.hosting(g.buses, g.limits, kernels.ptdf(g.buses, g.branches), f, 10, 200.0)


@query("SELECT id, round(1 * cos(0) * 0, 6) AS zero, round(g * (1 - 0.98::DOUBLE * cos(d)) - 0.98::DOUBLE * b * sin(d), 6) AS p, round(-b * (1 - 0.98::DOUBLE * cos(d)) - 0.98::DOUBLE * g * sin(d), 6) AS q FROM (SELECT id, resistance_pu / (resistance_pu ** 2 + reactance_pu ** 2) AS g, -reactance_pu / (resistance_pu ** 2 + reactance_pu ** 2) AS b, (id % 10) * 0.01::DOUBLE AS d FROM branches) x", ("branches",))
def branch_terminal_flows(g: Grid) -> DataFrame:
    p, q = studies.terminal_flow(F.col("resistance_pu"), F.col("reactance_pu"), F.lit(1.0), F.lit(0.98), (F.col("id") % 10) * 0.01, F.lit(0.0))
    return g.branches.select("id", F.lit(0.0).alias("zero"), p.alias("p"), q.alias("q"))


@query("SELECT id, round(c1 + 0.02::DOUBLE * pmax_mw + 0.0003::DOUBLE * pmax_mw ** 2, 6) AS marginal FROM generators", ("generators",))
def cost_marginal(g: Grid) -> DataFrame:
    return g.generators.select("id", studies.marginal_cost(F.array("c0", "c1", F.lit(0.01), F.lit(0.0001)), F.col("pmax_mw")).alias("marginal"))


@query("SELECT id, round(sqrt(p * p + q * q), 6) AS s, round(p / sqrt(p * p + q * q), 6) AS pf, round(p / 138, 6) AS pu, CASE WHEN p = floor(p) THEN p::BIGINT END AS whole FROM (SELECT id, CAST(id % 9 - 4 AS DOUBLE) * CASE WHEN id % 2 = 0 THEN 1 ELSE 1.5::DOUBLE END AS p, CAST(id % 5 + 1 AS DOUBLE) AS q FROM branches) x", ("branches",))
def unit_conversions(g: Grid) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    d = g.branches.select("id", ((F.col("id") % 9 - 4).cast("double") * F.when(F.col("id") % 2 == 0, 1.0).otherwise(1.5)).alias("p"), (F.col("id") % 5 + 1).cast("double").alias("q"))
    return d.select("id", units.apparent_power(p, q).alias("s"), units.power_factor(p, q).alias("pf"), units.to_per_unit(p, F.lit(138.0)).alias("pu"), units.whole_number(p).alias("whole"))


@query("SELECT p_partkey AS dataset, p_type AS tag FROM part WHERE p_type LIKE '%STEEL%' OR p_brand = 'Brand#11'")
def catalog_filter(g: Grid) -> DataFrame:
    d = g.star("part")
    return d.where(F.contains(F.col("p_type"), F.lit("STEEL")) | (F.col("p_brand") == "Brand#11")).select(F.col("p_partkey").alias("dataset"), F.col("p_type").alias("tag"))


@query("SELECT id, bus FROM generators WHERE bus = 3 UNION ALL SELECT -id, bus FROM loads WHERE bus = 3", ("generators", "loads"))
def devices_at_bus(g: Grid) -> DataFrame:
    return g.generators.where("bus = 3").select("id", "bus").unionAll(g.loads.where("bus = 3").select(-F.col("id"), "bus"))


@query("SELECT DISTINCT coalesce(zone_id, area_id, 0) AS zone FROM buses", ("buses",))
def distinct_zones(g: Grid) -> DataFrame:
    return g.buses.select(F.coalesce("zone_id", "area_id", F.lit(0)).alias("zone")).distinct()


@query("SELECT branch_id, flow_mw, round(coalesce(flow_mw / 25, 0), 6) AS ptdf FROM (SELECT branch_id, sum(flow_mw) AS flow_mw FROM flows GROUP BY 1) x", ("flows",))
def derived_ptdf(g: Grid) -> DataFrame:
    f = g.flows.groupBy("branch_id").agg(F.sum("flow_mw").alias("flow_mw"))
    return f.withColumn("ptdf", F.coalesce(F.col("flow_mw") / 25.0, F.lit(0.0)))


@query()
def gnn_json(g: Grid) -> DataFrame:
    nodes = fleet.gnn_nodes(g.buses, g.generators, g.loads)
    graphs = fleet.gnn_graphs(g.flows)
    return studies.graph_json(nodes, fleet.gnn_edges(g.flows, g.branches, graphs, nodes), graphs)


PRICE = "SELECT (timestamp // 3600) % 24 AS hour, round(avg(value), 3) AS price FROM series GROUP BY 1"


@query(f"WITH h AS ({PRICE}), m AS (SELECT median(price) AS m FROM h), r AS (SELECT sum(CASE WHEN price >= m THEN price ELSE 0 END) AS dear, sum(CASE WHEN price < m THEN price ELSE 0 END) AS cheap FROM h, m), s AS (SELECT i AS scenario, 0.8::DOUBLE + 0.4::DOUBLE * {UNIFORM.format("'1:' || i")} AS scale FROM (SELECT unnest(range(20)) AS i) x) SELECT scenario, asset_id, round(scale * (p_min * dear + p_max * cheap), 6) AS cost FROM assets, r, s", ("series", "assets"))
def derms_stress(g: Grid) -> DataFrame:
    hours = g.series.groupBy(F.expr("(timestamp div 3600) % 24").alias("hour")).agg(F.round(F.avg("value"), 3).alias("price"))
    return studies.price_stress(g.assets, hours, 20)
