import pandas as pd
import pytest

from gridloom.functions import units
from gridloom.operators import checks, market, network, scenario, studies
from gridloom.operators.order import by_id, components, numbered


def test_islands_of_long_chains(spark):
    n = 300
    b = spark.range(1, 2 * n + 1).select("id")
    e = spark.createDataFrame([(i, i + 1, True) for i in range(1, 2 * n) if i != n], "from_bus long, to_bus long, status boolean")
    got = {r.bus: r.island for r in network.islands(b, e).collect()}
    assert got == {i: int(i > n) for i in range(1, 2 * n + 1)}


def test_components_in_shuffled_order(spark):
    chain = [(k * 37) % 101 for k in range(101)]
    e = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)) + [(200, 201), (201, 200), (300, 300)], "a long, b long")
    got = {r.node: r.root for r in components(spark.createDataFrame([(i,) for i in [*range(101), 200, 201, 300]], "node long"), e).collect()}
    assert got == {i: 0 for i in range(101)} | {200: 200, 201: 200, 300: 300}


def test_numbers_run_over_buckets(spark):
    d = spark.createDataFrame([(i * 3,) for i in range(50)] + [(None,)], "id long")
    got = [r.k for r in numbered(d, by_id("id", 20), ["id"], "k").orderBy("id").collect()]
    assert got == list(range(51))


def test_dispatch_with_segments_is_the_optimum(spark):
    limits = spark.createDataFrame([(0, 0.0, 5.0, 1.5), (1, 1.0, 6.0, 6.0)], "bus_id long, pmin double, pmax double, demand double")
    costs = spark.createDataFrame([(0, 12.5), (1, 15.0)], "bus_id long, marginal_cost double")
    seg = spark.createDataFrame([(0, 0.0, 3.0, 11.0), (0, 3.0, 5.0, 13.5), (1, 0.0, 4.0, 14.0), (1, 4.0, 6.0, 16.0)], "bus_id long, start double, end double, slope double")
    got = {r.bus_id: (r.dispatch_mw, r.price, r.short_mw) for r in market.dispatch(limits, costs, seg).collect()}
    assert got == {0: (5.0, 14.0, 0.0), 1: (2.5, 14.0, 0.0)}
    got = {r.bus_id: (r.dispatch_mw, r.short_mw) for r in market.dispatch(limits.withColumn("demand", market.F.lit(6.0)), costs).collect()}
    assert got == {0: (5.0, 1.0), 1: (6.0, 1.0)}
    assert market.segment_findings(limits, seg).count() == 0


def test_segments_that_do_not_cover(spark):
    limits = spark.createDataFrame([(0, 0.0, 9.0, 1.0)], "bus_id long, pmin double, pmax double, demand double")
    seg = spark.createDataFrame([(0, 1.0, 3.0, 1.0), (0, 4.0, 5.0, 2.0), (0, 4.5, 6.0, 2.0), (0, 6.0, 6.0, 2.0)], "bus_id long, start double, end double, slope double")
    assert {r.problem for r in market.segment_findings(limits, seg).collect()} == {"starts above pmin", "gap", "overlap", "empty segment", "ends below pmax"}


def test_batch_keeps_errors_apart(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 0.0)], "scenario_id string, v double")

    def study(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"r": [1 / int(x) for x in g.v]})

    got = scenario.run_batch(d, study, "r double").collect()
    assert sorted(r.r for r in got if r.status == "ok") == [0.5, 1.0]
    assert [(r.scenario_id, r.error[:17]) for r in got if r.status == "error"] == [("b", "ZeroDivisionError")]
    m = scenario.batch_manifest(scenario.run_batch(d, study, "r double")).first()
    assert (m.n_jobs, m.n_ok, m.n_failed) == (2, 1, 1)


def test_scenario_without_slices_raises(spark):
    d = spark.createDataFrame([("a", None)], "scenario_id string, time_slices array<string>")
    with pytest.raises(Exception, match="no time slice"):
        scenario.resolve(d, {}).collect()


def test_estimate_of_consistent_measurements(spark):
    b = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    e = spark.createDataFrame([(1, 1, 2, 0.1, 1.0, True), (2, 2, 3, 0.1, 1.0, True), (3, 1, 3, 0.1, 1.0, True)], "id long, from_bus long, to_bus long, reactance_pu double, tap_ratio double, status boolean")
    m = spark.createDataFrame([(1, "flow", 1, None, 30.0, 1.0), (2, "flow", 2, None, 30.0, 1.0), (3, "injection", None, 1, 90.0, 2.0), (4, "angle", None, 2, -3.0, 1.0), (5, "voltage", None, 2, 1.0, 1.0)], "id long, type string, branch_id long, bus_id long, value double, weight double")
    got = {r.id: r.residual for r in studies.estimate(b, e, m).collect()}
    assert all(abs(got[i]) < 1e-9 for i in (1, 2, 3, 4)) and got[5] is None


def test_power_factor_keeps_its_sign(spark):
    d = spark.createDataFrame([(-3.0, 4.0), (0.0, 0.0), (3.0, -4.0)], "p double, q double")
    assert [r[0] for r in d.select(units.power_factor(d.p, d.q)).collect()] == [-0.6, 1.0, 0.6]
    v = spark.createDataFrame([(1.0,), (1.5,), (float("nan"),), (1e30,), (-7.0,)], "v double")
    assert [r[0] for r in v.select(units.whole_number(v.v)).collect()] == [1, None, None, None, -7]
    assert [r[0] for r in v.select(units.whole_number(v.v, 32, signed=False)).collect()] == [1, None, None, None, None]


def test_greedy_parts(spark):
    d = spark.createDataFrame([(1, 9.0), (2, 5.0), (3, 5.0), (4, 1.0)], "bus long, active_power_mw double")
    assert {r.bus: r.part for r in studies.load_balanced(d, 2).collect()} == {1: 0, 2: 1, 3: 1, 4: 0}


def test_empty_tables(spark):
    z = spark.createDataFrame([], "id long, bus long, pmin_mw double, pmax_mw double, active_power_mw double, status boolean")
    assert [r.message for r in checks.balance(z, z).collect()] == ["no load"]
    assert studies.estimation_summary(spark.createDataFrame([], "converged boolean, mae_deg double, rmse_deg double, max_error_deg double, se_time_ms double")).count() == 1
