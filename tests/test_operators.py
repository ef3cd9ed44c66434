import numpy as np
import pytest

from gridloom.functions import capital_recovery, power_factor
from gridloom.operators import dispatch, kernels, network, timeseries
from gridloom.sources import parse_matpower, read_matpower, read_pmu_csv, read_table, write_table
from gridloom.streaming import resample_stream

THREE_BUS = ([(1,), (2,), (3,)], [(1, 1, 2, 0.1, 0.0, 1.0, True), (2, 2, 3, 0.1, 0.0, 1.0, True), (3, 1, 3, 0.1, 0.0, 1.0, True)])


def three(spark):
    b = spark.createDataFrame(THREE_BUS[0], "id long")
    e = spark.createDataFrame(THREE_BUS[1], "id long, from_bus long, to_bus long, reactance_pu double, resistance_pu double, tap_ratio double, status boolean")
    return b, e


def test_resample_negative(spark):
    d = spark.createDataFrame([(-7, 1.0), (-1, 3.0), (4, 5.0), (None, 1.0), (3, None)], "timestamp long, value double")
    got = {r[0]: (r[1], r[2]) for r in timeseries.resample(d, "5s").collect()}
    assert got == {-10: (1, 1.0), -5: (1, 3.0), 0: (1, 5.0)}


@pytest.mark.parametrize("rule", ["0s", "-1s", "x", "1d", ""])
def test_bad_rule(rule):
    with pytest.raises(ValueError):
        timeseries.seconds(rule)


def test_bad_aggregate(spark):
    with pytest.raises(ValueError):
        timeseries.aggregate(spark.range(1), agg="mode")


def test_dc_flow_of_three_buses(spark):
    b, e = three(spark)
    inj = spark.createDataFrame([(1, 90.0), (3, -90.0)], "bus long, injection_mw double")
    got = {r.branch_id: round(r.flow_mw, 6) for r in kernels.dc_flow(b, e, inj).collect()}
    assert got == {1: 30.0, 2: 30.0, 3: 60.0}


def test_ptdf_and_lodf(spark):
    b, e = three(spark)
    p = kernels.ptdf(b, e)
    assert all(r.ptdf == 0 for r in p.where("bus_id = 1").collect())
    f = {(r.branch_l, r.branch_m): round(r.lodf, 6) for r in dispatch.lodf(p, e).collect()}
    assert f[1, 1] == -1 and abs(abs(f[1, 3]) - 1) < 1e-6


def test_newton_balances():
    y = np.array([[10 - 30j, -10 + 30j], [-10 + 30j, 10 - 30j]])
    vm, va, _, worst = kernels.newton(y, np.array([0, -0.5]), np.array([0, -0.1]), np.ones(2), ["slack", "pq"])
    assert worst < 1e-8 and vm[1] < 1 and va[1] < 0


def test_islands(spark):
    b = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    e = spark.createDataFrame([(1, 5, 4, True), (2, 1, 2, True), (3, 2, 3, False)], "id long, from_bus long, to_bus long, status boolean")
    assert {r.bus: r.island for r in network.islands(b, e).collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 2}
    assert {r.bus: r.island for r in network.islands(b, e, True).collect()} == {1: 0, 2: 0, 3: 1, 4: 2, 5: 2, 6: 3}


def test_functions(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(power_factor(F.lit(3.0), F.lit(4.0)).alias("a"), capital_recovery(F.lit(0.0), F.lit(10.0)).alias("b")).first()
    assert r.a == 0.6 and r.b == 0.1


def test_matpower(spark, tmp_path):
    text = "mpc.baseMVA = 100;\nmpc.bus = [\n1 3 0 0 0 0 1 1 0 138 1 1.1 0.9;\n2 1 50 10 0 0 1 1 30 138 1 1.1 0.9; % a load\n];\nmpc.gen = [1 40 0 30 -30 1 100 1 80 10];\nmpc.branch = [1 2 0.01 0.1 0.02 100 0 0 0 0 1; 1 2 0.01 0.1 0 0 0 0 0 0 0];\nmpc.gencost = [2 0 0 3 0.1 5 7];\n"
    assert parse_matpower(text)["base_mva"] == 100
    (tmp_path / "c.m").write_text(text)
    t = read_matpower(spark, str(tmp_path / "c.m"))
    assert {k: d.count() for k, d in t.items()} == {"cases": 1, "shunts": 0, "buses": 2, "loads": 1, "generators": 1, "branches": 1}
    assert t["branches"].first().tap_ratio == 1.0 and t["generators"].first().cost_coeffs == [7.0, 5.0, 0.1]


def test_tables(spark, tmp_path):
    p = str(tmp_path / "t.parquet")
    write_table(spark.range(4).selectExpr("id", "id % 2 as k"), p, ["k"])
    assert read_table(spark, p).where("k = 1").count() == 2
    with pytest.raises(ValueError):
        read_table(spark, "x.txt")
    (tmp_path / "p.csv").write_text("Timestamp,VM\n5,bad\n1,1.02\n")
    assert [(r.timestamp, r.vm, r.frequency) for r in read_pmu_csv(spark, str(tmp_path / "p.csv")).collect()] == [(1, 1.02, 60.0), (5, 1.0, 60.0)]


def test_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 1D value union all select timestamp'2024-01-01 00:50:00', 3D").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = resample_stream(s).writeStream.format("memory").queryName("resampled").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("resampled").first()
    assert (r["count"], r.mean_value) == (2, 2.0)
