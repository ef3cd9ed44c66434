"""Network files."""

import json

import pytest

from gridloom.sources import detect_format, read_matpower, read_powermodels, write_powermodels

CASE = {
    "baseMVA": 50.0,
    "per_unit": True,
    "bus": {"1": {"index": 1, "bus_type": 3, "base_kv": 0, "vm": 1.02, "va": 0.1, "area": 2}, "2": {"index": 2, "name": "north", "base_kv": 230.0}},
    "gen": {"1": {"index": 1, "gen_bus": 1, "pg": 0.5, "pmax": 1.0, "model": 2, "cost": [0.1, 20.0, 3.0]}, "2": {"index": 2, "gen_bus": 2, "gen_status": 0, "model": 1, "cost": [0.0, 0.0, 1.0, 9.0, 7.0]}, "3": {"index": 3, "gen_bus": 9}},
    "load": {"1": {"index": 1, "load_bus": 2, "pd": 0.4, "qd": 0.1}},
    "shunt": {"1": {"index": 1, "shunt_bus": 2, "bs": 0.19}},
    "branch": {"1": {"index": 1, "f_bus": 1, "t_bus": 2, "br_r": 0.01, "br_x": 0.1, "b_fr": 0.01, "b_to": 0.03, "tap": 0.0, "rate_a": 1.5}, "2": {"index": 2, "f_bus": 1, "t_bus": 8, "transformer": True}},
}


@pytest.fixture
def cases(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text(json.dumps(CASE, indent=1))
    return read_powermodels(spark, str(tmp_path / "in"))


def test_powermodels_tables(cases):
    assert set(map(tuple, cases["cases"].collect())) == {("a.json", 50.0, True), ("b.json", 50.0, True)}
    buses = {r.id: r for r in cases["buses"].where("case = 'a.json'").collect()}
    assert (buses[1].name, buses[1].voltage_kv, buses[1].voltage_pu, buses[2].name, buses[2].voltage_kv) == ("Bus_1", 138.0, 1.02, "north", 230.0)
    gens = {r.id: r for r in cases["generators"].where("case = 'b.json'").collect()}
    assert (gens[1].cost_coeffs, gens[1].status, gens[2].cost_coeffs, gens[2].cost_values, gens[2].status) == ([3.0, 20.0, 0.1], True, [], [0.0, 0.0, 1.0, 9.0], False)
    branch = cases["branches"].where("case = 'a.json'").first()
    assert (branch.id, branch.tap_ratio, round(branch.charging_b_pu, 9), branch.element_type, branch.status) == (1, 1.0, 0.04, "line", True)
    assert sorted(map(tuple, cases["skipped"].where("case = 'a.json'").collect())) == [("a.json", "branch", 2, 8), ("a.json", "generator", 3, 9)]


def test_powermodels_round_trip(spark, cases, tmp_path):
    write_powermodels(cases, str(tmp_path / "out"))
    again = read_powermodels(spark, str(tmp_path / "out"))
    for name in ("cases", "buses", "generators", "loads", "shunts", "branches"):
        rows = lambda t: sorted(map(repr, t[name].drop("case").collect()))  # noqa: E731, B023
        assert rows(cases) == rows(again), name


@pytest.mark.parametrize("name, text, want", [("a.json", json.dumps(CASE), ("powermodels", "high")), ("a.json", '{"_module": "pandapower.auxiliary", "_class": "pandapowerNet"}', ("pandapower", "high")), ("a.JSON", "{}", ("pandapower", "low")), ("a.xml", '<rdf:RDF xmlns:cim="x"><cim:Line/></rdf:RDF>', ("cim", "high")), ("a.xml", "<a/>", ("cim", "low")), ("a.m", "", ("matpower", "medium")), ("a.raw", "0", ("psse", "medium")), ("a.txt", "", None)])
def test_detection(spark, tmp_path, name, text, want):
    (tmp_path / name).write_text(text)
    assert detect_format(spark, str(tmp_path / name)) == want


def test_matpower_shunts(spark, tmp_path):
    (tmp_path / "c.m").write_text("mpc.baseMVA = 50;\nmpc.bus = [\n1 3 0 0 0 19 1 1 0 230 1 1.1 0.9;\n2 1 5 1 0 0 1 1 0 230 1 1.1 0.9;\n];\nmpc.gen = [1 5 0 9 -9 1 100 1 10 0];\nmpc.branch = [1 2 0.01 0.1 0 100 0 0 0 0 1];\n")
    got = read_matpower(spark, str(tmp_path / "c.m"))
    assert got["cases"].first().base_mva == 50.0
    assert list(map(tuple, got["shunts"].collect())) == [(1, 1, 0.0, 19.0)]
