"""MATPOWER case files: the matrices of a case as rows of numbers, and the grid tables made of them."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession


def parse_matpower(text: str) -> dict:
    """base_mva and the matrices bus, gen, branch and gencost as lists of float rows."""
    text = re.sub(r"%[^\n]*", "", text)
    base = re.search(r"mpc\.baseMVA\s*=\s*([-\d.eE+]+)", text)
    out: dict = {"base_mva": float(base[1]) if base else 100.0}
    for name in ("bus", "gen", "branch", "gencost"):
        m = re.search(rf"mpc\.{name}\s*=\s*\[(.*?)\]", text, re.S)
        rows = re.split(r"[;\n]", m[1]) if m else []
        out[name] = [[float(x) for x in re.split(r"[\s,]+", r.strip())] for r in rows if r.strip()]
    return out


def read_matpower(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """cases (base_mva), buses, branches, generators, loads and shunts (MW and MVAr at 1 pu); rows out of service are left out, a tap of 0 is 1, degrees become radians."""
    case = parse_matpower("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    buses = [(int(r[0]), f"Bus {int(r[0])}", r[9], r[7], math.radians(r[8]), int(r[6])) for r in case["bus"]]
    loads = [(i + 1, int(r[0]), r[2], r[3]) for i, r in enumerate(x for x in case["bus"] if x[2] or x[3])]
    shunts = [(i + 1, int(r[0]), r[4], r[5]) for i, r in enumerate(x for x in case["bus"] if x[4] or x[5])]
    costs = case["gencost"] + [None] * (len(case["gen"]) - len(case["gencost"]))
    gens = []
    for i, (r, c) in enumerate(zip(case["gen"], costs)):
        if r[7] > 0:
            n = int(c[3]) if c else 0
            coeffs = list(reversed(c[4 : 4 + n])) if c and c[0] == 2 else []
            points = c[4 : 4 + 2 * n] if c and c[0] == 1 else []
            gens.append((i + 1, int(r[0]), r[1], r[2], r[9], r[8], r[4], r[3], coeffs, points))
    branches = [(i + 1, int(r[0]), int(r[1]), r[2], r[3], r[4], r[8] or 1.0, math.radians(r[9]), r[5], True) for i, r in enumerate(case["branch"]) if r[10] > 0]
    return {
        "cases": spark.createDataFrame([(case["base_mva"],)], "base_mva double"),
        "shunts": spark.createDataFrame(shunts, "id long, bus long, gs_mw double, bs_mvar double"),
        "buses": spark.createDataFrame(buses, "id long, name string, voltage_kv double, voltage_pu double, angle_rad double, area_id long"),
        "loads": spark.createDataFrame(loads, "id long, bus long, active_power_mw double, reactive_power_mvar double"),
        "generators": spark.createDataFrame(gens, "id long, bus long, active_power_mw double, reactive_power_mvar double, pmin_mw double, pmax_mw double, qmin_mvar double, qmax_mvar double, cost_coeffs array<double>, cost_values array<double>"),
        "branches": spark.createDataFrame(branches, "id long, from_bus long, to_bus long, resistance_pu double, reactance_pu double, charging_b_pu double, tap_ratio double, phase_shift_rad double, rate_a_mva double, status boolean"),
    }
